"""Where queries and their SQL are registered, and literal tables for both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the function under its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_literal, v)) + "]"
    return str(v)


class Rows:
    """A literal table that both engines read."""

    def __init__(self, ddl: str, rows: list[tuple]):
        self.ddl, self.rows = ddl, rows
        self.names = [part.split()[0] for part in ddl.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    def sql(self, name: str) -> str:
        kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}
        casts = ", ".join(f"CAST({n} AS {kinds[part.split()[1]]}) AS {n}" for n, part in zip(self.names, self.ddl.split(", "), strict=True))
        body = ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in self.rows)
        return f"{name} AS (SELECT {casts} FROM (VALUES {body}) AS v({', '.join(self.names)}))"
