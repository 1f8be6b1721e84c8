"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lumenbase.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()  # noqa: F841  read by the SQL below
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.column_names)
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    want.create("want")
    try:
        a = duck.sql(f"SELECT {listed} FROM want ORDER BY ALL").fetchall()
        b = duck.sql(f"SELECT {listed} FROM got ORDER BY ALL").fetchall()
    finally:
        duck.sql("DROP TABLE want")
    assert a == b


def test_queries_without_sql_are_few():
    assert set(QUERIES) - set(ORACLE_SQL) == {"graph_neighbours"}
