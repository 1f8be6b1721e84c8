"""Documents packed into parts, against the SQL of the queries, on texts that the test tables don't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenbase.operators import chunking
from lumenbase.plans.catalogue import ORACLE_SQL, QUERIES

LINES = "\n".join(["x" * 99] * 60)
TEXTS = [
    "", " ", "\n\t\n \r\n", None, "a", "a\n\nb \t c\r\nd", "\x0b", "\xa0a\xa0\nb", "\x0b\n" * 900, "　x\x85\n" * 700, "\x0ca\x0c\n" * 800,
    "\x01", "a\x01b\nc", "\x01\n\x01", LINES, LINES.replace("\n", "\n\x01"), LINES.replace("x\n", "\x01\n"), "y" * 1401 + "\x01\nz", ("l" * 200 + "\x01" + "m" * 200 + "\n") * 20,
    "y" * 1400, "y" * 1401, "y" * 1398 + "\nb", "y" * 1399 + "\nb", "y" * 4998 + "\nb", "y" * 4999 + "\nb", "b\n" + "y" * 5001 + "\nc", "\U0001f600\n" * 900,
]


@pytest.mark.parametrize("name", ["block_parts", "pack_lines"])
def test_odd_texts_give_the_rows_of_sql(spark, tmp_path, name):
    rows = [(4 * i + k, text) for i, text in enumerate(TEXTS) for k in (0, 1)] + [(None, LINES), (-4, LINES)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {(r["doc_id"], r["part"]): r["text"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    want = duck.sql(f"SELECT doc_id, part, text FROM ({ORACLE_SQL[name]})").fetchall()
    assert got == {(i, part): text for i, part, text in want}
    assert len(want) == len(got)
    assert [got.get((4 * i, 0)) for i in range(4)] == ["", "", "", None]


def test_operators_give_no_part_for_a_blank_text(spark):
    rows = spark.createDataFrame([("",), (" \n",), (None,)], "t string").withColumn("clean", chunking.clean_text(F.col("t")))
    got = rows.select(chunking.pack_lines(F.col("t")).alias("a"), chunking.block_parts(F.lit("table"), F.col("clean")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [([], [])] * 3
