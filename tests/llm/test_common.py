from pyspark.sql import functions as F

from lumenbase.llm.common import input_bytes, keyed, partitions_for, release


def test_only_repeated_ids_are_grouped(spark, docs):
    rows = [(i, f"text {i}") for i in range(50)] + [(3, "a"), (3, None), (4, "text 4"), (None, "x"), (5, None)]
    got = {r["doc_id"]: r["text"] for r in keyed(docs(rows), "doc_id", "text").collect()}
    assert got == {i: "a" if i == 3 else f"text {i}" for i in range(50)}
    assert release(spark) == 1
    assert keyed(docs(rows[:50]), "doc_id", "text").count() == 50 and release(spark) == 0


def test_partitions_follow_the_files_in_any_plan(spark, docs, tmp_path):
    docs([(i, "word " * 500) for i in range(300)]).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    size = input_bytes(stored)
    grouped = stored.unionByName(stored).groupBy("doc_id").agg(F.min("text").alias("text"))
    assert size > 0 and input_bytes(grouped) == 2 * size
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(grouped) == least and partitions_for(grouped, size // 50) >= 100
    assert partitions_for(docs([(1, "x")])) == least
