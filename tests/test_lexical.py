import random
import re

from pyspark.sql import functions as F

from lumenbase.operators import grams, lexical
from lumenbase.operators.grams import GramIndex, dictionary_of, gram_rows, holding, part_of, survivors

CHUNK = "file_id string, chunk_index long, file_type string, document string"


def gram_index(spark, rows):
    texts = spark.createDataFrame(rows, "file_id string, chunk_index long, norm string").withColumn("part", part_of(["file_id", "chunk_index"]))
    postings = gram_rows(texts, ("file_id", "chunk_index"), F.col("norm"))
    return GramIndex(postings, dictionary_of(postings), ("file_id", "chunk_index")), texts


def test_substrings_equal_a_scan(spark):
    rng = random.Random(2)
    rows = [("f", i, "".join(rng.choice("abé 😀") for _ in range(rng.randrange(25)))) for i in range(300)] + [("f", 400, None), ("f", 401, ""), ("g", 402, "ab" * 50_000)]
    rows += [("h", 500 + i, "same text here") for i in range(200)]
    needles = sorted({"".join(rng.choice("abé 😀") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"me te", "zzz", "z", "same text here", "same text here!"})
    index, texts = gram_index(spark, rows)
    asked = spark.createDataFrame(list(enumerate(needles)) + [(900, None), (901, "")], "question_id long, phrase string")
    got = {tuple(r) for r in holding(index, texts, F.col("norm"), asked).collect()}
    assert got == {(q, f, i) for q, n in enumerate(needles) for f, i, t in rows if t is not None and n in t}
    left = survivors(index, asked.where("phrase = 'me te'")).count()
    assert left == 200  # no other text is read
    plan = holding(index, texts, F.col("norm"), asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_only_the_parts_of_survivors_are_read(spark, tmp_path):
    index, texts = gram_index(spark, [("f", i, f"text number {i}") for i in range(200)])
    texts.write.partitionBy("part").parquet(str(tmp_path / "texts"))
    stored = spark.read.parquet(str(tmp_path / "texts"))
    found = holding(index, stored, F.col("norm"), spark.createDataFrame([(1, "number 177")], "question_id long, phrase string"))
    assert [r["chunk_index"] for r in found.collect()] == [177]
    part = stored.where("chunk_index = 177").first()["part"]
    assert re.search(rf"PartitionFilters: \[[^]]*\(part#\d+ = {part}\)", found._jdf.queryExecution().executedPlan().toString())
    none = holding(index, stored, F.col("norm"), spark.createDataFrame([(1, "numbers")], "question_id long, phrase string"))
    assert none.columns == ["question_id", "file_id", "chunk_index"] and none.collect() == []


def test_pruned_search_equals_the_whole_list(spark, tmp_path, monkeypatch):
    """Long lists of a common word, of which a few rows stand out: most ranges can't reach them and stay shut."""
    monkeypatch.setattr(lexical, "RANGE", 8)
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        words = ["chung"] * (1 if i % 97 else rng.randrange(5, 9)) + [f"riêng{rng.randrange(3000)}" for _ in range(rng.randrange(8, 60))]
        rng.shuffle(words)
        rows.append(("f", i, "pdf" if i % 3 else "xlsx", " ".join(words)))
    rows += [("f", 2000, "pdf", ""), ("f", 2001, "pdf", None), ("f", 2002, "pdf", "cặp đôi chung"), ("f", 2003, "xlsx", "cặp đôi chung")]
    lexical.write_index(spark.createDataFrame(rows, CHUNK), str(tmp_path / "i"))
    index = lexical.read_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "chung"), (2, "chung riêng7"), (3, "không đâu"), (4, "cặp đôi chung"), (5, "")], "question_id long, question string")
    for part in (index, index.of("pdf"), index.of("xlsx")):
        want = {tuple(r) for r in lexical.ranked(lexical.bm25(part, asked), "bm25_score", 5).select("question_id", "file_id", "chunk_index", "bm25_score", "rank").collect()}
        assert {tuple(r) for r in lexical.lexical_hits(part, asked, 5).collect()} == want and len(want) >= 11
    counts = {r["question_id"]: r for r in lexical.postings_opened(index, asked, 5).collect()}
    assert set(counts) == {1, 2, 4} and counts[1]["postings"] > 1490
    assert counts[1]["opened"] < 0.5 * counts[1]["postings"]
    assert grams.PARTS == 16
