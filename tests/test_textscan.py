import os
import random

import pyarrow as pa
import pytest

from lumenbase.operators import lexical
from lumenbase.operators.textscan import found_in, text_scan
from lumenbase.plans.catalogue import QUERIES
from lumenbase.sources import shared

SF = "/root/testdata/sf0.001"


def test_needles_equal_a_scan():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé 😀") for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", "ab" * 40_000, "same text here", "same text herf"]
    needles = sorted({"".join(rng.choice("abé 😀") for _ in range(rng.randrange(1, 7))) for _ in range(80)} | {"same text here", "same text here!", "ab" * 9, "text herf"})
    want = {(r, i) for r, t in enumerate(texts) for i, n in enumerate(needles) if t is not None and n in t}
    for column in (pa.array(texts), pa.concat_arrays([pa.array(["ab", None]), pa.array(texts)]).slice(2)):
        row, which = found_in(column, [n.encode() for n in needles])
        assert sorted(zip(row.tolist(), which.tolist(), strict=True)) == sorted(want)
    assert [len(x) for x in found_in(pa.array([], pa.string()), [b"a"])] == [0, 0]


def test_a_scan_scores_as_the_index(spark):
    rng = random.Random(5)
    rows = [("f", i, "pdf" if i % 3 else "xlsx", " ".join(rng.choice(["chung", "cặp", "đôi", f"riêng{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(300)] + [("f", 900, "pdf", "")]
    chunks = spark.createDataFrame(rows, "file_id string, chunk_index long, file_type string, document string")
    asked = spark.createDataFrame([(1, "chung"), (2, "chung riêng7"), (3, "không đâu"), (4, "cặp đôi chung"), (5, "")], "question_id long, question string")
    index, scan = lexical.lexical_index(chunks), text_scan(chunks)
    some = chunks.where("chunk_index % 2 = 0").selectExpr("4L AS question_id", "file_id", "chunk_index")
    for a, b in ((index, scan), (index.of("pdf"), scan.of("pdf"))):
        assert sorted(map(tuple, lexical.bm25(a, asked).collect())) == sorted(map(tuple, lexical.bm25(b, asked).collect()))
        assert sorted(map(tuple, lexical.bm25(a, asked, some).collect())) == sorted(map(tuple, lexical.bm25(b, asked, some).collect()))
        assert sorted(map(tuple, lexical.lexical_hits(a, asked, 5).collect())) == sorted(map(tuple, lexical.lexical_hits(b, asked, 5).collect()))
        assert len(b.seen) == 1  # the three searches read the texts once


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["bm25_all_types", "bm25_phrase_bonus", "substring_search"])
def test_a_single_batch_writes_no_index(spark, name, monkeypatch):
    monkeypatch.setattr(shared, "BUILT", {})
    rows = QUERIES[name](spark, SF)
    rows.collect()
    assert shared.BUILT == {}


def test_an_index_without_stored_grams(spark, tmp_path):
    chunks = spark.createDataFrame([("f", 1, "pdf", "cặp đôi chung"), ("f", 2, "xlsx", "chung đôi")], "file_id string, chunk_index long, file_type string, document string")
    lexical.write_index(chunks, str(tmp_path / "i"), grams=False)
    assert not (tmp_path / "i" / "grams").exists()
    index = lexical.read_index(spark, str(tmp_path / "i"), grams=False)
    assert sorted(map(tuple, lexical.sizes(index).collect())) == [("pdf", 1, 3, 3, 1), ("xlsx", 1, 2, 2, 1)]
    assert [r["chunk_index"] for r in lexical.phrase_hits(index, spark.createDataFrame([(1, "p đôi")], "question_id long, phrase string")).collect()] == [1]


def test_texts_of_evidence_come_without_the_vectors(spark):
    """The last step reads texts and the evidence's keys; no join of all texts with all vectors is left in it."""
    from lumenbase.plans.search_queries import evidence

    files = evidence(spark, "/root/testdata/sf0.001").inputFiles()
    assert any("documents" in f for f in files) and not any("embeddings" in f for f in files)


def test_latin_texts_are_normalised_as_arrays_of_bytes(spark):
    """What a scan makes of texts, terms and counts, equals the Column expressions."""
    from pyspark.sql import functions as F

    from lumenbase.functions.text import STOPWORDS, normalize_search, tokens_of
    from lumenbase.operators.textscan import bytes_of, normalised, read_once

    rng = random.Random(8)
    latin = [chr(c) for c in range(1, 0x180)]
    mixed = [*latin, *" \t\n\xa0 ’`'ẮđĐΣİ́ 😀" * 6]
    words = ["été", "straße", "überaus_lang1", "überaus_lang2", "ab", "x", *STOPWORDS[:3], "đôi", "abcdefgh", "abcdefghi"]
    texts = [f"{a}{c}b {c}x{c}" for c in latin for a in ("", "a", " ", "Ω")] + [None, "", " ", "É", "É-é"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for pool in (latin, mixed) for _ in range(1500)]
    texts += [rng.choice([" ", "\n", "!"]).join(rng.choice([*words, "ÉTÉ", "Đôi"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([("f", i, "pdf", t) for i, t in enumerate(texts)], "file_id string, chunk_index long, file_type string, document string")
    scan = text_scan(rows)
    want = {r[0]: r[1:] for r in rows.select("chunk_index", normalize_search(F.col("document")).alias("n")).select("chunk_index", "n", tokens_of(F.col("n")).alias("t")).collect()}
    got = {r["chunk_index"]: r["text"] for r in scan.rows.collect()}
    data, offsets = normalised(*bytes_of(pa.array([got[i] for i in range(len(texts))])))
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)] == [want[i][0] or "" for i in range(len(texts))]
    seen = {r["chunk_index"]: r for r in read_once(scan.rows, {5: "b é"}, words).collect()}
    for i, (norm, terms) in want.items():
        assert seen[i]["n_terms"] == (None if terms is None else len(terms))
        assert {h["term"]: h["tf"] for h in seen[i]["hits"]} == {w: terms.count(w) for w in words if terms and w in terms}
        assert seen[i]["held"] == ([5] if norm and "b é" in norm else [])
