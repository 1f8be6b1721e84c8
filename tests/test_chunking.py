import random

from lumenbase.operators import chunking

BLOCKS = "file_id string, block_index int, block_type string, section string, text string"


def folded(rows, most):
    """One file's chunks, block after block."""
    out, now = [], []
    for _, index, kind, section, text in rows:
        alone, heading = kind == "table", text.startswith("II. ")
        if now and (alone or now[-1][1] == "table" or heading or now[0][2] != section or sum(len(t) + 1 for _, _, _, t in now) + len(text) > most):
            out.append(now)
            now = []
        now.append((index, kind, section, text))
    return [([i for i, _, _, _ in c], sorted({k for _, k, _, _ in c}), "\n".join(t for _, _, _, t in c)) for c in [*out, now] if c]


def made():
    rng = random.Random(4)
    rows = []
    for f in range(12):
        for i in range(rng.randrange(1, 60)):
            kind = "table" if rng.random() < 0.1 else "paragraph"
            text = ("II. " if rng.random() < 0.05 and kind != "table" else "") + "x" * rng.randrange(1, 40)
            rows.append((f"f{f}", i, kind, f"s{i // rng.choice((7, 30))}" if f % 2 else "s", text))
    rows += [("long", i, "paragraph", "s", "y" * (1 + i * 7 % 30)) for i in range(3000)]
    return rows


def test_flowing_chunks_equal_a_fold(spark):
    rows = made()
    got = {}
    for r in chunking.flowing_chunks(spark.createDataFrame(rows, BLOCKS).repartition(5), 60).collect():
        got.setdefault(r["file_id"], {})[r["n"]] = (r["block_indexes"], r["block_types"], r["text"])
    for f in {r[0] for r in rows}:
        want = folded([r for r in rows if r[0] == f], 60)
        assert [got[f][k] for k in range(len(got[f]))] == want
    assert len(got["long"]) > 500


def test_no_blocks_and_no_python(spark):
    assert chunking.flowing_chunks(spark.createDataFrame([], BLOCKS)).collect() == []
    blank = spark.createDataFrame([("f", 0, "paragraph", "s", "  "), ("f", 1, "paragraph", "s", None), ("f", 2, "paragraph", None, "a"), ("f", 3, "paragraph", None, "b")], BLOCKS)
    chunks = chunking.flowing_chunks(blank)
    assert [(r["n"], r["block_indexes"], r["text"]) for r in chunks.collect()] == [(0, [2, 3], "a\nb")]
    assert "Pandas" not in chunks._jdf.queryExecution().executedPlan().toString()
