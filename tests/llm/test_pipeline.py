import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lumenbase.llm.neardup import near_duplicates  # noqa: E402
from lumenbase.llm.substrings import remove_repeats  # noqa: E402

PARTS = {"en": "the and that with from this ing tion ble ould there", "de": "der die und nicht keit ung schaft für ein"}


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        parts = PARTS[lang].split()
        rows.append((i, " ".join(rng.choice(parts) + rng.choice(parts) + rng.choice(parts) for _ in range(rng.randrange(40, 90))), lang))
    shared = " ".join(rng.choice(PARTS["en"].split()) + rng.choice(PARTS["en"].split()) for _ in range(60))
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(6)]
    rows += [(310 + k, rows[10 + k][1] + " extra", rows[10 + k][2]) for k in range(4)]
    rows += [(320 + k, f"{rows[20 + k][1][::-1]} {shared}", "en") for k in range(4)]
    rows += [(400, "1234 -- 5678", None), (401, None, None), (402, "", None), (None, "the and that", "en")]
    return rows


def kept_by_brute_force(rows, words=5, share=80):
    """The documents whose id is the smallest of their component, over all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i for i in sets if root(i) == i}


def cleaned_by_brute_force(rows, size=20):
    """Each text without the words of windows that start earlier too."""
    words = {i: (t or "").split(" ") for i, t in rows}
    seen, out = set(), {}
    for i in sorted(words):
        w, gone = words[i], set()
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in seen:
                gone |= set(range(k, k + size))
            seen.add(window)
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_stages_equal_brute_force(spark, docs):
    rows = [r for r in corpus() if r[0] is not None and r[1] and r[1][0].isalpha()]
    long = " ".join(rows[k][1] for k in range(60))
    rows += [(500, long, "en"), (501, long + " end", "en"), (502, "other " + long[: len(long) // 2], "en"), (503, " ".join(["same"] * 3000), "en")]
    two = corpus_pipeline.STAGES[1][1](spark, docs(rows), "")
    kept = {r["doc_id"]: r["text"] for r in two.collect()}
    assert set(kept) == kept_by_brute_force([(i, t) for i, t, _ in rows])
    three = {r["doc_id"]: r["text"] for r in corpus_pipeline.STAGES[2][1](spark, two, "").collect()}
    assert three == cleaned_by_brute_force(kept.items())


def test_stages_in_order(spark, docs):
    frame, rows = docs(corpus()), corpus()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, frame, "")
    assert one.columns == frame.columns
    ids = {r["doc_id"] for r in one.collect()}
    assert not ids & {400, 401, 402, None} and len(ids) >= 250
    two = stages[1](spark, one, "")
    kept = {r["doc_id"] for r in two.collect()}
    assert kept == {r["doc_id"] for r in near_duplicates(one).where("kept").collect()}
    assert not kept & {300, 301, 302, 303, 304, 305, 310, 311, 312, 313}
    three = stages[2](spark, two, "")
    assert three.columns == frame.columns
    got = {r["doc_id"]: r for r in three.collect()}
    assert set(got) == kept
    assert {i: r["text"] for i, r in got.items()} == {r["doc_id"]: r["text"] for r in remove_repeats(two).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    text = dict((i, t) for i, t, _ in rows)
    assert got[320]["text"] == text[320] and all(len(got[i]["text"]) < len(text[i]) for i in (321, 322, 323))
    packed = stages[3](spark, three, "").collect()
    assert {r["doc_id"] for r in packed} == kept


def test_run_over_a_table(spark, docs, tmp_path):
    docs(corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.where("offset + length > 2048").count() == 0 and got.count() > 200


def test_empty_table(spark, docs):
    frame = docs([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, "")
        assert out.count() == 0
        assert name == "packing" or out.columns == frame.columns
