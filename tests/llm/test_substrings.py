import hashlib
import random

import pytest

from lumenbase.llm.substrings import by_document, compacted, remove_repeats, removal_digests


def brute(rows, size):
    """Every window, in the order of documents and starts."""
    texts = {}
    for i, t in rows:
        if i is not None and (i not in texts or texts[i] is None or (t is not None and t < texts[i])):
            texts[i] = t
    seen, out = set(), {}
    for i in sorted(texts):
        words = (texts[i] or "").encode().split()
        gone = set()
        for p in range(len(words) - size + 1):
            w = tuple(words[p : p + size])
            if w in seen:
                gone.update(range(p, p + size))
            seen.add(w)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), kept)
    return out


def check(docs, rows, **options):
    size = options.get("size", 20)
    want = brute(rows, size)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in removal_digests(docs(rows), **options).collect()}
    assert got == {i: (n, gone, hashlib.sha256(b" ".join(kept)).hexdigest()) for i, (n, gone, kept) in want.items()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(90)]
    line = [rng.choice(words) for _ in range(26)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 150))]
        if i % 3 == 0:
            k = rng.randrange(len(w) + 1)
            w[k:k] = line
        if i % 5 == 0:
            a = rng.randrange(0, 60)
            w += passage[a : a + rng.randrange(5, 60)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(n + k, rows[k][1]) for k in range(0, 30, 2)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    check(docs, corpus(seed))


def test_small_windows_and_few_words(docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(40)]
    check(docs, rows, size=5, k=2)
    check(docs, rows, size=4, k=4)


def test_repeats_within_one_document(docs):
    rows = [(1, "a " * 500), (2, "a b c " * 40), (3, "x " * 19), (4, "x " * 20), (5, "x " * 21), (6, "b c a " * 30)]
    check(docs, rows)


def test_pieces_whose_sums_collide(docs):
    # The Thue-Morse word and its complement have equal polynomial hashes modulo 2^64, whatever the base.
    signs = [bin(i).count("1") % 2 for i in range(2048)]
    check(docs, [(1, " ".join("ab"[s] for s in signs)), (2, " ".join("ba"[s] for s in signs))], size=1500)


def test_odd_rows(docs):
    rows = [(5, None), (1, ""), (2, " \n "), (None, "a " * 50), (7, "b " * 30), (7, "a c " * 30), (7, None), (8, "a c " * 30), (9, "é\x1c\xa0z " * 25), (-3, "é\x1c\xa0z " * 25)]
    check(docs, rows)
    check(docs, [])


def test_columns_stay(docs):
    rows = [(1, "a  b\n" * 30), (2, " ".join(f"w{i}" for i in range(60))), (3, "x " + " ".join(f"w{i}" for i in range(60)) + " y"), (4, None)]
    frame = docs(rows).selectExpr("*", "named_struct('a', doc_id) as marks", "1 as start")
    got = {r["doc_id"]: r for r in remove_repeats(frame).collect()}
    want = brute(rows, 20)
    assert remove_repeats(frame).columns == frame.columns
    assert {i: r["text"] for i, r in got.items()} == {i: (t if want[i][1] == 0 else b" ".join(want[i][2]).decode()) for i, t in rows}
    assert all(r["marks"]["a"] == i and r["start"] == 1 and r["lang"] == "en" for i, r in got.items())


def test_spans_follow_their_source(spark):
    rows = [(5, 0, 3, (1, 10)), (5, 3, 4, (1, 13)), (5, 7, 2, (2, 17)), (5, 9, 1, (2, 19)), (5, 12, 1, (2, 22)), (6, 0, 3, (1, 10)), (6, 3, 4, (1, 14))]
    frame = spark.createDataFrame(rows, "doc_id long, start int, n int, source struct<doc_id:long,start:int>")
    got = sorted((r["doc_id"], r["start"], r["n"], r["src_doc"], r["src_start"]) for r in compacted(frame).collect())
    assert got == [(5, 0, 7, 1, 10), (5, 7, 3, 2, 17), (5, 12, 1, 2, 22), (6, 0, 3, 1, 10), (6, 3, 4, 1, 14)]


def test_a_document_that_many_repeat_is_looked_up_in_parts(spark):
    marks = spark.createDataFrame([(1, k, 1) for k in range(100)] + [(2, 0, 3)], "doc_id long, start int, n int")
    got = by_document(marks, most=10).collect()
    assert sum(len(r["marks"]) for r in got) == 101 and sum(r["doc_id"] == 1 for r in got) > 5
