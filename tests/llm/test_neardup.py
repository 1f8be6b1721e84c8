import itertools
import random

import numpy as np
import pytest

from lumenbase.llm.graph import components
from lumenbase.llm.neardup import common_counts, min_hashes, near_duplicates, shingle_set


def sets_of(rows, words):
    out = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def classes(edges, nodes):
    up = {n: n for n in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, words, share):
    s = sets_of(rows, words)
    links = [(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= share * len(s[a] | s[b])]
    label = classes(links, s)
    return {(i, len(s[i]), label[i], label[i] == i) for i in s}


def check(docs, rows, words=2, share=80):
    assert set(map(tuple, near_duplicates(docs(rows), words=words, share=share).collect())) == brute(rows, words, share)


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(80)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "edits"), [(2, 3), (2, 6), (5, 2)])
def test_equals_brute_force(docs, words, edits):
    rng = random.Random(edits)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for n in (2, 3, 40, 1, 1, 12):
        texts += family(rng, vocabulary, n, edits)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(30)]
    texts += texts[:10]
    rng.shuffle(texts)
    check(docs, list(enumerate(texts)), words)


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É x"), (8, "é x"), (9, "a b c d e f"), (10, "a b c d e f g"), (11, "A B C D E F"), (13, "z " * 5000), (14, "z z z"), (None, "one")]
    check(docs, rows)
    check(docs, rows, words=5)
    check(docs, [])
    twice = [(1, "b b"), (1, None), (1, "a a"), (2, "a a")]
    assert sorted(map(tuple, near_duplicates(docs(twice), words=2).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_other_columns_may_have_clashing_names(docs):
    frame = docs([(1, "a b c"), (2, "a b c"), (3, None)]).selectExpr("*", "1 as sig", "2 as k1", "3 as rep", "4 as component_id", "true as kept")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(frame, words=2).collect()) == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_exactly_at_the_bound(docs):
    eight = " ".join(f"w{i}" for i in range(9))  # eight shingles of two words
    check(docs, [(1, eight + " x"), (2, eight + " y"), (3, eight), (4, eight + " x y")])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    share = (min_hashes(np.unique(a)) == min_hashes(np.unique(b))).mean()
    assert abs(share - 800 / 1200) < 0.15


def test_shingles_shorter_than_asked():
    assert len(shingle_set(b"a b", 5)) == len(shingle_set(b"A  b", 5)) == 1
    assert shingle_set(b"a b", 5).tolist() == shingle_set(b"A  b", 5).tolist()
    assert len(shingle_set(None, 2)) == 0


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    other = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = chain + star + other + [(5, 5), (1, 0)]
    rng.shuffle(edges)
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long"), one_task=one_task).collect()}
    want = classes(edges, {n for e in edges for n in e})
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "u long, v long"), one_task=one_task).collect() == []


def test_links_inside_a_crowded_group(docs):
    # Texts of a template are at 150/188, just below the bound; planted pairs share one word more, 151/187, and look no
    # more similar than the rest by signature.
    rows = [(i, " ".join([f"t{k}" for k in range(150)] + [f"u{i}x{k}" for k in range(19)])) for i in range(2000)]
    for i in range(0, 60, 3):
        rows[i + 1000] = (i + 1000, rows[i + 1000][1].replace(f"u{i + 1000}x0", f"u{i}x0"))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(rows), words=1, share=80).collect()}
    assert got == {i: i - 1000 if i in range(1000, 1060, 3) else i for i in range(2000)}


@pytest.mark.parametrize(("n", "length", "edits", "words"), [(500, 100, 5, 2), (300, 120, 6, 2), (250, 300, 10, 5)])
def test_crowded_clusters_of_several_components(docs, n, length, edits, words):
    rng = random.Random(length)
    base = [f"b{rng.randrange(5000)}" for _ in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(length), edits):
            w[at] = f"e{rng.randrange(60) if i % 3 else rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    check(docs, rows, words)


def test_crowds_of_two_centres_and_ties(docs):
    rng = random.Random(5)
    one = [f"a{k}" for k in range(60)]
    two = one[:45] + [f"c{k}" for k in range(15)]
    rows = []
    for i in range(160):
        w = list(one if i % 2 else two)
        for at in rng.sample(range(60), 3):
            w[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    check(docs, rows + [(1000 + i, t) for i, t in rows[:40]])


@pytest.mark.parametrize("rare", [0, 4, 1 << 40])
def test_common_counts(rare):
    rng = np.random.default_rng(3)
    one, two = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(n)] for n in (17, 23))
    assert common_counts(one, two, columns=16, rare=rare).tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]
