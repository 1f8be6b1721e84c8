import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenbase.llm.common import tokenizer_file
from lumenbase.llm.packing import pack_documents, place_of, plan_bins


def plain_best_fit(lengths, size):
    """Best-fit decreasing, one document at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            k = left.index(min(fits))
            left[k] -= n
        else:
            left.append(size - n)
    return left


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_equals_best_fit_one_by_one(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = plan_bins(counts, 64)
    left = [64] * bins
    spans = {}
    for n, c in counts.items():
        for rank in range(c):
            b, at = place_of(runs, n, rank)
            spans.setdefault(b, []).append((at, n))
            left[b] -= n
    for parts in spans.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 64
    assert sorted(left) == sorted(plain_best_fit(lengths, 64))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return t


def test_pieces_are_the_librarys_ids(docs, library):
    rng = random.Random(5)
    letters = "abc DEF éß ,.'s 123\t\n <|endoftext|> Σς İ"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(200)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "word " * 9000), (44, "same text"), (45, "same text"), (46, "a <|endoftext|> b"), (47, "x<|startoftext|>Y<|endoftext|>. <|ENDOFTEXT|>")]
    got = pack_documents(docs(rows), size=256).collect()
    by = {(r["doc_id"], r["piece"]): r for r in got}
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = -(-len(ids) // 256)
        assert (i, pieces) not in by
        for k in range(pieces):
            part = ids[k * 256 : (k + 1) * 256]
            r = by[i, k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k * 256, len(part), zlib.crc32(part.tobytes()))
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 256


def test_many_equal_lengths_are_dealt_in_groups(docs):
    got = pack_documents(docs([(i, "a b c") for i in range(300)]), size=10, rows_a_group=20).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 300
    assert len({r["sequence_id"] for r in got}) == 150


def test_empty_null_and_repeated_ids(spark, docs):
    assert pack_documents(docs([])).collect() == []
    got = pack_documents(docs([(None, "a"), (1, "b b"), (1, None), (1, "b b")])).collect()
    assert [(r["doc_id"], r["length"]) for r in got] == [(1, 3)]
    clash = docs([(1, "a")]).selectExpr("*", "1 as piece", "2 as length", "3 as sequence_id")
    assert pack_documents(clash).count() == 1
