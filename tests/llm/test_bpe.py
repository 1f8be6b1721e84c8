import hashlib
import random

import numpy as np
import public_tokenizers

from lumenbase.llm.bpe import byte_pair_encoding, decode_documents, encode_documents, round_trip_digests
from lumenbase.llm.common import cut_spaced, tokenizer_file

ALPHABET = "ab Z  \n\t\r\x0b\x1c\x85\xa0　.,'s'll123é́ΣßİÄ中😀<|endoftext|>-_"


def texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", " ", "  ", " \n a", "a \n", "don't I'LL"]


def library():
    return byte_pair_encoding(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_pieces_are_encoded_as_within_the_text():
    enc = library()
    for t in texts(3000):
        assert "".join(cut_spaced(t)) == t
        assert [i for p in cut_spaced(t) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_documents_over_many_blocks(docs):
    enc = library()
    rows = [(i, t) for i, t in enumerate(texts(60))] + [(100, None), (101, "the cat " * 20_000), (101, None), (None, "x")]
    want = {i: enc.encode_ordinary(t or "") for i, t in rows if i is not None and (i, t) != (101, None)}
    frame = docs(rows)
    encoded = encode_documents(frame, block_chars=300, chunk=7)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    told = dict(rows[:60]) | {100: "", 101: "the cat " * 20_000}
    back = {r["doc_id"]: bytes(r["data"]) for r in decode_documents(encoded).collect()}
    assert all(back[i] == (t or "").encode() for i, t in told.items())
    for r in round_trip_digests(frame, block_chars=300, chunk=7).collect():
        ids = np.array(want[r["doc_id"]], dtype="<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        if r["doc_id"] in told:
            assert r["decoded_sha256"] == hashlib.sha256((told[r["doc_id"]] or "").encode()).hexdigest()


def test_empty_table_and_null_ids(docs, spark):
    assert round_trip_digests(docs([])).collect() == []
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r["doc_id"], r["data"]) for r in decode_documents(rows).orderBy("doc_id").collect()] == [(1, None), (2, b"")]


def test_other_columns_may_have_clashing_names(docs):
    frame = docs([(1, "a b"), (2, None)]).selectExpr("*", "1 as block", "2 as bucket", "'x' as data", "3 as kind", "4 as n_tokens")
    assert {r["doc_id"]: r["n_tokens"] for r in round_trip_digests(frame).collect()} == {1: 2, 2: 0}
