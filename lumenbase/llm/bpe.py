"""Byte-level BPE by a global shuffle of distinct pieces of text.

Encoding: texts are exploded into pieces with their positions, block by block. A block (some megabytes of text) keeps its
positions as numbers into its own list of distinct pieces, and sends each distinct piece once to the bucket of the piece's
hash. Buckets encode each distinct piece once and send the ids back to the blocks that asked; a block then puts the ids in
place by position. So a piece travels once for each block that holds it, and never once for each place where it stands.
Decoding looks each id up in the table of token bytes (as large as the vocabulary).

A piece runs from a space that follows a non-space up to the next such space, so it is made of whole matches of the
splitting pattern, and encoding it alone gives the ids that it has within its text.

Rows of both kinds are packed: a block's pieces of one bucket are one row, and about `chunk` positions are one row.

Defined results: null text counts as empty and has no ids; rows with a null id are left out and repeated ids count once
(see common.keyed); an empty table gives no rows; texts of any length are encoded whole.

Blocks are made twice, once to ask for ids and once to put them in place; nothing but packed pieces and positions is
shuffled or stored. So blocks must come out the same each time, also after an executor is lost: they are cut from a scan of
files, and any other input is first written to the shared folder. A block's number is a hash of the ids, sizes and number
of pieces of what is in it; were a block made differently, its answers would be missing and the query would end."""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbase.llm.common import batch_of, cut_spaced, is_scan, keyed, lasting, pairs, partitions_for, tokenizer_file

PART = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
PART_DDL = "block long, bucket int, kind int, data binary"
ASKED, ANSWER, PLACES = 0, 1, 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_pair_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def planes(numbers: np.ndarray) -> bytes:
    """The four bytes of each number apart; zstd packs the upper ones to nearly nothing."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(*parts: bytes) -> bytes:
    sizes = np.array([len(parts), *map(len, parts)], dtype="<u8")
    return zstandard.compress(sizes.tobytes() + b"".join(parts), 3)


def unpack(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(data, "<u8", n, 8)]).astype(np.int64)
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def taken(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[0]:start[0]+length[0]] and so on, end to end."""
    ends = np.cumsum(length)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def close_block(docs: list[int], places: list[np.ndarray], known: dict[str, int], kind: int, buckets: int, chunk: int) -> Iterator[tuple]:
    """Rows of one block. Pieces are numbered by falling frequency, which keeps the upper bytes of positions zero."""
    flat = np.concatenate(places)
    made_of = np.array([*docs, *map(len, places), len(known)], dtype="<i8")
    block = int(np.array(xxhash.xxh3_64_intdigest(made_of.tobytes()), np.uint64).view(np.int64))
    order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    if kind == ASKED:
        yield from asked_rows(block, [w.encode() for w in known], rank, buckets)
    else:
        yield from place_rows(block, docs, places, rank, chunk)


def asked_rows(block: int, words: list[bytes], rank: np.ndarray, buckets: int) -> Iterator[tuple]:
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
    for b in np.unique(bucket).tolist():
        at = np.flatnonzero(bucket == b)
        at = at[np.argsort(rank[at])]
        own = [words[i] for i in at]
        yield block, b, ASKED, pack(planes(np.diff(rank[at], prepend=0)), planes(np.array([len(w) for w in own])), b"".join(own))


def place_rows(block: int, docs: list[int], places: list[np.ndarray], rank: np.ndarray, chunk: int) -> Iterator[tuple]:
    k = 0
    while k < len(docs):
        first, size = k, 0
        while k < len(docs) and (k == first or size + len(places[k]) <= chunk):
            size += len(places[k])
            k += 1
        part = np.concatenate(places[first:k])
        yield block, 0, PLACES, pack(np.array(docs[first:k], dtype="<i8").tobytes(), planes(np.array([len(p) for p in places[first:k]])), planes(rank[part]))


def blocks_of(docs: DataFrame, kind: int, block_chars: int, buckets: int, chunk: int) -> DataFrame:
    def explode(batches) -> Iterator[pa.RecordBatch]:
        ids, places, size = [], [], 0
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__

        def out() -> Iterator[pa.RecordBatch]:
            for row in close_block(ids, places, dict(known), kind, buckets, chunk):
                yield batch_of(PART, [[x] for x in row])

        for b in batches:
            for doc, text in pairs(b):
                pieces = cut_spaced(text or "")
                ids.append(doc)
                places.append(np.fromiter(map(known.__getitem__, pieces), np.uint32, len(pieces)))
                size += len(text or "")
                if size >= block_chars:
                    yield from out()
                    ids, places, size = [], [], 0
                    known.clear()
        if ids:
            yield from out()

    return docs.mapInArrow(explode, PART_DDL)


def encode_pieces(asked: DataFrame, path: str, pattern: str, keep: int = 300_000) -> DataFrame:
    """From each block's pieces of a bucket, their ids in the same order. Rows of a bucket follow each other, and a piece
    is encoded again only after `keep` others."""

    def answer(batches) -> Iterator[pa.RecordBatch]:
        enc, known = byte_pair_encoding(path, pattern), {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                rank, sizes, flat = unpack(data)
                ends = np.cumsum(from_planes(sizes)).tolist()
                words = [flat[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                if len(known) > keep:
                    known = {}
                for w in words:
                    if w not in known:
                        known[w] = np.array(enc.encode_ordinary(w.decode()), dtype="<u4")
                ids = [known[w] for w in words]
                yield batch_of(PART, [[block], [0], [ANSWER], [pack(rank, planes(np.array([len(x) for x in ids])), planes(np.concatenate(ids)))]])

    return asked.mapInArrow(answer, PART_DDL)


def assemble(parts: DataFrame, finish, schema: pa.Schema, ddl: str) -> DataFrame:
    """parts: answers and places, by block, a block's answers first. finish(ids) gives the columns after doc_id."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        done = finish()
        block, answers, table = None, [], None
        for b in batches:
            rows = []
            for of, kind, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if of != block:
                    block, answers, table = of, [], None
                if kind == ANSWER:
                    answers.append(data)
                    continue
                if table is None:
                    table, answers = joined(answers), []
                flat, start, length = table
                docs, sizes, at = unpack(data)
                at, ends = from_planes(at).astype(np.int64), np.cumsum(from_planes(sizes).astype(np.int64))
                for doc, a, z in zip(np.frombuffer(docs, "<i8").tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    rows.append((doc, *done(taken(flat, start[at[a:z]], length[at[a:z]]))))
            if rows:
                yield batch_of(schema, [list(c) for c in zip(*rows, strict=True)])

    return parts.mapInArrow(run, ddl)


def joined(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids end to end, and of each piece number where its ids start and how many there are."""
    ranks, sizes, ids = [], [], []
    for data in answers:
        r, s, i = unpack(data)
        ranks.append(np.cumsum(from_planes(r).astype(np.int64)))
        sizes.append(from_planes(s).astype(np.int64))
        ids.append(from_planes(i))
    if not ranks:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, size = np.concatenate(ranks), np.concatenate(sizes)
    start, length = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    length[rank] = size
    start[rank] = np.cumsum(size) - size
    return np.concatenate(ids), start, length


def encoded(docs: DataFrame, finish, schema: pa.Schema, ddl: str, path: str | None, pattern: str | None, id_col: str, text_col: str, block_chars: int, chunk: int) -> DataFrame:
    import public_tokenizers

    path, pattern = path or tokenizer_file("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    texts = keyed(docs, id_col, text_col)
    texts = texts if is_scan(texts) else lasting(texts, "texts")
    parts = partitions_for(texts)
    asked = blocks_of(texts, ASKED, block_chars, parts, chunk).repartition(parts, "bucket").sortWithinPartitions("bucket")
    both = encode_pieces(asked, path, pattern).unionByName(blocks_of(texts, PLACES, block_chars, parts, chunk))
    return assemble(both.repartition(parts, "block").sortWithinPartitions("block", "kind"), finish, schema, ddl)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 24_000_000, chunk: int = 1_000_000) -> DataFrame:
    """doc_id, ids (array of int) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return encoded(docs, lambda: lambda ids: (ids.astype(np.int32),), schema, "doc_id long, ids array<int>", path, pattern, id_col, text_col, block_chars, chunk)


def token_bytes(path: str) -> list[bytes]:
    """Of each id, its bytes."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for b, k in ranks.items():
        out[k] = b
    return out


def decode_documents(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data: the bytes of each row's ids; null ids give null, and an id outside the vocabulary ends the query."""
    path = path or tokenizer_file("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            yield batch_of(schema, [b.column(0), [None if ids is None else b"".join(map(table.__getitem__, ids)) for ids in b.column(1).to_pylist()]])

    return rows.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 24_000_000, chunk: int = 1_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode every document, decode its ids, and digest both."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    name = path or tokenizer_file("byte_bpe_50k.tiktoken")

    def finish():
        look = token_bytes(name).__getitem__

        def digests(ids: np.ndarray) -> tuple:
            return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(b"".join(map(look, ids.tolist()))).hexdigest()

        return digests

    return encoded(docs, finish, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, id_col, text_col, block_chars, chunk)
