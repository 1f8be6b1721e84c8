"""Token-id output: shards of concatenated ids with Elias-Fano coded document boundaries.

A shard is one binary file: a header, the document ids, the boundaries and the ids. The boundaries (ids before each
document, and the total) never fall, so they are Elias-Fano coded: of each, the lowest `l` bits are stored packed, and the
rest in unary in a bit vector with about two bits a document. A select structure (the bit position of every 64th one) gives
any document's offset in constant time. That takes about 2 + log2(ids / documents) bits a document rather than 64.

Shards are rows of a Parquet table in the shared folder, so any store that Spark reaches can hold them;
each `data` value is a whole file in the format below. Shards follow each other in ascending doc_id order.

Format, little-endian: 8 bytes magic; unsigned 64-bit n documents, total ids, l, bytes an id (2 or 4), words of low bits,
words of high bits, select samples; then int64 doc ids, uint64 words of low bits, uint64 words of high bits, uint64 select
samples, ids.

Defined results: null text counts as empty and holds the end id alone; rows with a null id are left out and repeated ids
count once (see common.keyed); an empty table writes no shard and reads back as no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.llm.common import batch_of, forget_caches, fresh_path, keyed, pairs, partitions_for, release_later, tokenizer_file, write_once
from lumenbase.llm.encoders import encoder

SHARDS = "part int, first_doc long, n_docs long, n_ids long, data binary"
MAGIC = b"LBIDS\x00\x00\x01"
SAMPLE = 64


def bits_of(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")


def words_of(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8")


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of n numbers."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if width:
            low = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, width, words_of(low), words_of(high), at[::SAMPLE].astype("<u8"))

    def select(self, k: int) -> int:
        """The k-th number, from the nearest select sample on."""
        at, todo = int(self.samples[k // SAMPLE]), k % SAMPLE
        word, rest = at // 64, int(self.high[at // 64]) >> (at % 64) << (at % 64)
        while (ones := rest.bit_count()) <= todo:
            todo -= ones
            word += 1
            rest = int(self.high[word])
        for _ in range(todo):
            rest &= rest - 1
        value = word * 64 + (rest & -rest).bit_length() - 1 - k
        for b in range(self.low_bits):
            i = k * self.low_bits + b
            value = value if b else value << self.low_bits
            value |= (int(self.low[i // 64]) >> (i % 64) & 1) << b
        return value

    def select_each(self, k: np.ndarray) -> np.ndarray:
        """The k-th numbers, each from the nearest select sample on."""
        at, todo, one = self.samples[k // SAMPLE], k % SAMPLE, np.uint64(1)
        word = (at // np.uint64(64)).astype(np.int64)
        bit = at % np.uint64(64)
        if not (self.high[word] >> bit & one).all():
            raise ValueError("a select sample isn't at a boundary")
        rest = self.high[word] >> bit << bit
        while len(behind := np.flatnonzero((ones := np.bitwise_count(rest).astype(np.int64)) <= todo)):
            todo[behind] -= ones[behind]
            word[behind] += 1
            rest[behind] = self.high[word[behind]]
        for b in range(int(todo.max(initial=0))):
            rest = np.where(todo > b, rest & (rest - one), rest)
        value = word * 64 + np.bitwise_count((rest & (~rest + one)) - one).astype(np.int64) - k << self.low_bits
        for b in range(self.low_bits):
            i = k * self.low_bits + b
            value |= (self.low[i // 64] >> (i % 64).astype(np.uint64) & one).astype(np.int64) << b
        return value

    def all(self) -> np.ndarray:
        high = np.flatnonzero(bits_of(self.high))[: self.n] - np.arange(self.n)
        low = bits_of(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64)) if self.low_bits else 0
        return (high.astype(np.int64) << self.low_bits) + low


def write_shard(doc_ids: list[int], ids: list[bytes]) -> bytes:
    """`ids`: of each document, as little-endian unsigned 32-bit numbers."""
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
    ef, flat = EliasFano.of(ends), np.frombuffer(b"".join(ids), dtype="<u4")
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    head = np.array([len(doc_ids), len(flat), ef.low_bits, width, len(ef.low), len(ef.high), len(ef.samples)], dtype="<u8")
    return b"".join([MAGIC, head.tobytes(), np.array(doc_ids, dtype="<i8").tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), flat.astype(f"<u{width}").tobytes()])


@dataclass(frozen=True)
class Shard:
    doc_ids: np.ndarray
    ends: EliasFano
    ids: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        n, total, low_bits, width, low, high, samples = (int(x) for x in np.frombuffer(data, "<u8", 7, 8))
        at = 64
        parts = []
        for kind, count in (("<i8", n), ("<u8", low), ("<u8", high), ("<u8", samples), (f"<u{width}", total)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        if at != len(data):
            raise ValueError("a shard of token ids is cut short")
        return cls(parts[0], EliasFano(n + 1, low_bits, *parts[1:4]), parts[4])

    def document(self, k: int) -> np.ndarray:
        """The k-th document's ids, its place found by select alone."""
        return self.ids[self.ends.select(k) : self.ends.select(k + 1)].astype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_bytes: int = 16_000_000, keep: int = 400_000) -> None:
    """Sort by doc_id over ranges, encode and write shards of about `shard_bytes`. A task holds one shard at a time, and a
    worker remembers `keep` pieces."""
    name = tokenizer or tokenizer_file("byte_bpe_50k.json")
    schema = pa.schema([("part", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def shards(batches) -> Iterator[pa.RecordBatch]:
        enc, docs_in, ids_in, held = encoder(name, keep), [], [], 0
        part = TaskContext.get().partitionId()

        def shard() -> pa.RecordBatch:
            return batch_of(schema, [[part], [docs_in[0]], [len(docs_in)], [held // 4], [write_shard(docs_in, ids_in)]])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                docs_in.append(doc)
                ids_in.append(ids + end)
                held += len(ids_in[-1])
                if held >= 2 * shard_bytes:
                    yield shard()
                    docs_in, ids_in, held = [], [], 0
        if docs_in:
            yield shard()

    base = keyed(docs, id_col, text_col)
    ordered = base.repartitionByRange(partitions_for(base), "doc_id").sortWithinPartitions("doc_id")
    write_once(ordered.mapInArrow(shards, SHARDS), path, compression="none")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone. The number of ids before a shard comes
    from the shards' own counts: running sums within what one task wrote, and over those tasks' totals; documents get it by a
    join. Ranges of documents are written by tasks in ascending order."""
    files = spark.read.schema(SHARDS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a task that wrote
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("of_parts"))
    upto = F.sum("n_ids").over(Window.partitionBy("part").orderBy("first_doc").rowsBetween(Window.unboundedPreceding, 0))
    before = files.select("part", "first_doc", (upto - F.col("n_ids")).alias("own")).join(parts, "part").select("first_doc", (F.col("own") + F.col("of_parts")).alias("before"))
    schema = pa.schema([("first_doc", pa.int64()), ("doc_id", pa.int64()), ("own", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(batches):
        forget_caches()
        for b in batches:
            for first, data in pairs(b):
                shard = Shard.read(data)
                ends = shard.ends.select_each(np.arange(shard.ends.n))
                ids = shard.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield batch_of(schema, [np.full(len(crc), first), shard.doc_ids, ends[:-1], np.diff(ends), crc])

    rows = files.select("first_doc", "data").mapInArrow(documents, "first_doc long, doc_id long, own long, n_tokens long, ids_crc32 long")
    return rows.join(before, "first_doc").select("doc_id", (F.col("own") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' token files to the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "token-files")
    release_later(docs.sparkSession, path)
    write_token_files(docs, path, **options)
    return read_token_files(docs.sparkSession, path)
