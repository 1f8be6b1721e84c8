"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed number of tokens.

Best-fit decreasing looks at lengths only, and there are at most `size` of them. So the whole corpus is packed exactly as
one list would be, from its length histogram: documents of equal length are placed in runs, a segment tree over the
remaining capacities finds the tightest open bin in logarithmic time, and bins with equal contents are kept as one range
of numbers. The histogram, the tree and the placement runs depend on `size`, not on the number of documents. Documents
then find their place from their length and their rank among documents of that length.

Defined results: null text counts as empty, so each document has at least its end id; a document longer than `size` is cut
into pieces of `size` and a shorter last one; rows with a null id are left out and repeated ids count once (see
common.keyed); an empty table gives no rows."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.llm.common import batch_of, keyed, lasting, pairs, tokenizer_file
from lumenbase.llm.encoders import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a leaf holds the ranges of open bins with that much left."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.open = bytearray(2 * self.base)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def put(self, left: int, first: int, count: int) -> None:
        if count and left:
            self.bins[left].append((first, count))
            k = self.base + left
            while k and not self.open[k]:
                self.open[k] = 1
                k //= 2

    def take(self, left: int) -> tuple[int, int]:
        got = self.bins[left].pop()
        if not self.bins[left]:
            k = self.base + left
            self.open[k] = 0
            k //= 2
            while k:
                self.open[k] = self.open[2 * k] | self.open[2 * k + 1]
                k //= 2
        return got

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of an open bin that is at least `least`; -1 if none."""
        k = self.base + least
        while not self.open[k]:
            while k & 1:
                k //= 2
            if k <= 1:
                return -1
            k += 1
        while k < self.base:
            k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.base


def plan_bins(counts: dict[int, int], size: int) -> tuple[dict[int, list[tuple]], int]:
    """Runs of placements by length: (first rank, first bin, documents a bin, first offset); and the number of bins."""
    tree, bins, runs = CapacityTree(size), 0, {}
    for length in sorted(counts, reverse=True):
        todo, rank, here = counts[length], 0, []
        while todo:
            left = tree.tightest(length)
            if left < 0:
                left, first, n = size, bins, -(-todo // (size // length))
                bins += n
            else:
                first, n = tree.take(left)
            each = left // length
            full = min(n, todo // each)
            here.append((rank, first, each, size - left))
            tree.put(left - each * length, first, full)
            rest = min(todo - full * each, each) if full < n else 0
            if rest:
                tree.put(left - rest * length, first + full, 1)
            tree.put(left, first + full + bool(rest), n - full - bool(rest))
            rank += full * each + rest
            todo -= full * each + rest
        runs[length] = here
    return runs, bins


def token_pieces(docs: DataFrame, path: str, size: int, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """The documents' pieces, without a place."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        enc = encoder(path)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                ids += end
                rows += [(doc, k, k * size, min(size, len(ids) // 4 - k * size), zlib.crc32(ids[4 * k * size : 4 * (k + 1) * size])) for k in range(-(-len(ids) // (4 * size)))]
            yield batch_of(schema, [list(c) for c in zip(*rows, strict=True)] or [[]] * 5)

    return keyed(docs, id_col, text_col).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, rows_a_group: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. `tokenizer`: path of a file of the tokenizers library
    that drops white space.

    The rank among equal lengths is dealt in groups of about `rows_a_group` rows, so that no common length meets in one
    task; the groups' counts are the only thing summed in one place (lengths x groups numbers)."""
    spark = docs.sparkSession
    pieces = lasting(token_pieces(docs, tokenizer or tokenizer_file("word_bpe_49k.json"), size, id_col, text_col, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_bins(counts, size)
    plan = spark.sparkContext.broadcast({k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()})
    groups = max(1, min(4096, -(-max(counts.values(), default=1) // rows_a_group)))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, first, each, offset = plan.value[int(n)]
                k = np.searchsorted(ranks, rank[at], side="right") - 1
                more = rank[at] - ranks[k]
                seq[at], off[at] = first[k] + more // each[k], offset[k] + more % each[k] * n
            yield batch_of(schema, [*b.columns[:5], pa.array(seq), pa.array(off)])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def place_of(runs: dict[int, list[tuple]], length: int, rank: int) -> tuple[int, int]:
    """(bin, offset) of one document; what pack_documents does for many."""
    ranks, first, each, offset = runs[length][bisect_right(runs[length], rank, key=lambda r: r[0]) - 1]
    return first + (rank - ranks) // each, offset + (rank - ranks) % each * length
