"""What the vector operators share: matrices from Arrow lists, query blocks of a bounded size, and ordered best lists.

A query set is worked off in blocks of bounded size against all rows, row partition by row partition: vectors are never
shuffled for the scan, and a common vector makes no partition larger."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.llm.common import bound_batches, each_id_once


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding), one row per non-null id; of repeated ids the smallest non-null vector counts."""
    bound_batches(df.sparkSession)
    base = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(F.col("vec_id").isNotNull())
    return each_id_once(base, "vec_id", "embedding")


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the usable rows, their vectors as doubles, shorter ones padded with zeros). A row is usable if it is
    not null and all of its components are finite numbers."""
    there = np.flatnonzero(np.asarray(column.is_valid()))
    column = column.drop_null()
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    good = np.isfinite(out).all(1)
    return there[good], out[good]


def widened(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def query_blocks(vectors: DataFrame, chosen: Column, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The chosen rows' ids (ascending) and vectors, about `most` at a time, dealt by a hash of the id."""
    queries = vectors.where(chosen)
    blocks = -(-queries.count() // most)
    for k in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k) if blocks > 1 else queries
        got = mine.toArrow().combine_chunks()
        if not got.num_rows:
            continue
        ids = got.column("vec_id").to_numpy()
        column = got.column("embedding")
        at, x = matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        order = np.argsort(ids[at])
        if len(at):
            yield ids[at][order], x[order]


def best(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best entries: largest score first, ties to the smaller id."""
    order = np.lexsort((vec_id, -score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def candidates_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the k largest of each column, with all ties of the last."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        row, column = np.nonzero(scores >= bound)
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    return column, row


def top(entries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all partitions' entries."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
