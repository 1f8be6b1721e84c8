"""Exact top-k by the three-phase uniform threshold.

A score is the sum of `groups` local scores, one for each group of components. Phase 1 gathers the local score lists: of
each group, each partition's k best by that group alone; their whole scores give a cutoff, the k-th best whole score found,
that the true k-th best cannot fall below. Phase 2 broadcasts the cutoff: an entry matters only if one of its local scores
reaches cutoff / groups, for otherwise its whole score is below the cutoff; and of those, only if the local scores that
reach it, with cutoff / groups for each other one, can sum to the cutoff. Phase 3 resolves the remaining local scores of
the entries left, exactly, and keeps those at or above the cutoff.

Components are floor(1024 * x); scores are integers. Local sums are computed in doubles where they are certain to be exact,
and in Python integers for the vectors that are too large for that, up to the largest double; a score beyond 64 bits becomes
the nearest one within.

Defined results: vectors that are null or hold a null or non-finite component take no part; a shorter vector counts as
padded with zeros; a query is never its own candidate; fewer candidates than k are all returned; rows with a null id are
left out and repeated ids count once (see vectors.vectors_of); no query or no candidate gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbase.llm.common import batch_of
from lumenbase.llm.vectors import best, candidates_of, matrix, query_blocks, top, vectors_of, widened

ENTRIES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
ENTRIES_DDL = "query_id long, vec_id long, score long"


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as doubles, which hold them exactly up to 2**53; if one is larger, all as Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if not y.size or np.abs(y).max() < 2.0**53:
        return y
    return np.array([int(a) if np.isfinite(a) else int(b) * scale for a, b in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)], object).reshape(y.shape)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x times the transpose of q, exactly: rows and queries so large that a sum might leave 2**53 in Python integers."""
    bound = 2.0 ** ((53 - max(1, x.shape[1]).bit_length()) / 2)
    large = [(np.abs(m) >= bound).any(1) for m in (x, q)]
    if not large[0].any() and not large[1].any():
        return x.astype(float, copy=False).dot(q.astype(float, copy=False).T)
    out = np.empty((len(x), len(q)), object)
    whole = [np.array([[int(a) for a in row] for row in m.tolist()], object).reshape(m.shape) for m in (x, q)]
    for r in (False, True):
        for c in (False, True):
            at, of = np.flatnonzero(large[0] == r), np.flatnonzero(large[1] == c)
            part = whole[0][at].dot(whole[1][of].T) if r or c else x[at].astype(float).dot(q[of].astype(float).T).astype(np.int64).astype(object)
            out[np.ix_(at, of)] = part
    return out


def local_scores(x: np.ndarray, q: np.ndarray, groups: int) -> list[np.ndarray]:
    """rows x queries, for each group of components."""
    dim = max(x.shape[1], q.shape[1])
    x, q = widened(x, dim), widened(q, dim)
    local = [products(x[:, a], q[:, a]) for a in np.array_split(np.arange(dim), groups)]
    mixed = len({s.dtype for s in local}) > 1
    return [s.astype(np.int64).astype(object) if mixed and s.dtype != object else s for s in local]


def lowest(s: np.ndarray):
    """Below every score that isn't less than all of s."""
    return -np.inf if s.dtype != object else min(s.ravel(), default=0) - 1


def longs(scores: np.ndarray) -> np.ndarray:
    return scores.astype(np.int64) if scores.dtype != object else np.array([max(-(2**63), min(2**63 - 1, s)) for s in scores], np.int64)


def scanned(batch: pa.RecordBatch, ids: np.ndarray, queries: np.ndarray, groups: int, scale: int, rows: int = 1024, width: int = 512):
    """Tiles of local scores: (ids of rows, ids of queries, first query, local scores, which pairs are a query and itself)."""
    at, x = matrix(batch.column(1))
    vec = batch.column(0).to_numpy()[at]
    order = np.argsort(vec)
    vec, x = vec[order], whole_numbers(x[order], scale)
    for r in range(0, len(vec), rows):
        for c in range(0, len(ids), width):
            v, q = vec[r : r + rows], ids[c : c + width]
            yield v, q, c, local_scores(x[r : r + rows], queries[c : c + width], groups), v[:, None] == q[None]


def exact_top(vectors: DataFrame, chosen: Column, k: int = 10, groups: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products for each chosen row."""
    spark = vectors.sparkSession
    rows = vectors_of(vectors, id_col, vector_col)
    found = None
    for ids, queries in query_blocks(rows, chosen, block):
        shared = spark.sparkContext.broadcast((ids, whole_numbers(queries, scale)))

        def first_lists(batches, shared=shared):
            ids, queries = shared.value
            held = [np.zeros(0, np.int64)] * 3
            for b in batches:
                for vec, q, _, local, own in scanned(b, ids, queries, groups, scale):
                    listed = np.zeros(own.shape, bool)
                    for s in local:
                        column, row = candidates_of(np.where(own, lowest(s), s), k)
                        listed[row, column] = True
                    row, column = np.nonzero(listed & ~own)
                    new = q[column], longs(sum(s[row, column] for s in local)), vec[row]
                    held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                    keep = best(*held, k)
                    held = [x[keep] for x in held]
            yield batch_of(ENTRIES, [held[0], held[2], held[1]])

        lists = top(rows.mapInArrow(first_lists, ENTRIES_DDL), k)
        cut = lists.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("cutoff")).where(F.col("n") == k).select("query_id", "cutoff").toArrow()
        known = dict(zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True))
        cutoffs = spark.sparkContext.broadcast(np.array([known.get(q, -(2**63)) for q in ids.tolist()]))

        def resolved(batches, shared=shared, cutoffs=cutoffs):
            ids, queries = shared.value
            held = [np.zeros(0, np.int64)] * 3
            for b in batches:
                for vec, q, c, local, own in scanned(b, ids, queries, groups, scale):
                    cutoff = cutoffs.value[c : c + len(q)]
                    share = np.floor_divide(cutoff, groups) + (cutoff % groups != 0)  # the least whole number not below cutoff / groups
                    upper, reach = 0, np.zeros(own.shape, bool)
                    for s in local:
                        known_here = s >= share
                        reach |= known_here
                        upper = upper + np.where(known_here, s, share)
                    row, column = np.nonzero(reach & (upper >= cutoff) & ~own)
                    score = longs(sum(s[row, column] for s in local))
                    good = score >= cutoff[column]
                    new = q[column[good]], score[good], vec[row[good]]
                    held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                    keep = best(*held, k)
                    held = [x[keep] for x in held]
            yield batch_of(ENTRIES, [held[0], held[2], held[1]])

        part = top(rows.mapInArrow(resolved, ENTRIES_DDL), k)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
