"""Vector search for batches of questions.

A batch of questions is a small frame with a `question_id`; every window and group carries that key. Questions are counted
once where they come in; beyond BATCH they are worked off in parts of that size, so what derives from a part (its terms, its
phrases, its best documents) is bounded and may be broadcast. Scores are rounded to six places before they order anything,
and ties go to the smaller (file_id, chunk_index)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACES = 6
SLACK = 10.0 ** (1 - PLACES)
KEY = ("file_id", "chunk_index")
PROSE, STRUCTURED = ("pdf", "docx"), ("xlsx",)
BATCH = 5_000


def by_batches(questions: DataFrame, work: Callable[[DataFrame], DataFrame], most: int = BATCH) -> DataFrame:
    """work(part) for parts of about `most` questions, each with a broadcast hint, put together."""
    parts = max(1, -(-questions.count() // most))
    share = [questions.where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [questions]
    return reduce(DataFrame.unionByName, [work(F.broadcast(q)) for q in share])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if one of the two has no direction."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def ranked(hits: DataFrame, score: str, top: int) -> DataFrame:
    """With a rank from 1, each question's `top` best."""
    order = Window.partitionBy("question_id").orderBy(F.desc(score), *KEY)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


class BestLists:
    """The best rows so far of each question of a batch: largest rounded score first, ties to the smaller key."""

    def __init__(self, asked: int, top: int):
        self.top, self.least = top, np.full(asked, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.most = 0, max(4 * top * asked, 1 << 16)

    def add(self, question: np.ndarray, score: np.ndarray, *key: np.ndarray) -> None:
        self.parts.append((question, score, *key))
        self.size += len(question)
        if self.size > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return ()
        question, score, *key = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((*key[::-1], -np.round(score, PLACES), question))
        q = question[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        order = order[np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < self.top]
        self.parts = [tuple(c[order] for c in (question, score, *key))]
        self.size = len(order)
        full = np.bincount(question[order], minlength=len(self.least)) >= self.top
        lowest = np.full(len(self.least), np.inf)
        np.minimum.at(lowest, question[order], score[order])
        self.least[full] = lowest[full]
        return self.parts[0]


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, directions) of an Arrow list column's rows that have one, all of the column's first length."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(-1))
    at = np.flatnonzero(sizes > 0)
    x = np.array(column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(len(at), -1) if len(at) else np.zeros((0, 0))
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], x[good] / norm[good, None]


def scored_blocks(rows: DataFrame, asked: pa.Table, top: int) -> DataFrame:
    """question_id, KEY, semantic_score: each task's `top` best rows for each question. A block of rows meets all questions as
    one product of matrices. The product over the first half of the dimensions comes first; by Cauchy-Schwarz the other half
    adds at most the product of the halves' norms, and rows that can't reach any question's list that way go no further."""
    ids, (places, q) = asked.column(0).to_numpy(), units(asked.column(1).combine_chunks())
    shared = rows.sparkSession.sparkContext.broadcast((ids[places], q))

    def best(batches):
        ids, q = shared.value
        half = q.shape[1] // 2
        rest = np.sqrt((q[:, half:] ** 2).sum(1))
        lists = BestLists(len(ids), top)
        for b in batches:
            at, x = units(b.column(2))
            if not len(at) or x.shape[1] != q.shape[1]:
                continue
            most = x[:, :half] @ q[:, :half].T + np.sqrt((x[:, half:] ** 2).sum(1))[:, None] * rest[None]
            able = np.flatnonzero((most >= lists.least[None] - SLACK).any(1))
            score = x[able] @ q.T
            row, question = np.nonzero(score >= lists.least[None] - SLACK)
            files = np.array(b.column(0).to_pylist(), dtype=str)
            lists.add(question, score[row, question], files[at[able[row]]], b.column(1).to_numpy()[at[able[row]]])
        found = lists.settle()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(found[2]), pa.array(found[3]), pa.array(found[1])], names=["question_id", *KEY, "semantic_score"])

    return rows.select(*KEY, "embedding").mapInArrow(best, "question_id long, file_id string, chunk_index long, semantic_score double")


def semantic_hits(vectors: DataFrame, questions: DataFrame, top: int = 100, file_types: tuple[str, ...] | None = PROSE) -> DataFrame:
    """question_id, file_id, chunk_index, semantic_score, distance, rank. vectors: KEY, file_type, embedding (all of one
    length); questions: question_id, vector. The file type is filtered before any arithmetic; exact, in place of an
    approximate index. A null or zero vector, or one of another length, is no hit. A batch of questions is collected as a
    matrix; no row is made for a pair that no task's best list holds."""
    rows = vectors if file_types is None else vectors.where(F.col("file_type").isin(*file_types))

    def hits(batch: DataFrame) -> DataFrame:
        found = scored_blocks(rows, batch.select(F.col("question_id").cast("long"), "vector").where("size(vector) > 0").toArrow(), top)
        return ranked(found.withColumn("semantic_score", F.round("semantic_score", PLACES)), "semantic_score", top)

    return by_batches(questions, hits).withColumn("distance", F.round(1 - F.col("semantic_score"), PLACES))


def approximate_hits(vectors: DataFrame, questions: DataFrame, top: int = 100, file_types: tuple[str, ...] | None = PROSE, tables: int = 8, width: float = 0.5, reach: float = 1.0, seed: int = 5) -> DataFrame:
    """semantic_hits() from an index of random projections (locality-sensitive hashing of the unit vectors): only rows that
    share a bucket of some table with the question and lie within `reach` of it are scored. More tables and wider buckets find
    more. Rows must have one length; a null or zero vector takes no part."""
    rows = vectors if file_types is None else vectors.where(F.col("file_type").isin(*file_types))

    def unit(df: DataFrame, column: str) -> DataFrame:
        c = F.col(column).cast("array<double>")
        norm = F.sqrt(dot(c, c))
        return df.where(norm > 0).withColumn("unit", array_to_vector(F.transform(c, lambda x: F.when(norm > 0, x).otherwise(0.0) / F.when(norm > 0, norm).otherwise(1.0))))

    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(unit(rows, "embedding"))
    near = model.approxSimilarityJoin(unit(rows, "embedding"), unit(questions.select("question_id", "vector"), "vector"), reach, "gap")
    score = F.round(1 - F.col("gap") * F.col("gap") / 2, PLACES)
    found = near.select("datasetB.question_id", *[f"datasetA.{c}" for c in (*KEY, "document")], score.alias("semantic_score"))
    return ranked(found, "semantic_score", top).withColumn("distance", F.round(1 - F.col("semantic_score"), PLACES))


def similarities(vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, KEY, similarity of every row of vectors with every question."""
    score = F.round(cosine(F.col("embedding"), F.col("vector")), PLACES)
    return by_batches(questions, lambda asked: vectors.join(asked.select("question_id", "vector"), F.size("embedding") == F.size("vector")).select("question_id", *KEY, score.alias("similarity")))
