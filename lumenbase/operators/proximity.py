"""A stored proximity graph for approximate vector search.

Every row has edges to rows near it. Several trees split the rows into leaves; within a leaf all rows are compared as one product
of matrices, and each row keeps its nearest of all trees. A row's vector is moved once a tree, not once a pair.
A search starts at a few entry rows and goes on in rounds for all questions at once: the best rows not yet gone on from are
joined with the edges, rows that are new to the question are joined with their vectors and scored, until none of a question's
best rows is left to go on from. Scores are exact cosines; what is approximate is which rows are met. Nothing is held whole:
edges, vectors and what a search has met are tables, vectors lie by a hash of their id."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenbase.operators.search import PLACES, units
from lumenbase.sources.shared import kept

DEGREE, TREES, LEAF, ENTRIES, SAMPLE = 16, 12, 512, 64, 1 << 15
PAIR_DDL = "src long, dst long, score double"


@dataclass(frozen=True)
class ProximityGraph:
    """edges: src, dst, score; vectors: id, unit; entries: id, unit of at most ENTRIES rows."""

    edges: DataFrame
    vectors: DataFrame
    entries: DataFrame


def directions(vectors: DataFrame) -> DataFrame:
    """id, unit of the rows that have a direction. vectors: id, embedding, all of one length."""

    def scaled(batches):
        for b in batches:
            at, x = units(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))], names=["id", "unit"])

    return vectors.select("id", "embedding").mapInArrow(scaled, "id long, unit array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def split_trees(rows: DataFrame, n: int, trees: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, cuts): each level of a tree splits along the difference of two rows, each node at its median. A sample of
    about SAMPLE rows (by a hash of their ids) settles both; every row is then led through the trees. The direction after the
    last level orders the rows within a leaf."""
    parts = max(1, n // SAMPLE)
    x = matrix(rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)) == 0).select("unit").toArrow().column(0).combine_chunks())
    x = x if len(x) else matrix(rows.select("unit").limit(1).toArrow().column(0).combine_chunks())
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf)))), int(np.log2(len(x) / 8)) if len(x) >= 8 else 0))
    rng = np.random.default_rng(seed)
    lines = x[rng.integers(len(x), size=(trees, depth + 1))] - x[rng.integers(len(x), size=(trees, depth + 1))]
    lines += rng.normal(size=lines.shape) * 1e-3  # two equal rows have a direction too
    cuts = np.zeros((trees, 1 << depth))  # by node, the root is 1
    for t in range(trees):
        node = np.ones(len(x), np.int64)
        for level in range(depth):
            s = x @ lines[t, level]
            order = np.lexsort((s, node))
            names, first, size = np.unique(node[order], return_index=True, return_counts=True)
            cuts[t, names] = s[order[first + size // 2]]
            node = 2 * node + (s >= cuts[t, node])
    return lines, cuts


def block_edges(ids: np.ndarray, x: np.ndarray, degree: int) -> tuple[np.ndarray, ...]:
    """(dst, score, apart) of the nearest of each row of a block, by row. `apart` are those that no nearer one of the list is
    nearer to than the row itself: links that lead out of a group of copies."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    wide = min(2 * degree, len(x) - 1)
    best = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
    best = np.take_along_axis(best, np.lexsort((ids[best], -np.take_along_axis(s, best, 1)), axis=1), 1)
    score = np.take_along_axis(s, best, 1)
    apart = np.ones(best.shape, bool)
    for j in range(1, wide):
        apart[:, j] = ~(apart[:, :j] & (s[best[:, :j], best[:, j : j + 1]] >= score[:, j : j + 1])).any(1)
    return ids[best], score, apart


def leaf_edges(rows: DataFrame, degree: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """src, dst, score, apart: in each leaf of each tree the nearest rows of every row, both ways. A row travels once a tree;
    rows of a leaf lie side by side, and a task holds one block of them, of at most twice `leaf`."""
    spark, n = rows.sparkSession, rows.count()
    if not n:
        return spark.createDataFrame([], f"{PAIR_DDL}, apart boolean")
    shared = spark.sparkContext.broadcast(split_trees(rows, n, trees, leaf, seed))

    def placed(batches):
        lines, cuts = shared.value
        for b in batches:
            x = matrix(b.column(1)) if b.num_rows else np.zeros((0, lines.shape[2]))
            raw = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
            for t in range(len(lines)):
                s = x @ lines[t].T
                node = np.ones(len(x), np.int64)
                for level in range(s.shape[1] - 1):
                    node = 2 * node + (s[:, level] >= cuts[t, node])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(node), pa.array(s[:, -1]), b.column(0), raw], names=["tree", "leaf", "s", "id", "unit"])

    def linked(batches):
        def blocks():
            """(ids, rows) of a leaf, or of a part of one that has more than twice its due."""
            held = None
            for b in batches:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                held = yield from cut(held, False)
            if held is not None:
                yield from cut(held, True)

        def cut(held, last):
            at = np.stack([held.column(c).to_numpy() for c in ("tree", "leaf")])
            ends = np.r_[np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1, held.num_rows] if held.num_rows else np.zeros(0, int)
            start = 0
            for end in ends:
                open_ = end == held.num_rows and not last
                while end - start > 2 * leaf or (end > start and not open_):
                    size = end - start if end - start <= 2 * leaf else leaf
                    some = held.slice(start, size)
                    yield some.column("id").to_numpy(), np.frombuffer(b"".join(some.column("unit").to_pylist()), np.float32).reshape(size, -1)
                    start += size
            return held.slice(start)

        for ids, x in blocks():
            if len(ids) > 1:
                dst, score, apart = block_edges(ids, x, degree)
                keep = (np.arange(dst.shape[1]) < degree)[None] | (apart & (apart.cumsum(1) <= degree // 2))
                src = np.broadcast_to(ids[:, None], dst.shape)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst[keep]), pa.array(score[keep].astype(np.float64)), pa.array(apart[keep])], names=["src", "dst", "score", "apart"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * trees * (shared.value[0].shape[2] * 4 + 64) >> 26)
    laid = rows.mapInArrow(placed, "tree int, leaf long, s double, id long, unit binary").repartition(parts, "tree", "leaf")
    return laid.sortWithinPartitions("tree", "leaf", "s", "id").mapInArrow(linked, f"{PAIR_DDL}, apart boolean")


def write_graph(vectors: DataFrame, path: str, degree: int = DEGREE, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> None:
    """Write the graph of vectors (id, embedding) below `path`: of each row the `degree` nearest that share a leaf of some tree,
    half as many links out of its group, and the same links backwards. A row without a direction is in no graph."""
    spark = vectors.sparkSession
    directions(vectors).write.parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors")
    rows.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).write.parquet(f"{path}/entries")
    pairs = leaf_edges(rows, degree, trees, leaf, seed).groupBy("src", "dst").agg(F.max("score").alias("score"), F.max("apart").alias("apart"))
    order, out = Window.partitionBy("src").orderBy(F.desc("score"), "dst"), Window.partitionBy("src").orderBy(F.desc("apart"), F.desc("score"), "dst")
    near = pairs.withColumn("n", F.row_number().over(order)).withColumn("m", F.row_number().over(out))
    edges = kept(near.where((F.col("n") <= degree) | (F.col("apart") & (F.col("m") <= degree // 2))).select("src", "dst", "score", "apart"), "edges")
    back = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score", "apart"))
    back = back.groupBy("src", "dst").agg(F.max("score").alias("score"), F.max("apart").alias("apart"))
    back = back.withColumn("n", F.row_number().over(order)).withColumn("m", F.row_number().over(out))
    back.where((F.col("n") <= 2 * degree - degree // 2) | (F.col("apart") & (F.col("m") <= degree // 2))).select("src", "dst", "score").sortWithinPartitions("src").write.parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> ProximityGraph:
    edges = spark.read.schema(PAIR_DDL).parquet(f"{path}/edges")
    return ProximityGraph(edges, *(spark.read.schema("id long, unit array<double>").parquet(f"{path}/{t}") for t in ("vectors", "entries")))


def met_rows(graph: ProximityGraph, questions: DataFrame, beam: int = 48, width: int = 12, rounds: int = 24) -> DataFrame:
    """question_id, id, score of every row that a search meets. questions: question_id, vector; a bounded batch. In each round
    a question goes on from at most `width` of its `beam` best rows."""
    spark = questions.sparkSession
    asked = questions.select(F.col("question_id").cast("long"), "vector").where("size(vector) > 0").toArrow()
    at, q = units(asked.column(1).combine_chunks())
    shared = spark.sparkContext.broadcast((asked.column(0).to_numpy()[at], q))

    def score_all(batches):
        ids, q = shared.value
        for b in batches:
            s = (matrix(b.column(1)) @ q.T).ravel() if b.num_rows and len(ids) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, b.num_rows if len(s) else 0)), pa.array(np.repeat(b.column(0).to_numpy(), len(ids) if len(s) else 0)), pa.array(s)], names=["question_id", "id", "score"])

    def score_met(batches):
        ids, q = shared.value
        order = np.argsort(ids)
        for b in batches:
            which = order[np.searchsorted(ids[order], b.column(0).to_numpy())]
            s = (matrix(b.column(2)) * q[which]).sum(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["question_id", "id", "score"])

    ddl = "question_id long, id long, score double"
    met = kept(graph.entries.mapInArrow(score_all, ddl).withColumn("done", F.lit(False)), "met")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    for _ in range(rounds):
        best = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= beam).where(~F.col("done"))
        front = kept(best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= width).select("question_id", "id"), "front")
        if front.isEmpty():
            break
        steps = graph.edges.join(F.broadcast(front.withColumnRenamed("id", "src")), "src").select("question_id", F.col("dst").alias("id")).distinct()
        fresh = kept(steps.join(met, ["question_id", "id"], "left_anti"), "fresh")  # small, so that vectors stay in place
        fresh = graph.vectors.join(F.broadcast(fresh), "id").select("question_id", "id", "unit")
        went = met.join(F.broadcast(front.withColumn("went", F.lit(True))), ["question_id", "id"], "left")
        went = went.select("question_id", "id", "score", (F.col("done") | F.coalesce("went", F.lit(False))).alias("done"))
        met = kept(went.unionByName(fresh.mapInArrow(score_met, ddl).withColumn("done", F.lit(False))), "met")
    return met.drop("done")


def nearest(met: DataFrame, top: int = 10) -> DataFrame:
    """question_id, id, semantic_score, rank: the best of the rows met."""
    order = Window.partitionBy("question_id").orderBy(F.desc("semantic_score"), "id")
    rounded = met.select("question_id", "id", F.round("score", PLACES).alias("semantic_score"))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
