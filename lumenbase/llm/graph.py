"""Connected components by alternating large-star and small-star contraction (Kiveris and others, 2014). Both steps are
joins with a minimum per node, so a hub's neighbours are never gathered in one place. A checked, small number of edges is
settled by union-find in one task instead."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbase.llm.common import batch_of, discard, materialize, pairs


def least_neighbour(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the least of them. Edges have u > v."""
    least = least_neighbour(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def by_one_task(edges: DataFrame) -> DataFrame:
    """The labels of a bounded number of edges, by union-find in a single task."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        up: dict[int, int] = {}

        def root(a: int) -> int:
            while up.setdefault(a, a) != a:
                up[a] = up[up[a]]
                a = up[a]
            return a

        for b in batches:
            for a, c in pairs(b):
                a, c = root(a), root(c)
                up[max(a, c)] = min(a, c)
        found = [(n, root(n)) for n in list(up)]
        yield batch_of(schema, [[n for n, r in found if n != r], [r for n, r in found if n != r]])

    return edges.coalesce(1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = 250_000) -> DataFrame:
    """u, v for every node with a smaller one in its component; v is the component's smallest node. `edges`: columns u, v
    in any order and with repeats; loops don't count. Up to `one_task` edges are settled by one task; more are contracted
    round by round on all of them."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    if edges.count() <= one_task:
        labels = materialize(by_one_task(edges), "edges")
        discard(edges)
        return labels
    before = summary(edges)
    for _ in range(most_rounds):
        edges, old = materialize(small_star(large_star(edges)), "edges"), edges
        discard(old)
        after = summary(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError("the components did not settle")
