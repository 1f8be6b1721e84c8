"""Joins of points with ranges by bins, and positions in a total order.

A range is put into every bin of `width` numbers that it touches, a point into its one bin; group and bin then join by
equality, and each pair of a point and a range that holds it is met once. What is compared beyond that shares a bin, not a
whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbase.sources.shared import kept

WIDTH = 32


def bin_of(point: Column, width: int = WIDTH) -> Column:
    return F.floor(point / width)


def in_bins(ranges: DataFrame, low: str, high: str, width: int = WIDTH) -> DataFrame:
    """The ranges with `bin`, a row for each that they touch; a range that ends before it begins touches none."""
    real = ranges.where(F.col(low) <= F.col(high))
    return real.withColumn("bin", F.explode(F.sequence(bin_of(F.col(low), width), bin_of(F.col(high), width))))


def points_in_ranges(points: DataFrame, ranges: DataFrame, by: list[str], point: str, low: str, high: str, how: str = "inner", where: Column | None = None) -> DataFrame:
    """Points joined with the ranges of their group that hold them: the columns of both, `by` once. how: inner or left_anti;
    where: a further condition. Beyond `by`, the two sides' columns have different names."""
    both = points.withColumn("bin", bin_of(F.col(point))).alias("p")
    other = in_bins(ranges, low, high).withColumnsRenamed({c: f"range_{c}" for c in (*by, "bin")}).alias("r")
    same = [F.col(f"p.{c}") == F.col(f"r.range_{c}") for c in (*by, "bin")]
    met = [*same, F.col(f"p.{point}").between(F.col(f"r.{low}"), F.col(f"r.{high}")), *([] if where is None else [where])]
    return both.join(other, reduce(Column.__and__, met), how).drop("bin", *[f"range_{c}" for c in (*by, "bin")])


def positions(rows: DataFrame, *order: Column | str) -> DataFrame:
    """With `position` from 1 in a total order of all rows. Rows are dealt into ranges of the order and sorted there; the
    driver adds up how many each partition holds, and no task sees more than its own. The sorted rows are written, so that
    counts and places are of one dealing."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    stored = kept(dealt, "ordered").withColumn("task", F.shiftright("at", 33))
    counts = sorted(map(tuple, stored.groupBy("task").count().collect()))  # a number for each partition
    before, so_far = {}, 0
    for task, n in counts:
        before[task] = so_far
        so_far += n
    starts = rows.sparkSession.createDataFrame(sorted(before.items()), "task long, before long")
    placed = stored.join(F.broadcast(starts), "task")
    return placed.withColumn("position", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("task", "at", "before")
