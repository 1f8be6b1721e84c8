"""Embedding whitening from upper-triangle column aggregates.

Entries become whole numbers x = floor(64 * c) + 1000000, so that equal vectors are equal. The fit list, each distinct x
vector once, is written to the shared folder. Two aggregations over it give all there is to know: the sums of each dimension,
exact, and then, by generated SQL, the sum of the centred products of each pair of dimensions of the upper triangle, all in
one aggregation; tasks send one row of sums each, whatever they read. The driver gets that one row, assembles the covariance
and decomposes it with LAPACK. Rows are then whitened where they are, batch by batch, and the covariance of what the fit list
became is taken by the same two aggregations.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out, as are rows with a null id;
repeated ids count once (see vectors.vectors_of); a shorter vector counts as padded with zeros; an entry beyond 2**40 counts
as 2**40; a component whose eigenvalue is nothing beside the trace (1e-12 of it) has a null `whitened` and no part in the
identity error, and without variance `explained` is null too; a deviation beyond 64 bits is null; fewer dimensions than
components give as many components. No row left gives no rows."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbase.llm.common import batch_of, discard, materialize
from lumenbase.llm.vectors import vectors_of

SCALE, OFFSET, MOST = 64, 1_000_000, 2**40
WHITENED_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double"
WHITENED = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])


def usable(vector: Column) -> Column:
    """Not null, and every entry a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))


def whole(vector: Column, dims: int) -> Column:
    """x of a vector, `dims` entries long."""
    scaled = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long") + OFFSET)
    return F.concat(scaled, F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(dims) - F.size(vector)))


def sums(rows: DataFrame, columns: list[str]) -> tuple[int, list]:
    """(number of rows, sum of each column): whole numbers as such."""
    got = rows.selectExpr("count(1) AS n", *[f"sum({c}) AS s_{k}" for k, c in enumerate(columns)]).first()
    return got[0], [x or 0 for x in got[1:]]


def centred_products(rows: DataFrame, columns: list[str], means: list[float]) -> np.ndarray:
    """The matrix of the sums of (a - mean of a) * (b - mean of b): its upper triangle in one aggregation."""
    centred = rows.selectExpr(*[f"CAST({c} AS DOUBLE) - {m!r}D AS d_{k}" for k, (c, m) in enumerate(zip(columns, means, strict=True))])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = centred.selectExpr(*[f"sum(d_{i} * d_{j}) AS p_{i}_{j}" for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), value in zip(pairs, got, strict=True):
        out[i, j] = out[j, i] = value
    return out


class Whitener:
    """Components of the fit list: n, sums of the dimensions, unit eigenvectors (columns) and eigenvalues, falling."""

    def __init__(self, n: int, totals: list[int], covariance: np.ndarray, components: int):
        self.n, self.totals = n, totals
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors[:, order]
        self.vectors = self.vectors * np.where(np.take_along_axis(self.vectors, np.abs(self.vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
        self.trace = float(np.trace(covariance))
        self.real = self.values > 1e-12 * self.trace

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: whole numbers of 64 bits, or Python's where those might not do."""
        far = self.n * int(np.abs(x).max(initial=1)) + max(map(abs, self.totals))
        if far < 2**62:
            return self.n * x - np.array(self.totals, np.int64)
        return self.n * x.astype(object) - np.array(self.totals, object)

    def squared(self, d: np.ndarray) -> list[int | None]:
        """Of each row, the sum of squares, exactly; null beyond 64 bits."""
        if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 2**63:
            return (d * d).sum(1).tolist()
        return [s if s < 2**63 else None for s in ((d.astype(object) ** 2).sum(1)).tolist()]

    def whitened(self, d: np.ndarray) -> np.ndarray:
        """rows x components; NaN for components without variance."""
        with np.errstate(invalid="ignore", divide="ignore"):
            out = (d.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)
        out[:, ~self.real] = np.nan
        return out


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    spark = vectors.sparkSession
    rows = vectors_of(vectors, id_col, vector_col).where(usable(F.col("embedding")))
    none = spark.createDataFrame([], f"{WHITENED_DDL}, identity_error double")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    if not dims:
        return none
    rows = rows.select("vec_id", whole(F.col("embedding"), dims).alias("x"))
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    entries = [f"x[{k}]" for k in range(dims)]
    n, totals = sums(fit.select(F.col("x").cast("array<decimal(20,0)>").alias("x")), entries)
    totals = [int(s) for s in totals]
    model = Whitener(n, totals, centred_products(fit, entries, [float(Fraction(s, n)) for s in totals]) / n, components)
    shared = spark.sparkContext.broadcast(model)

    def projected(batches):
        for b in batches:
            y = shared.value.whitened(shared.value.deviations(rows_of(b.column(0), dims)))[:, shared.value.real]
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))], names=["y"])

    error = None
    if model.real.any():
        images, at = fit.mapInArrow(projected, "y array<double>"), [f"y[{k}]" for k in range(int(model.real.sum()))]
        means = [s / n for s in sums(images, at)[1]]
        error = float(np.abs(centred_products(images, at, means) / n - np.eye(len(at))).max())
    discard(fit)

    def apply(batches):
        m = shared.value
        size = len(m.values)
        explained = (m.values / m.trace).tolist() if m.trace > 0 else [None] * size
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                d = m.deviations(rows_of(part.column(1), dims))
                y, squares, count = m.whitened(d), m.squared(d), part.num_rows
                yield batch_of(
                    WHITENED,
                    [
                        np.repeat(part.column(0).to_numpy(), size), np.tile(np.arange(1, size + 1, dtype=np.int32), count), np.full(count * size, m.n),
                        pa.array(np.repeat(np.array(squares, object), size).tolist(), pa.int64()), pa.array(y.ravel(), pa.float64(), from_pandas=True), pa.array(explained * count, pa.float64()),
                    ],
                )

    return rows.mapInArrow(apply, WHITENED_DDL).withColumn("identity_error", F.lit(error).cast("double"))
