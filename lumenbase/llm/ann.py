"""Approximate nearest neighbours by cosine: an inverted file of coarse centroids with product-quantised residuals.

The centroids and the codebooks are fitted on a bounded sample (`sample` rows, chosen by a hash of the id); every row is
indexed: its cell, the length of its residual, and one byte for each group of components of the residual's direction. A query
probes the cells whose centroids are nearest. The codes of a cell are scored for the queries that probe it, and for no others,
by asymmetric distances |q-c|^2 - 2 (q-c)r + |r|^2 with the residual r that its codes stand for; the best `rerank` are kept,
and those are scored again on the original vectors, in double precision. Lengths apart from directions, and differences from
the centroid in place of products, leave errors that shrink with the neighbourhood: rows in a narrow cone are told apart like
any others.

How many cells a query probes and how many rows it reranks is measured: up to TRIED of the queries are compared with all rows
on the original vectors, and the two bounds are such that each loses at most LOST of these true neighbours.

The index lies in the shared folder as rows (cell, vec_id, size, codes), sorted by cell within the partitions of the input, so a cell
that holds a third of all rows is spread like any other. Queries go over it in blocks of bounded size, dealt to their cells.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part; a shorter vector counts
as padded with zeros; a query is never its own neighbour; fewer candidates than k are all returned; rows with a null id are
left out and repeated ids count once (see vectors.vectors_of)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbase.llm.common import batch_of, lasting
from lumenbase.llm.vectors import best, matrix, query_blocks, top, vectors_of, widened

CODED = pa.schema([("cell", pa.int32()), ("vec_id", pa.int64()), ("size", pa.float64()), ("codes", pa.binary())])
NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
NEAR_DDL = "query_id long, vec_id long, score double"
AHEAD = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
TRIED, LOST = 256, 0.015
BOOK_ROWS = 4096


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows that are not zero, those scaled to length 1). Scaled by the largest component first, so that
    no square overflows or vanishes."""
    most = np.abs(x).max(1, initial=0)
    at = np.flatnonzero(most > 0)
    y = x[at] / most[at, None]
    return at, y / np.sqrt((y * y).sum(1, keepdims=True))


def centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; an empty cluster takes the row farthest from its centre."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        far = np.argsort(-(d[np.arange(len(x)), own] + (x * x).sum(1)))
        for j, i in zip(np.flatnonzero(n == 0), far, strict=False):
            c[j] = x[i]
    return c


@dataclass(frozen=True)
class Quantiser:
    cells: np.ndarray
    groups: list[np.ndarray]
    books: list[np.ndarray]

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and length of the residual of unit vectors."""
        cell = ((self.cells**2).sum(1) - 2 * x @ self.cells.T).argmin(1)
        way, size = directions(x - self.cells[cell])
        return cell, np.stack([((b * b).sum(1) - 2 * way[:, g] @ b.T).argmin(1).astype(np.uint8) for g, b in zip(self.groups, self.books, strict=True)], axis=1), size

    def decoded(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1) * size[:, None]


def directions(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals scaled to length 1, those without length left, and their lengths."""
    size = np.sqrt((rest * rest).sum(1))
    return rest / np.where(size > 0, size, 1)[:, None], size


def fit_quantiser(rows: DataFrame, cells: int, groups: int | None, sample: int, seed: int = 11) -> Quantiser | None:
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
    if not got.num_rows:
        return None
    column = got.column("embedding")
    _, x = matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    x = unit(x)[1]
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    c = centres(x, cells, rng)
    way = directions(x - c[((c * c).sum(1) - 2 * x @ c.T).argmin(1)])[0][:BOOK_ROWS]
    parts = [g for g in np.array_split(np.arange(x.shape[1]), groups or min(128, -(-x.shape[1] // 2))) if len(g)]
    return Quantiser(c, parts, [centres(way[:, g], 256, rng) for g in parts])


def build_index(rows: DataFrame, model: Quantiser) -> DataFrame:
    """cell, vec_id, size, codes of every usable row, written to the shared folder."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def code(batches):
        for b in batches:
            at, x = matrix(b.column(1))
            some, x = unit(x)
            x = widened(x, shared.value.dim)[:, : shared.value.dim]
            cell, codes, size = shared.value.code(x) if len(x) else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8), np.zeros(0))
            yield batch_of(CODED, [pa.array(cell.astype(np.int32)), b.column(0).to_numpy()[at[some]], size, [c.tobytes() for c in codes]])

    return lasting(rows.mapInArrow(code, "cell int, vec_id long, size double, codes binary").sortWithinPartitions("cell"), "ivf")


def cell_order(model: Quantiser, q: np.ndarray) -> np.ndarray:
    """All cells of each query, the nearest first."""
    return np.argsort((model.cells**2).sum(1)[None] - 2 * q @ model.cells.T, axis=1)


def probed_cells(model: Quantiser, q: np.ndarray, probe: float, held: np.ndarray, least: int) -> list[np.ndarray]:
    """Of each cell, the places of the queries that probe it: those to which it is among the nearest `probe` of all cells, or
    among the nearest that hold `least` rows between them. held: how many rows each cell holds."""
    order = cell_order(model, q)
    before = np.cumsum(held[order], axis=1) - held[order]
    query, place = np.nonzero((np.arange(order.shape[1]) < np.ceil(probe * order.shape[1])) | (before < least))
    cell = order[query, place]
    at = np.argsort(cell, kind="stable")
    return np.split(query[at], np.searchsorted(cell[at], np.arange(1, order.shape[1])))


def nearness(model: Quantiser, cell: int, rest: np.ndarray, size: np.ndarray, q: np.ndarray, reach: float) -> np.ndarray:
    """rows x queries: the negative asymmetric distances of one cell's rows. reach: the longest residual of the cell. Rounded
    far above what the order of a sum can change, so that equal rows score the same wherever they are."""
    off = q - model.cells[cell]
    far = (off * off).sum(1)
    score = 2 * rest @ off.T
    score -= (size * size)[:, None] + far[None]
    grain = np.exp2(np.ceil(np.log2(np.maximum(far + reach * reach, 1e-290))) - 40)
    return np.round(score / grain[None]) * grain[None]


def scored_cells(batches, model: Quantiser, q: np.ndarray, asking: list[np.ndarray], reach: np.ndarray):
    """(places of some of a cell's queries, ids of rows of that cell, rows x queries: nearness), until all are through."""
    for b in batches:
        cell, vec, size = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
        codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(vec), -1)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
        for at, to in zip(starts, [*starts[1:], len(cell)], strict=True):
            rest = model.decoded(codes[at:to], size[at:to]) if len(asking[cell[at]]) else None
            for mine in np.split(asking[cell[at]], range(512, len(asking[cell[at]]), 512)):
                if len(mine):
                    yield mine, vec[at:to], nearness(model, cell[at], rest, size[at:to], q[mine], reach[cell[at]])


class Lists:
    """The best entries so far of each query, and the score that a new one must reach."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.least = keep, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, max(4 * keep * queries, 1 << 16)

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """score: rows x queries; query: places of the queries."""
        row, column = np.nonzero(score >= self.least[query][None])
        self.parts.append((query[column], score[row, column].astype(np.float64), vec_id[row]))
        self.size += len(row)
        if self.size > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, vec_id = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        at = best(query, score, vec_id, self.keep)
        self.parts = [(query[at], score[at], vec_id[at])]
        self.size = len(at)
        full = np.bincount(query[at], minlength=len(self.least)) >= self.keep
        lowest = np.full(len(self.least), np.inf)
        np.minimum.at(lowest, query[at], score[at])
        self.least[full] = lowest[full]
        return self.parts[0]


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    dim = max(x.shape[1], q.shape[1])
    x, q = widened(x, dim), widened(q, dim)
    sx, sq = np.abs(x).max(1, keepdims=True), np.abs(q).max(1, keepdims=True)
    x, q = x / np.where(sx < 1e-100, sx, 1) / np.where(sx > 1e100, sx, 1), q / np.where(sq < 1e-100, sq, 1) / np.where(sq > 1e100, sq, 1)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))


def true_neighbours(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the queries, ids, unit vectors) of the k nearest of a few queries, by comparison with every row. Each task
    gives its own best; the rest is a handful of rows."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def compared(batches):
        ids, q = shared.value
        lists = Lists(len(ids), k)
        for b in batches:
            at, x = matrix(b.column(1))
            some, x = unit(x)
            dim = max(x.shape[1], q.shape[1])
            vec = b.column(0).to_numpy()[at[some]]
            score = widened(x, dim) @ widened(q, dim).T
            score[vec[:, None] == ids[None]] = -np.inf
            lists.add(np.arange(len(ids)), score, vec)
        query, score, vec = lists.settle()
        real = score > -np.inf
        yield batch_of(NEAR, [ids[query[real]], vec[real], score[real]])

    found = top(rows.mapInArrow(compared, NEAR_DDL), k).select("query_id", "vec_id")
    got = found.join(rows, "vec_id").select("query_id", "vec_id", "embedding").toArrow().combine_chunks()
    column = got.column("embedding")
    at, x = matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    some, x = unit(x)
    return np.searchsorted(ids, got.column("query_id").to_numpy()[at[some]]), got.column("vec_id").to_numpy()[at[some]], x


def reaching(needed: np.ndarray) -> float:
    """The bound that all but LOST of the measured needs keep to."""
    return float(np.sort(needed)[max(0, int(np.ceil((1 - LOST) * len(needed))) - 1)])


def measured(rows: DataFrame, index: DataFrame, model: Quantiser, held: np.ndarray, reach: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, probe: float | None, rerank: int) -> tuple[float, int]:
    """(probe, rerank): what finds the true neighbours of a sample of the queries; a given probe stays, and rerank is the least."""
    query, vec, x = true_neighbours(rows, ids, q, k)
    if not len(query):
        return probe or 1.0, rerank
    q = widened(q, model.dim)[:, : model.dim]
    cell, codes, size = model.code(widened(x, model.dim)[:, : model.dim])
    if probe is None:
        place = np.argsort(cell_order(model, q), axis=1)[query, cell]
        probe = (reaching(place) + 1) / len(model.cells)
    rest = model.decoded(codes, size)
    least = np.array([nearness(model, c, rest[i : i + 1], size[i : i + 1], q[p : p + 1], reach[c])[0, 0] for i, (c, p) in enumerate(zip(cell, query, strict=True))])
    shared = rows.sparkSession.sparkContext.broadcast((model, ids, q, query, vec, least, probed_cells(model, q, probe, held, rerank + 1), reach))

    def ahead(batches):
        model, ids, q, query, vec, least, asking, reach = shared.value
        n = np.zeros(len(query), np.int64)
        for mine, rows_, score in scored_cells(batches, model, q, asking, reach):
            column = np.full(len(ids), -1)
            column[mine] = np.arange(len(mine))
            pair = np.flatnonzero(column[query] >= 0)
            s = score[:, column[query[pair]]]
            before = (s > least[pair]) | ((s == least[pair]) & (rows_[:, None] < vec[pair]))
            n[pair] += (before & (rows_[:, None] != ids[query[pair]])).sum(0)
        yield batch_of(AHEAD, [np.arange(len(n)), n])

    counted = index.mapInArrow(ahead, "pair long, n long").groupBy("pair").sum("n").toArrow()
    return probe, max(rerank, int(reaching(counted.column(1).to_numpy())) + 1)


def nearest(vectors: DataFrame, chosen: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, probe: float | None = None, groups: int | None = None, rerank: int = 160, sample: int = 16_384, block: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each chosen row. `cells`: by default three times
    the root of the rows, 1024 at most; `probe`: the share of cells that a query probes, by default as measured; `rerank`: how
    many rows are scored again at least, more if the sample of queries needs them; `groups`: of components, by default pairs."""
    spark = vectors.sparkSession
    rows = vectors_of(vectors, id_col, vector_col)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells = cells or max(1, min(1024, round(3 * rows.count() ** 0.5)))
    model = fit_quantiser(rows, cells, groups, sample)
    if model is None:
        return none
    index = build_index(rows, model)
    shared_model = spark.sparkContext.broadcast(model)
    counts = index.groupBy("cell").agg(F.count(F.lit(1)), F.max("size")).toArrow()  # two numbers for each cell
    held = np.bincount(counts.column(0).to_numpy(), counts.column(1).to_numpy(), len(model.cells))
    reach = np.zeros(len(model.cells))
    reach[counts.column(0).to_numpy()] = counts.column(2).to_numpy()
    tried = rows.where(chosen).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIED)
    for ids, queries in query_blocks(tried, F.lit(True), TRIED):
        some, scaled = unit(queries)
        if len(some):
            probe, rerank = measured(rows, index, model, held, reach, ids[some], scaled, k, probe, rerank)
    probe, block = probe or 1.0, min(block, max(256, (1 << 21) // rerank))
    found = None
    for all_ids, all_queries in query_blocks(rows, chosen, block):
        some, scaled = unit(all_queries)
        if not len(some):
            continue
        shared = spark.sparkContext.broadcast((all_ids[some], all_queries[some], scaled))

        def probed(batches, shared=shared):
            model, (ids, _, q) = shared_model.value, shared.value
            q = widened(q, model.dim)[:, : model.dim]
            lists = Lists(len(ids), rerank)
            for mine, vec, score in scored_cells(batches, model, q, probed_cells(model, q, probe, held, rerank + 1), reach):
                score[vec[:, None] == ids[mine][None]] = -np.inf
                lists.add(mine, score, vec)
            query, score, vec = lists.settle()
            real = score > -np.inf
            yield batch_of(NEAR, [ids[query[real]], vec[real], score[real]])

        listed = top(index.mapInArrow(probed, NEAR_DDL), rerank).select("query_id", "vec_id")

        def again(batches, shared=shared):
            ids, queries, _ = shared.value
            for b in batches:
                at, x = matrix(b.column(2))
                query = b.column(0).to_numpy()[at]
                yield batch_of(NEAR, [query, b.column(1).to_numpy()[at], cosine(x, queries[np.searchsorted(ids, query)])])

        part = top(listed.join(rows, "vec_id").select("query_id", "vec_id", "embedding").mapInArrow(again, NEAR_DDL), k)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else none
