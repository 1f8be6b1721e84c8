import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbase.llm.ann import fit_quantiser, nearest, probed_cells, unit
from lumenbase.llm.topk import exact_top

DDL = "vec_id long, embedding array<float>, label int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9) for i, v in rows], DDL)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def exact(rows, every, k, scale=1024):
    ints = {i: [math.floor(scale * float(np.float32(x))) for x in v] for i, v in rows if usable(v)}
    out = []
    for q in sorted(i for i in ints if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def vectors(n, seed, dim=12):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return rows + [(n + i, list(rows[7][1])) for i in range(40)]  # one vector many times


@pytest.mark.parametrize("block", [16_384, 3])
def test_top_k_is_exact(spark, block):
    rows = vectors(260, 1)
    got = exact_top(table(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, 10, block=block)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == exact(rows, 20, 10)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-3.0]), (6, []), (7, [1.0, 2.0]), (None, [9.0, 9.0]), (7, [1.0, 2.0]), (10, [1e30, -1e30])]
    got = sorted(map(tuple, exact_top(table(spark, rows), F.col("vec_id").isin(0, 5), 10).collect()))
    huge = math.floor(1024 * float(np.float32(1e30)))
    assert [r for r in got if r[2] == 10] == [(0, 4, 10, max(-(2**63), 1024 * huge - 2048 * huge)), (5, 4, 10, -(2**63))]
    rows.pop()
    got = sorted(map(tuple, exact_top(table(spark, rows), F.col("vec_id").isin(0, 5), 10).collect()))
    one = 1024 * 1024
    assert got == [(0, 1, 7, 5 * one), (0, 2, 6, 0), (0, 3, 5, -3 * one), (5, 1, 6, 0), (5, 2, 0, -3 * one), (5, 3, 7, -3 * one)]
    assert exact_top(table(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    assert exact_top(table(spark, rows), F.col("vec_id") == 99).collect() == []


def cosines(rows, q):
    use = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if usable(v) and any(v)}
    return {i: float(use[q] @ v / math.sqrt((use[q] @ use[q]) * (v @ v))) for i, v in use.items() if i != q}


def test_recall_against_brute_force(spark):
    rows = vectors(1500, 2, 32)
    got = nearest(table(spark, rows).repartition(4), F.col("vec_id") % 50 == 0, 5, block=10).collect()
    hits = total = 0
    for q in {r["query_id"] for r in got}:
        want = cosines(rows, q)
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - want[r["vec_id"]]) < 1e-12 for r in mine)
        assert [r["vec_id"] for r in sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))] == [r["vec_id"] for r in mine]
        best = sorted(want, key=lambda i: (-want[i], i))[:5]
        hits += len({r["vec_id"] for r in mine} & set(best))
        total += 5
    assert hits >= 0.9 * total


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(400)]
    got = nearest(table(spark, rows).repartition(4), F.col("vec_id") == 100, 5).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]


def test_nearest_odd_rows(spark):
    rows = [(0, [3.0, 4.0]), (1, None), (2, [1.0, None]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (50, [1e-30, 0.0]), (51, [-3.0, -4.0]), (None, [1.0, 1.0])]
    got = sorted(map(tuple, nearest(table(spark, rows), F.col("vec_id") % 50 == 0, 5).collect()))
    assert [r[:3] for r in got] == [(0, 1, 50), (0, 2, 51), (50, 1, 0), (50, 2, 51)]
    assert [round(r[3], 9) for r in got] == [0.6, -1.0, 0.6, -0.6]
    assert nearest(table(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert nearest(table(spark, rows[1:5]), F.col("vec_id") % 2 == 0).collect() == []


def test_scores_of_the_largest_doubles(spark):
    rows = [(0, [1e306, 1.0]), (1, [-1e306, 2.0]), (2, [1e306, 1e306]), (3, [0.5, 0.25]), (4, [2.0**52, -1.0]), (5, [1.0, 1.0])]
    got = exact_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0, 10)
    ints = {i: [int(x) * 1024 if abs(x) > 1 else math.floor(1024 * x) for x in v] for i, v in rows}
    want = []
    for q in ints:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[q], v, strict=True)))), i) for i, v in ints.items() if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_visits_on_the_embeddings(spark, sf):
    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = nearest(table, F.col("vec_id") % 50 == 0).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows if usable(v) and any(v)}
    ids, all_of = np.array(sorted(x)), unit(np.stack([x[i] for i in sorted(x)]))[1]
    asked = np.flatnonzero(ids % 50 == 0)
    s = all_of[asked] @ all_of.T
    s[np.arange(len(asked)), asked] = -9
    best = {ids[q]: set(ids[np.lexsort((ids, -s[k]))[:5]]) for k, q in enumerate(asked)}
    assert len(got) == 5 * len(best) and sum(r["vec_id"] in best[r["query_id"]] for r in got) >= 0.9 * len(got)
    model = fit_quantiser(table.where("embedding is not null"), round(3 * len(ids) ** 0.5), 16, 16_384)
    cell = model.code(all_of)[0]
    scored = sum(len(q) * int((cell == c).sum()) for c, q in enumerate(probed_cells(model, all_of[asked], 0.55, np.bincount(cell, minlength=len(model.cells)), 161)))
    assert scored <= 0.65 * len(asked) * len(ids)


def test_clustered_rows_need_few_cells(spark):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(20, 16)) * 6
    rows = [(i, (middle[i % 20] + rng.normal(size=16)).tolist()) for i in range(1200)]
    frame = table(spark, rows).repartition(3)
    got = nearest(frame, F.col("vec_id") % 50 == 0, cells=20, probe=0.1).collect()
    want = {q: sorted(w, key=lambda i: (-w[i], i))[:5] for q in range(0, 1200, 50) for w in [cosines(rows, q)]}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= 0.9 * len(got) == 0.9 * 5 * 24
    model, x = fit_quantiser(frame, 20, 16, 16_384), unit(np.array([v for _, v in rows], np.float32).astype(float))[1]
    held = np.bincount(model.code(x)[0], minlength=20)
    assert sum(len(q) * n for q, n in zip(probed_cells(model, x[::50], 0.1, held, 161), held, strict=True)) <= 0.25 * 24 * 1200


def test_repeated_ids_count_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, None), (2, [0.0, 1.0])]
    assert [r["vec_id"] for r in nearest(table(spark, rows), F.col("vec_id") == 0, 5).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("kind", ["offset", "narrow clusters", "many dimensions"])
def test_recall_on_rows_that_lie_close_or_in_many_dimensions(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "offset":
        x = 1000 + rng.normal(size=(3000, 32))
    elif kind == "narrow clusters":
        x = rng.normal(size=(5, 32))[rng.integers(0, 5, 3000)] + 1e-3 * rng.normal(size=(3000, 32))
    else:
        x = rng.normal(size=(3000, 300))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = nearest(frame, F.col("vec_id") % 50 == 0).collect()
    x = unit(x)[1]
    asked = np.arange(0, 3000, 50)
    s = x[asked] @ x.T
    s[np.arange(60), asked] = -9
    best = {q: set(np.argsort(-s[j], kind="stable")[:5].tolist()) for j, q in enumerate(asked.tolist())}
    assert len(got) == 300 and sum(r["vec_id"] in best[r["query_id"]] for r in got) >= 0.95 * 300
