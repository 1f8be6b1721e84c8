import math
import os
import random

import numpy as np
import pytest

from lumenbase.llm.queries import op11_whitening
from lumenbase.llm.whitening import whiten

DDL = "vec_id long, embedding array<float>, component int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], DDL)


def by_force(rows, components=16):
    """The contract in numpy and Python's whole numbers; signs are left open. rows: (id, doubles)."""
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in good)
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in [*v, *[0.0] * (dims - len(v))]] for i, v in good}
    fit = sorted(set(map(tuple, x.values())))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = (n * np.array(fit, object) - np.array(total, object)).astype(float) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in x.items():
        d = [n * a - s for a, s in zip(v, total, strict=True)]
        out[i] = sum(a * a for a in d), np.array([a / n for a in d]) @ vectors / np.sqrt(values), values / np.trace(covariance)
    return n, out


def compared(got, rows, components=16):
    n, want = by_force(rows, components)
    mine = {}
    for r in got:
        mine.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(mine) == set(want)
    some = next(iter(want))
    size = len(want[some][1])
    signs = None
    for i, (deviation, y, explained) in want.items():
        rs = [mine[i][k] for k in range(1, size + 1)]
        assert len(mine[i]) == size and {r["n"] for r in rs} == {n} and {r["deviation"] for r in rs} == {deviation}
        assert np.allclose([r["explained"] for r in rs], explained, rtol=1e-9)
        z = np.array([r["whitened"] for r in rs])
        if signs is None and np.abs(y).min() > 1e-3:
            signs = np.sign(z) * np.sign(y)
    for i, (_, y, _) in want.items():
        assert np.allclose([mine[i][k]["whitened"] for k in range(1, size + 1)], y * signs, rtol=1e-6, atol=1e-8)
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("dim", [5, 20])
def test_whitening_equals_numpy(spark, dim):
    rng = random.Random(dim)
    rows = [(i, [rng.gauss(0, 1 + k / 3) for k in range(dim)]) for i in range(300)]
    rows += [(300 + i, list(rows[4][1])) for i in range(150)]  # one vector in a third of all rows
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * dim), (503, [float("-inf")] * dim), (504, [0.5, 0.25]), (505, []), (None, [1.0] * dim)]
    compared(whiten(table(spark, rows).repartition(5)).collect(), rows)


def test_fewer_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 2**k) for k in range(6)]) for i in range(200)]
    compared(whiten(table(spark, rows), components=3).collect(), rows, 3)


def test_dimensions_without_variance(spark):
    rows = [(0, [1.0, 5.0, 2.0]), (1, [2.0, 5.0, 2.0]), (2, [4.0, 5.0, 2.0]), (2, [4.0, 5.0, 2.0])]
    got = sorted(map(tuple, whiten(table(spark, rows)).collect()))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(i, k, 3, d) for i, d in ((0, 256**2), (1, 64**2), (2, 320**2)) for k in (1, 2, 3)]
    assert all((r[4] is None) == (r[1] > 1) for r in got) and abs(sum(r[4] for r in got if r[1] == 1)) < 1e-12
    assert got[0][5] == 1.0 and got[0][6] < 1e-12
    one = whiten(table(spark, rows[:1])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 3


def test_huge_entries(spark):
    rows = [(i, [1e38 if i == 3 else float(i), float(i * i)]) for i in range(9)]
    got = whiten(table(spark, rows)).collect()
    far = [r for r in got if r["vec_id"] == 3]
    total = sum((1 << 40 if i == 3 else 64 * i) + 1_000_000 for i in range(9))
    want = (9 * ((1 << 40) + 1_000_000) - total) ** 2
    assert want > 2**63 and {r["deviation"] for r in far} == {None} and got[0]["identity_error"] < 1e-4


def test_nothing_to_fit(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None), (2, [float("inf")]), (None, [1.0])])).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_whitening_of_the_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    compared(op11_whitening(spark, "/root/testdata/sf0.01").collect(), rows)
