import random

from pyspark.sql import functions as F

from lumenbase.operators.intervals import points_in_ranges, positions


def test_points_in_ranges_equal_a_nested_loop(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), rng.randrange(-50, 900), i) for i in range(400)] + [("a", None, 900)]
    ranges = [(rng.choice("abc"), low, low + rng.choice((0, 3, 70, 500, -1)), i) for i in range(60) for low in [rng.randrange(-60, 900)]]
    p, r = spark.createDataFrame(points, "g string, at int, p int"), spark.createDataFrame(ranges, "g string, low int, high int, r int")
    met = points_in_ranges(p, r, ["g"], "at", "low", "high")
    pairs = [(x[2], y[3]) for x in points for y in ranges if x[0] == y[0] and x[1] is not None and y[1] <= x[1] <= y[2]]
    assert sorted((x["p"], x["r"]) for x in met.collect()) == sorted(pairs) and met.columns == ["g", "at", "p", "low", "high", "r"]
    free = points_in_ranges(p, r, ["g"], "at", "low", "high", "left_anti", F.col("p.p") % 2 == F.col("r.r") % 2)
    assert sorted(x["p"] for x in free.collect()) == sorted(x[2] for x in points if not any(a == x[2] and b % 2 == x[2] % 2 for a, b in pairs))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "bin#" in plan.split("Join Inner,")[1].split("\n")[0]


def test_positions_in_a_total_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), rng.randrange(9), i) for i in range(500)]
    got = positions(spark.createDataFrame(rows, "a string, b int, c int").repartition(7), "a", F.desc("b"), "c").collect()
    assert [(r["a"], r["b"], r["c"]) for r in sorted(got, key=lambda r: r["position"])] == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    assert sorted(r["position"] for r in got) == list(range(1, 501))
    assert positions(spark.createDataFrame([], "a int"), "a").collect() == []
