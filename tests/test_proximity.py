import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbase.operators.proximity import met_rows, nearest, read_graph, write_graph


@pytest.mark.parametrize(("n", "share"), [(1500, 0.35), (6000, 0.1)])
def test_recall_and_visits(spark, tmp_path, n, share):
    """Rows on a surface of few dimensions within many, as embeddings of texts are."""
    rng = np.random.default_rng(n)
    x = np.tanh(rng.normal(size=(n, 6)) @ rng.normal(size=(6, 32))) + rng.normal(size=(n, 32)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * 32)]
    write_graph(spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4), str(tmp_path / "g"))
    graph = read_graph(spark, str(tmp_path / "g"))
    asked = list(range(0, n, n // 12))
    questions = spark.createDataFrame([(q, rows[q][1]) for q in asked], "question_id long, vector array<double>")
    met = met_rows(graph, questions)
    got = nearest(met, 10).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for k in asked:
        s = unit @ unit[k]
        best = set(np.argsort(-s)[:10].tolist())
        mine = [r for r in got if r["question_id"] == k]
        assert sorted(r["rank"] for r in mine) == list(range(1, 11)) and all(abs(r["semantic_score"] - s[r["id"]]) < 1e-5 for r in mine)
        hits += len(best & {r["id"] for r in mine})
    visits = met.groupBy("question_id").count().agg(F.avg("count")).first()[0] / n
    print(n, "recall", hits / len(got), "visits", visits)
    assert hits >= 0.9 * len(got) and visits < share


def test_few_rows_and_none(spark, tmp_path):
    write_graph(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, embedding array<float>"), str(tmp_path / "g"))
    questions = spark.createDataFrame([(7, [3.0, 3.0]), (8, [0.0, 0.0])], "question_id long, vector array<double>")
    got = nearest(met_rows(read_graph(spark, str(tmp_path / "g")), questions)).collect()
    assert sorted(map(tuple, got)) == [(7, 1, 0.707107, 1), (7, 2, 0.707107, 2)]
    write_graph(spark.createDataFrame([], "id long, embedding array<float>"), str(tmp_path / "none"))
    assert nearest(met_rows(read_graph(spark, str(tmp_path / "none")), questions)).collect() == []


def test_groups_of_copies_are_left_again(spark, tmp_path):
    """Each of 120 groups has more copies than a row has neighbours; links out of a group lead to the others."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(120, 16)), 30, axis=0) + rng.normal(size=(3600, 16)) * 0.01
    write_graph(spark.createDataFrame(list(enumerate(x.tolist())), "id long, embedding array<float>"), str(tmp_path / "g"))
    questions = spark.createDataFrame([(g, x[30 * g].tolist()) for g in range(0, 120, 4)], "question_id long, vector array<double>")
    got = nearest(met_rows(read_graph(spark, str(tmp_path / "g")), questions)).collect()
    assert sum(r["id"] // 30 == r["question_id"] for r in got) >= 0.9 * 300
