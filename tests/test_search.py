import numpy as np
import pytest

from driftwell.operators import search


def table(spark, x, first=0):
    return spark.createDataFrame([(i + first, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>")


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_against_all_pairs(spark, metric):
    rng = np.random.default_rng(0)
    x, q = rng.integers(-9, 10, (700, 8)).astype(float), rng.integers(-9, 10, (15, 8)).astype(float)
    x[300:340] = x[7]  # ties
    got = search.exact_knn(table(spark, q), table(spark, x).repartition(7), metric, 9).collect()
    gaps = {"ip": -(q @ x.T), "l2": np.linalg.norm(q[:, None] - x, axis=2), "cosine": 1 - (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)}[metric].round(12)
    want = {(i, int(k), r + 1) for i in range(15) for r, k in enumerate(np.lexsort((np.arange(700), gaps[i]))[:9])}
    assert {(r.query_id, r.id, r["rank"]) for r in got} == want
    assert all(r.score == pytest.approx((1 - gaps[r.query_id, r.id]) if metric == "cosine" else -gaps[r.query_id, r.id]) for r in got)


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(50, 4))
    want = sorted(search.exact_knn(table(spark, x), table(spark, x), "l2", 3).collect())
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    assert sorted(search.exact_knn(table(spark, x), table(spark, x), "l2", 3).collect()) == want


def test_zero_and_missing_vectors(spark):
    corpus = table(spark, [[0, 0], None, [1, 0], [0, 1]])
    rows = search.exact_knn(table(spark, [[1, 0]]), corpus, "cosine", 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [(2, 1.0), (3, 0.0), (0, None)]
    assert search.exact_knn(table(spark, [[1, 0]]), corpus.limit(0), "cosine", 5).count() == 0
    assert search.exact_knn(table(spark, [[1, 0]]).limit(0), corpus, "cosine", 5).count() == 0


def test_faults(spark):
    q, x = table(spark, [[1, 0]]), table(spark, [[1, 0, 0]])
    with pytest.raises(Exception, match="dimension"):
        search.exact_knn(q, x, "l2", 1).collect()
    for bad in (("angle", 3, None), ("l2", 0, None), ("l2", 2, 3)):
        with pytest.raises(ValueError):
            search.exact_knn(q, q, *bad)


def test_plan_prunes_before_the_shuffle(spark):
    x = np.random.default_rng(1).normal(size=(5000, 4))
    corpus = table(spark, x).repartition(4).cache()
    q = table(spark, x[:10])
    found = search._candidates(corpus, list(range(10)), x[:10], "l2", 5)
    assert found.count() < 10 * 5 * 4 * 4
    plan = search.exact_knn(q, corpus, "l2", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
