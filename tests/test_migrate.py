import math

import pytest
from pyspark.sql import functions as F

from driftwell.operators import checks, migrate
from driftwell.sources import collections, datasets


def records(spark, *rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], n) for n, (i, v) in enumerate(rows)], "id string, vector array<double>, ord int")


def test_upsert_and_replace(spark):
    old, new = records(spark, ("a", [1]), ("b", [2])), records(spark, ("b", [3]), ("c", [4]), ("b", [5]))
    assert sorted((r.id, r.vector) for r in migrate.upsert(old, new, "ord").collect()) == [("a", [1.0]), ("b", [5.0]), ("c", [4.0])]
    assert sorted((r.id, r.vector) for r in migrate.replace(new, "ord").collect()) == [("b", [5.0]), ("c", [4.0])]


@pytest.mark.parametrize("rows", [[("", [1, 2, 3])], [(None, [1, 2, 3])], [("a", [1, 2])], [("a", None)], [("a", [1, math.inf, 3])], [("a", [1, math.nan, 3])]])
def test_bad_records(spark, rows):
    with pytest.raises(ValueError):
        checks.records(records(spark, ("ok", [1, 2, 3]), *rows), 3)


def test_names_and_sizes(spark):
    assert checks.identifier("items_2") == "items_2"
    for bad in ("bad-name", "", "2x", "a b", "a\n"):
        with pytest.raises(ValueError):
            checks.identifier(bad)
    for bad in (0, 2001):
        with pytest.raises(ValueError):
            checks.dimension(bad)
    for bad in ((3, 4, 2, 2), (3, 2, 1, 1)):
        with pytest.raises(ValueError):
            checks.artifact_options(*bad)


@pytest.mark.parametrize("kind", ["path", "table"])
def test_collections(spark, tmp_path, kind):
    store = collections.opened(spark, str(tmp_path / "c") if kind == "path" else "items_test", single_precision=True)
    assert not store.exists()
    assert store.replace(records(spark, ("a", [0.1]), ("b", [2]))) == 2
    store.check()
    with pytest.raises(ValueError):
        type(store)(spark, getattr(store, "path", None) or store.name, vector_column="other").check()
    assert store.merge(records(spark, ("b", [3]), ("c", [4]), ("c", [5])), "ord") == 3
    rows = {r.id: r.vector[0] for r in store.read().collect()}
    assert rows == {"a": pytest.approx(0.1, abs=1e-8), "b": 3.0, "c": 5.0} and rows["a"] != 0.1 and store.count() == 3


def test_generator(spark):
    a, b = (datasets.generated(spark, 42, 4, 5).orderBy("id").collect() for _ in range(2))
    assert a == b and a[0].id == "vec-000001" and all(sum(x * x for x in r.vector) == pytest.approx(1) for r in a)
    assert datasets.generated(spark, 1, 2, 3, "l2", "query").filter("id = 'query-000003'").count() == 1
    many = datasets.generated(spark, 7, 4, 20_000, "l2").select(F.explode("vector").alias("x")).agg(F.avg("x"), F.stddev("x"), F.min("x"), F.max("x"), F.count_distinct("x")).head()
    assert abs(many[0]) < 0.02 and many[1] == pytest.approx(3**-0.5, abs=0.02) and -1 <= many[2] < -0.99 and 0.99 < many[3] < 1 and many[4] > 79_000
    axes = datasets.generated(spark, 7, 2, 20_000, "l2").select(F.corr(F.element_at("vector", 1), F.element_at("vector", 2))).head()[0]
    assert abs(axes) < 0.03
    for bad in ((0, 5), (2001, 5), (4, 0)):
        with pytest.raises(ValueError):
            datasets.generated(spark, 1, *bad)
    with pytest.raises(ValueError):
        datasets.generated(spark, 1, 2, 3, "ip")


def test_summary_ranges():
    assert checks.summary({"fingerprint_distance": 1.0, "matched_query_count": 3})
    for bad in ({"fingerprint_distance": 1.1}, {"fingerprint_distance": -0.1}, {"matched_query_count": -1}):
        with pytest.raises(ValueError):
            checks.summary(bad)
