import math

import pytest
from pyspark.sql import functions as F

from driftwell.functions import sets, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def ids(*names):
    return F.array(*map(F.lit, names)).cast("array<string>")


@pytest.mark.parametrize("a, b, want", [((), (), 0.0), (("a",), ("a",), 0.0), (("a",), ("b",), 1.0), (("x", "y", "z"), ("z", "w"), 0.75), (("a", "a", "b"), ("a", "b"), 0.0), (("a",), (), 1.0)])
def test_jaccard_distance(spark, a, b, want):
    assert value(spark, sets.jaccard_distance(ids(*a), ids(*b))) == pytest.approx(want)


def test_jaccard_of_nulls(spark):
    none = F.lit(None).cast("array<string>")
    assert value(spark, sets.jaccard_distance(none, none)) == 0.0
    assert value(spark, sets.jaccard_distance(none, ids("a"))) == 1.0


def test_flip_rate(spark):
    assert value(spark, sets.flip_rate(ids("k", "m", "p"), ids("m", "r"), ids("k", "m", "r", "s", "t"))) == 0.4
    assert value(spark, sets.flip_rate(ids("k"), ids("m"), ids())) == 0.0
    assert value(spark, sets.flip_rate(F.lit(None).cast("array<string>"), ids("b"), ids("b"))) == 1.0


def test_weighted(spark):
    two = {"x": F.lit(0.1), "y": F.lit(0.5)}
    assert value(spark, sets.weighted(two, {"x": 0.25, "y": 0.75, "z": 9})) == pytest.approx(0.4)
    assert value(spark, sets.weighted({}, {})) == 0.0
    for bad in ({"x": 1.0}, {"x": -1.0, "y": 2.0}, {"x": 0.0, "y": 0.0}):
        with pytest.raises(ValueError):
            sets.weighted(two, bad)


@pytest.mark.parametrize("x, want", [(-1.0, 0.0), (0.3, 0.3), (7.0, 1.0)])
def test_clamp(spark, x, want):
    assert value(spark, sets.clamp01(F.lit(x))) == want


def test_vector_arithmetic(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert value(spark, vectors.dot(v(1, 2), v(3, 4))) == 11 and value(spark, vectors.l2_distance(v(0, 0), v(3, 4))) == 5
    assert value(spark, vectors.cosine_similarity(v(1, 0), v(0, 1))) == 0 and value(spark, vectors.cosine_similarity(v(0, 0), v(0, 1))) is None
    assert value(spark, vectors.dot(v(1), v(1, 2))) is None
    assert value(spark, vectors.normalised(v(3, 4))) == [0.6, 0.8] and value(spark, vectors.normalised(v(0, 0))) == [1.0, 0.0]
    assert [value(spark, vectors.not_finite(v(1, x))) for x in (2, math.nan, math.inf, -math.inf)] == [False, True, True, True]
    assert value(spark, vectors.parsed(vectors.literal(v(1, 0.1, -2.5e-9)))) == [1.0, 0.1, -2.5e-9]
    assert value(spark, vectors.as_float32(v(0.1)))[0] == pytest.approx(0.1, abs=1e-8) and value(spark, vectors.as_float32(v(0.1)))[0] != 0.1
