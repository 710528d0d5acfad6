import pytest

from driftwell.operators import compare, fingerprint, search
from driftwell.schemas import FINGERPRINT


def hits(spark, rows):
    """(query, id, rank[, score]) in input order."""
    return spark.createDataFrame([(r[0], r[1], r[2], float(r[3]) if len(r) > 3 else 0.0, i) for i, r in enumerate(rows)], "query_id string, id string, rank int, score double, input_pos int")


def prints(spark, *rows):
    return spark.createDataFrame([(q, list(s), list(b), list(t)) for q, s, b, t in rows], FINGERPRINT)


def test_sorted_and_unsorted_hits(spark):
    row = fingerprint.build(hits(spark, [("q", x, i + 1) for i, x in enumerate("abcde")]), 3, 2, 2).head()
    assert row[1:] == (["a", "b"], ["b", "c", "d", "e"], ["a", "b", "c"])
    row = fingerprint.build(hits(spark, [("q", "c", 3), ("q", "a", 1), ("q", "b", 2), ("q", "d", 4)]), 2, 1, 1).head()
    assert row[1:] == (["a"], ["b", "c"], ["a", "b"])


def test_places_not_rank_values(spark):
    row = fingerprint.build(hits(spark, [("q", "z", 5), ("q", "a", 5), ("q", "m", 90), ("q", "k", 200)]), 2, 1, 5).head()
    assert row[1:] == (["z"], ["z", "a", "m", "k"], ["z", "a"])  # equal ranks keep input order; the window is clipped


@pytest.mark.parametrize("options", [(0, 1, 1), (3, 4, 1), (3, 0, 1), (3, 1, 0)])
def test_options(spark, options):
    with pytest.raises(ValueError):
        fingerprint.build(hits(spark, [("q", "a", 1)]), *options)


@pytest.mark.parametrize("rows", [[("q", "a", 1)], [("q", "a", 1), ("q", "", 2)], [("q", "a", 0), ("q", "b", 1)], [("", "a", 1), ("", "b", 2)]])
def test_broken_hits(spark, rows):
    with pytest.raises(ValueError):
        fingerprint.build(hits(spark, rows), 2, 1, 1)


def test_score_delta(spark):
    five = hits(spark, [("q", f"n{i + 1}", i + 1, s) for i, s in enumerate((0.81, 0.74, 0.7, 0.693, 0.64))])
    assert sorted(r.id for r in fingerprint.score_delta(five, 3, 1, 0.06).collect()) == ["n2", "n3", "n4", "n5"]
    assert sorted(r.id for r in fingerprint.score_delta(five, 3, 2, 0.01).collect()) == ["n3", "n4"]
    assert fingerprint.score_delta(five.limit(0), 3, 1, 0.02).count() == 0
    with pytest.raises(ValueError):
        fingerprint.score_delta(five.limit(0), 0, 1, 0.02)
    with pytest.raises(Exception, match="no hit of rank 9"):
        fingerprint.score_delta(five, 9, 1, 0.02).collect()


def summary(source, target, **more):
    return compare.compare(source, target, **more).head().asDict()


def test_identical_and_changed(spark):
    a = prints(spark, ("q-1", "abc", "de", "abcd"))
    s = summary(a, a)
    assert s["consistency_score"] == 1 and s["fingerprint_distance"] == 0 and s["matched_query_count"] == 1
    s = summary(a, prints(spark, ("q-1", "abx", "df", "abxf")))
    assert (s["stable_neighbor_distance"], s["fingerprint_distance"], s["consistency_score"]) == pytest.approx((0.5, 0.6, 0.4))
    assert s["boundary_candidate_distance"] == pytest.approx(2 / 3) and s["boundary_flip_rate"] == pytest.approx(2 / 3)


def test_queries_without_a_partner(spark):
    s = summary(prints(spark, ("q-1", "a", "b", "ab")), prints(spark, ("q-2", "z", "y", "zy")))
    assert (s["matched_query_count"], s["missing_source_query_count"], s["missing_target_query_count"], s["fingerprint_distance"], s["consistency_score"]) == (0, 1, 1, 1, 0)
    s = summary(prints(spark, ("q-1", "a", "b", "ab"), ("q-2", "a", "b", "ab")), prints(spark, ("q-2", "a", "b", "ab")))
    assert s["fingerprint_distance"] == pytest.approx(0.5)
    assert summary(prints(spark), prints(spark))["fingerprint_distance"] == 1


def test_duplicates_nulls_and_weights(spark):
    a = prints(spark, ("q", "a", "b", "ab"))
    with pytest.raises(ValueError, match="duplicate"):
        compare.compare(a.union(a), a)
    empty = spark.createDataFrame([("q", None, None, None)], FINGERPRINT)
    assert summary(empty, empty)["fingerprint_distance"] == 0
    s = summary(a, prints(spark, ("q", "x", "b", "ab")), weights={"stable_neighbor_distance": 1.0, "boundary_flip_rate": 3.0})
    assert s["fingerprint_distance"] == pytest.approx(0.25)
    with pytest.raises(ValueError):
        compare.compare(a, a, {"curve": 1.0})


def test_precomputed_hits(spark):
    rows = hits(spark, [("q", "b", 2), ("q", "a", 1), ("q", "c", 3)])
    assert [r.id for r in search.precomputed(rows, 2).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        search.precomputed(rows, 4)
