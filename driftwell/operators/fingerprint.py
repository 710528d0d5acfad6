"""Fingerprints of rankings: per query the stable neighbours, the top ids and the ids about the cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftwell.operators import checks

TOLERANCE = 1e-12  # for differences of scores that are equal in decimals


def positions(hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, pos): places from 1 in order of rank; equal ranks keep input_pos, else go by id."""
    order = [F.col("rank"), F.col("input_pos") if "input_pos" in hits.columns else F.col("id")]
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("pos", place).filter(F.col("pos") <= limit).select("query_id", "id", "pos")


def window_bounds(top_k: int, boundary_k: int) -> tuple[int, int]:
    """First and last place about the cutoff."""
    return max(top_k - boundary_k, 0) + 1, top_k + boundary_k


def build(hits: DataFrame, top_k: int, stable_k: int, boundary_k: int, check: bool = True, guard: bool = False) -> DataFrame:
    """(query_id, stable_neighbors, boundary_candidates, top_k_ids), by place and not by rank value.

    With ``check``, a query with fewer than ``top_k`` hits, an empty id or a rank below 1 is an error
    at once, which runs the plan of ``hits`` one time more. With ``guard``, for hits of a search, too
    few hits or an empty id fail when the query's row is computed.
    Each query keeps top_k + boundary_k places at most before its ids are gathered.
    """
    checks.fingerprint_options(top_k, stable_k, boundary_k)
    if check:
        checks.hits(hits, top_k)
    first, last = window_bounds(top_k, boundary_k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    rows = positions(hits, last).groupBy("query_id").agg(ids.alias("ids"))
    if guard:
        blank = F.exists("ids", lambda x: x.isNull() | (x.cast("string") == ""))
        fault = F.raise_error(F.concat(F.lit("query "), F.col("query_id").cast("string"), F.lit(f" has fewer than {top_k} hits or one without id")))
        rows = rows.withColumn("ids", F.when((F.size("ids") < top_k) | blank, fault.cast(rows.schema["ids"].dataType)).otherwise(F.col("ids")))
    return rows.select("query_id", F.slice("ids", 1, stable_k).alias("stable_neighbors"), F.slice("ids", first, last - first + 1).alias("boundary_candidates"), F.slice("ids", 1, top_k).alias("top_k_ids"))


def score_delta(hits: DataFrame, top_k: int, rank_before_k: int, delta: float, check: bool = True) -> DataFrame:
    """Hits (query_id, id, rank, score) whose score is within ``delta`` of the hit with rank ``top_k``.

    Ranks from top_k - rank_before_k on count, without an upper bound. With ``check``, a query
    without a hit of that rank is an error, else it has no rows; without hits there are none.
    """
    checks.require(top_k > 0, "top_k must be above 0")
    checks.require(rank_before_k >= 0, "rank_before_k must not be negative")
    checks.require(delta >= 0, "delta must not be negative")
    order = F.col("input_pos") if "input_pos" in hits.columns else F.col("id")
    cut = hits.filter(F.col("rank") == top_k).groupBy("query_id").agg(F.min_by("score", order).alias("cut"))
    if check:
        lost = hits.select("query_id").distinct().join(cut, "query_id", "left_anti").orderBy("query_id").head(1)
        checks.require(not lost, f"no hit of rank {top_k} in query {lost[0][0]!r}" if lost else "")
    near: Column = F.abs(F.col("score") - F.col("cut")) <= F.lit(delta + TOLERANCE)
    kept = hits.filter(F.col("rank") >= max(1, top_k - rank_before_k)).join(cut, "query_id")
    return kept.filter(near).select("query_id", "id", "rank", "score")
