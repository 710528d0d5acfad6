"""Drift between two sets of fingerprints, aligned by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftwell.functions import sets
from driftwell.operators import checks

WEIGHTS = {"stable_neighbor_distance": 0.4, "boundary_flip_rate": 0.4, "boundary_candidate_distance": 0.2}
LISTS = ("stable_neighbors", "boundary_candidates", "top_k_ids")


def per_query(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row for each query of either side: status and three distances, all 1 for a query without a partner.

    One full outer join aligns both sides. Null id lists count as empty.
    """
    side = lambda df, name: df.select("query_id", F.lit(True).alias(f"in_{name}"), *(F.col(c).alias(f"{name}_{c}") for c in LISTS))
    both = side(source, "source").join(side(target, "target"), "query_id", "full_outer")
    paired = F.col("in_source").isNotNull() & F.col("in_target").isNotNull()
    status = F.when(paired, "matched").when(F.col("in_target").isNull(), "missing_target").otherwise("missing_source")
    pair = lambda c: (F.col(f"source_{c}"), F.col(f"target_{c}"))
    full = lambda d: F.when(paired, d).otherwise(F.lit(1.0))
    return both.select(
        "query_id", status.alias("status"), full(sets.jaccard_distance(*pair("stable_neighbors"))).alias("stable_neighbor_distance"),
        full(sets.jaccard_distance(*pair("boundary_candidates"))).alias("boundary_candidate_distance"),
        full(sets.flip_rate(*pair("top_k_ids"), sets.union(*pair("boundary_candidates")))).alias("boundary_flip_rate"),
    )


def summarise(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: the means, their weighted distance, the consistency score and the counts. Without queries every distance is 1."""
    weights = weights or WEIGHTS
    checks.require(set(weights) <= set(WEIGHTS), f"weights may name {', '.join(WEIGHTS)} only")
    count = lambda s: F.count_if(F.col("status") == s)
    one = rows.agg(
        *(sets.clamp01(F.coalesce(F.avg(c), F.lit(1.0))).alias(c) for c in WEIGHTS),
        count("matched").alias("matched_query_count"), count("missing_source").alias("missing_source_query_count"), count("missing_target").alias("missing_target_query_count"),
    )
    gap = sets.clamp01(sets.weighted({c: F.col(c) for c in weights}, weights))
    return one.withColumn("fingerprint_distance", gap).withColumn("consistency_score", sets.clamp01(1.0 - F.col("fingerprint_distance"))).select(
        "consistency_score", "fingerprint_distance", "stable_neighbor_distance", "boundary_candidate_distance", "boundary_flip_rate", "matched_query_count", "missing_source_query_count", "missing_target_query_count",
    )


def compare(source: DataFrame, target: DataFrame, weights: dict[str, float] | None = None, check: bool = True) -> DataFrame:
    """The summary of two artifacts; with ``check``, a query id on two rows of one side is an error."""
    if check:
        checks.unique(source, "query_id")
        checks.unique(target, "query_id")
    return summarise(per_query(source, target), weights)
