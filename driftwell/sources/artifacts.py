"""Fingerprint artifacts, offline fixtures and results as JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwell.operators import checks
from driftwell.schemas import ARTIFACT, OFFLINE
from driftwell.sources.files import is_file, write_json, write_text

#: Fixed names of the result document's metrics.
RESULT_NAMES = {
    "FingerprintDistance": "fingerprint_distance",
    "StableNeighborDistance": "stable_neighbor_distance",
    "BoundaryCandidateDistance": "boundary_candidate_distance",
    "BoundaryFlipRate": "boundary_flip_rate",
    "MatchedQueryCount": "matched_query_count",
    "MissingSourceQueryCount": "missing_source_query_count",
    "MissingTargetQueryCount": "missing_target_query_count",
}


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of an artifact; absent lists are empty, an artifact without any is an error."""
    checks.require(is_file(spark, path), f"{path!r} is not a file")
    document = spark.read.schema(ARTIFACT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = document.selectExpr("inline(fingerprints)")
    empty = F.array().cast("array<string>")
    rows = rows.select("query_id", *(F.coalesce(c, empty).alias(c) for c in rows.columns[1:]))
    checks.require(not rows.isEmpty(), f"{path!r} holds no fingerprints")
    return rows


def write_fingerprints(fingerprints: DataFrame, path: str) -> str:
    """One small document, queries in order of id. Larger sets stay tables: ``fingerprints.write``."""
    spark = fingerprints.sparkSession
    lists = [c for c in fingerprints.columns if c != "query_id"]
    rows = fingerprints.orderBy("query_id").select(F.col("query_id").cast("string").alias("query_id"), *(F.col(c).cast("array<string>") for c in lists)).collect()
    return write_json(spark, path, {"fingerprints": [r.asDict() for r in rows]})


def read_offline(spark: SparkSession, path: str) -> dict:
    """An offline fixture, checked: its settings, and source and target hits as DataFrames."""
    document = spark.read.schema(OFFLINE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = document.select("job_id", "top_k", "expand_k", "stable_k", "boundary_k", F.size(F.coalesce("queries", F.array().cast(OFFLINE["queries"].dataType))).alias("n")).head()
    checks.require(head is not None and bool(head["job_id"]), "the fixture has no job_id")
    checks.search_options(head["top_k"] or 0, head["expand_k"] or 0)
    checks.fingerprint_options(head["top_k"], head["stable_k"] or 0, head["boundary_k"] or 0)
    checks.require(head["n"] > 0, "the fixture has no queries")
    each = document.selectExpr("inline(queries)")
    checks.unique(each.select("query_id"), "query_id")
    sides = {}
    for side in ("source", "target"):
        none = F.array().cast(each.schema[f"{side}_hits"].dataType)
        short = each.filter(F.size(F.coalesce(f"{side}_hits", none)) < head["expand_k"]).select("query_id").head()
        checks.require(short is None, f"query {short[0] if short else ''!r} has fewer than expand_k {side} hits")
        sides[side] = each.select("query_id", F.posexplode(f"{side}_hits").alias("input_pos", "h")).select("query_id", "input_pos", "h.*")
    return {**head.asDict(), **sides}


def write_result(summary: dict, folder: str, job_id: str, spark: SparkSession, state: str = "SUCCEEDED") -> str:
    """The result document of a job in ``folder``."""
    checks.require(bool(job_id), "job_id must not be empty")
    checks.require(bool(folder), "the artifact folder must not be empty")
    metrics = {name: summary[column] for name, column in RESULT_NAMES.items()}
    return write_json(spark, f"{folder.rstrip('/')}/{job_id}-result.json", {"job_id": job_id, "state": state, "consistency_score": summary["consistency_score"], "metrics": metrics})


def write_output(summary: dict, path: str, job_id: str, spark: SparkSession) -> str:
    """The comparison alone, with column names as metric names."""
    metrics = {column: summary[column] for column in RESULT_NAMES.values()}
    return write_text(spark, path, json.dumps({"job_id": job_id, "consistency_score": summary["consistency_score"], "metrics": metrics}, indent=2) + "\n")
