"""Checks that raise ValueError: options on the driver, rows by one aggregate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from driftwell.functions import vectors
from driftwell.schemas import MAX_DIMENSION, METRICS


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def identifier(name: str, what: str = "identifier") -> str:
    """A name that can stand unquoted: letters, digits and underscores, no digit first."""
    require(bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or "")), f"{what} {name!r} is not a plain identifier")
    return name


def metric(name: str, allowed: tuple[str, ...] = METRICS) -> str:
    require(name in allowed, f"metric {name!r} is none of {', '.join(allowed)}")
    return name


def dimension(n: int) -> int:
    require(1 <= n <= MAX_DIMENSION, f"dimension {n} is outside 1..{MAX_DIMENSION}")
    return n


def fingerprint_options(top_k: int, stable_k: int, boundary_k: int) -> None:
    require(top_k > 0, "top_k must be above 0")
    require(0 < stable_k <= top_k, "stable_k must be above 0 and at most top_k")
    require(boundary_k > 0, "boundary_k must be above 0")


def search_options(top_k: int, expand_k: int) -> None:
    require(top_k > 0, "top_k must be above 0")
    require(expand_k >= top_k, "expand_k must be at least top_k")


def artifact_options(top_k: int, expand_k: int, stable_k: int, boundary_k: int) -> None:
    """What building an artifact from a search needs: hits on both sides of the cutoff."""
    search_options(top_k, expand_k)
    fingerprint_options(top_k, stable_k, boundary_k)
    require(expand_k >= top_k + boundary_k, "expand_k must be at least top_k + boundary_k")


def empty_id(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def violations(records: DataFrame, size: int) -> DataFrame:
    """Rows that break a rule, with the rule: empty id, wrong dimension or a component that is not finite."""
    v = vectors.doubles("vector")
    rule = F.when(empty_id("id"), "empty id").when(F.col("vector").isNull() | (F.size(v) != size), "dimension").when(vectors.not_finite(v), "not finite")
    return records.select("id", rule.alias("rule")).filter("rule is not null")


def records(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (id, vector) unchanged, once none breaks a rule."""
    dimension(size)
    found = violations(rows, size).orderBy("rule", F.col("id").cast("string")).head(1)
    require(not found, f"record {found[0]['id']!r}: {found[0]['rule']}" if found else "")
    return rows


def hits(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (query_id, id, rank) unchanged, once each query has ``least`` hits with ids and positive ranks."""
    one = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.coalesce(empty_id("id"), F.lit(True)).cast("int")).alias("blank"), F.min("rank").alias("low"))
    bad = F.when(empty_id("query_id"), "has no id").when(F.col("blank") == 1, "has a hit without id").when(F.col("low").isNull() | (F.col("low") <= 0), "has a rank below 1").when(F.col("n") < least, f"has fewer than {least} hits")
    found = one.select("query_id", bad.alias("rule")).filter("rule is not null").orderBy("query_id").head(1)
    require(not found, f"query {found[0]['query_id']!r} {found[0]['rule']}" if found else "")
    return rows


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys on more than one row, with their number of rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unique(rows: DataFrame, key: str) -> DataFrame:
    found = duplicates(rows, key).orderBy(key).head(1)
    require(not found, f"duplicate {key} {found[0][key]!r}" if found else "")
    return rows


def summary(row: dict) -> dict:
    """A comparison's row unchanged, once its distances lie in 0..1 and its counts are not negative."""
    for name, value in row.items():
        fine = value >= 0 if name.endswith("_count") else 0 <= value <= 1
        require(fine, f"{name} is {value}")
    return row
