"""Copies of vector collections: validation, replacement and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from driftwell.functions import vectors
from driftwell.operators import checks


def stored(records: DataFrame, single_precision: bool = False) -> DataFrame:
    """(id, vector) as a store keeps them: doubles, or doubles that went through single precision."""
    v = vectors.doubles("vector")
    return records.withColumn("vector", vectors.as_float32(v) if single_precision else v)


def last_wins(records: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each id: that with the greatest ``order``. Without an order a repeated id is an error: no row of it is the last."""
    if order is None:
        return checks.unique(records, "id")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.col(order).desc()))
    return records.withColumn("_place", place).filter("_place = 1").drop("_place")


def upsert(target: DataFrame, records: DataFrame, order: str | None = None) -> DataFrame:
    """``target`` after ``records`` (id, vector) were written into it; rows of other ids stay."""
    new = last_wins(records, order).select("id", "vector")
    return target.select("id", "vector").join(new.select("id"), "id", "left_anti").unionByName(new)


def replace(records: DataFrame, order: str | None = None) -> DataFrame:
    """A collection that holds ``records`` alone."""
    return last_wins(records, order).select("id", "vector")


def migrate(source: DataFrame, target: DataFrame | None, dimension: int, single_precision: bool = False, order: str | None = None) -> DataFrame:
    """``target`` with the checked records of ``source``; None is an empty target."""
    checked = stored(checks.records(source, dimension), single_precision)
    return replace(checked, order) if target is None else upsert(target, checked, order)
