"""Vector arithmetic as Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null where the lengths differ, as the longer side then has no partner."""
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(v: Column) -> Column:
    """Length 1; the zero vector becomes the first axis."""
    axis = F.transform(v, lambda x, i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(norm(v) == 0, axis).otherwise(F.transform(v, lambda x: x / F.nullif(norm(v), F.lit(0.0))))


def not_finite(v: Column) -> Column:
    """Whether a component is null, NaN or infinite."""
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def as_float32(v: Column) -> Column:
    """The vector after storage in single precision."""
    return v.cast("array<float>").cast("array<double>")


def literal(v: Column) -> Column:
    """Bracketed text form, each component in its shortest form that reads back exactly."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def parsed(text: Column) -> Column:
    return F.from_json(text, "array<double>")
