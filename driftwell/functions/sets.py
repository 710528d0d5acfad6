"""Distances between sets of ids, as Column expressions. Null arrays count as empty; repeats collapse."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def union(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_union(a, b), F.array_distinct(a), F.array_distinct(b))


def jaccard_distance(a: Column, b: Column) -> Column:
    """0 for two empty sets, else one less the shared part of the union."""
    both, either = F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0)), F.size(union(a, b))
    return F.when(F.coalesce(either, F.lit(0)) <= 0, F.lit(0.0)).otherwise(1.0 - both / either)


def flip_rate(top_a: Column, top_b: Column, candidates: Column) -> Column:
    """Share of the candidates that are in exactly one of the two top lists; 0 without candidates."""
    own = F.array_distinct(candidates)
    inside = lambda top, x: F.coalesce(F.array_contains(top, x), F.lit(False))
    flips = F.size(F.filter(own, lambda x: inside(top_a, x) != inside(top_b, x)))
    return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, F.lit(0.0)).otherwise(flips / F.size(own))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted(components: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean of the components; weights of other names are ignored."""
    if not components:
        return F.lit(0.0)
    for name in components:
        if name not in weights:
            raise ValueError(f"no weight for {name}")
        if weights[name] < 0:
            raise ValueError(f"the weight of {name} is negative")
    total = sum(weights[n] for n in components)
    if total <= 0:
        raise ValueError("the weights add up to nothing")
    out = F.lit(0.0)
    for name, value in components.items():
        out = out + value * F.lit(float(weights[name]))
    return out / F.lit(float(total))
