"""Connected components by alternating large and small stars, between written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftwell.llm.common import drop, gathered, written


def _tied(edges: DataFrame, least: DataFrame, rows: int, name: str) -> tuple[DataFrame, str]:
    """Each row (u, v) of ``edges`` with the least node m known for u, as edges (v, m).

    ``least`` is written first: with two plain exchanges below it, Spark can split the rows of a
    hub among tasks, or broadcast the smaller side. Neither ``edges`` nor ``least`` has more than ``rows``.
    """
    spark = edges.sparkSession
    known, path = written(gathered(least, rows), f"{name}-least")
    tied = edges.join(known, "u").filter("v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).distinct()
    out, out_path = written(gathered(tied, rows), f"{name}-edges")
    drop(spark, path)
    return out, out_path


def _large(edges: DataFrame, rows: int, name: str) -> tuple[DataFrame, str]:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _tied(both.filter("v > u"), least, 2 * rows, name)  # each edge has two nodes


def _small(edges: DataFrame, rows: int, name: str) -> tuple[DataFrame, str]:
    """A node and its lesser neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    own = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("a").alias("u"), F.col("a").alias("v")).distinct())
    return _tied(own, least, 2 * rows, name)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b); the component is its least node.

    Edges to itself are ignored, repeated edges and either direction are alike, null ends are
    dropped. An empty table gives an empty one. Each step is written to the shared folder; the
    rounds grow with the logarithm of the longest path, not with the size of a component.
    """
    spark = edges.sparkSession
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = written(gathered(ordered, edges.count()), f"{name}-edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        wide, wide_path = _large(now, mark[0], name)
        after, next_path = _small(wide, mark[0], name)  # no more edges than before
        drop(spark, path)
        drop(spark, wide_path)
        now, path = after, next_path
    both = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    return gathered(both, 2 * mark[0])


class Forest:
    """Union-find over the numbers below n, for edges within one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
