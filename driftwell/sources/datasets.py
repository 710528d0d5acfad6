"""Vector datasets: a seeded generator, and JSON documents with records and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwell.functions import vectors
from driftwell.operators import checks
from driftwell.schemas import DATASET
from driftwell.sources.files import write_json

PRIME = 2147483647


def _noise(seed: int, kind: int, id_: Column, axis: Column) -> Column:
    """A number in [-1, 1) from seed, kind, id and axis alone: three quadratic rounds modulo a prime."""
    start = F.pmod(F.lit(seed * 1000003 + kind * 15485863 + 12345).cast("long") + id_ * 104729 + axis.cast("long") * 1299709, F.lit(PRIME).cast("long"))
    x = start
    for _ in range(3):
        x = F.pmod(x * x + start + 1013904223, F.lit(PRIME).cast("long"))
    return x.cast("double") / PRIME * 2.0 - 1.0


def generated(spark: SparkSession, seed: int, dimension: int, count: int, metric: str = "cosine", kind: str = "vec") -> DataFrame:
    """``count`` rows (id, vector), ids from ``kind``-000001; of length 1 for cosine. The same arguments give the same rows."""
    checks.dimension(dimension)
    checks.require(count > 0, "the number of rows must be above 0")
    checks.metric(metric, ("cosine", "l2"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: _noise(seed, 1 if kind == "vec" else 2, F.col("n"), i))
    rows = spark.range(1, count + 1).withColumnRenamed("id", "n").withColumn("raw", raw)
    return rows.select(F.format_string(f"{kind}-%06d", F.col("n")).alias("id"), (vectors.normalised(F.col("raw")) if metric == "cosine" else F.col("raw")).alias("vector"))


def write(spark: SparkSession, path: str, seed: int = 42, dimension: int = 8, records: int = 100, queries: int = 10, metric: str = "cosine") -> str:
    """One JSON document with records and queries. It passes through the driver: for small sets; larger ones stay tables."""
    rows = {k: [{"id": r["id"], "vector": list(r["vector"])} for r in generated(spark, seed, dimension, n, metric, kind).orderBy("id").collect()] for k, kind, n in (("records", "vec", records), ("queries", "query", queries))}
    return write_json(spark, path, {"seed": seed, "dimension": dimension, "record_count": records, "query_count": queries, "metric": metric, **rows})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The document as one row; nothing is checked."""
    return spark.read.schema(DATASET).option("multiLine", True).option("mode", "FAILFAST").json(path)


def records(dataset: DataFrame) -> DataFrame:
    """(pos, id, vector): the records and their places in the document."""
    return dataset.select(F.posexplode("records").alias("pos", "r")).select("pos", "r.*")


def queries(dataset: DataFrame) -> DataFrame:
    return dataset.selectExpr("inline(queries)")


def checked(dataset: DataFrame) -> DataFrame:
    """``dataset`` once its dimension fits all records and none breaks a rule."""
    size = dataset.select("dimension").head()
    checks.require(size is not None and size[0] is not None, "the dataset has no dimension")
    checks.records(records(dataset), size[0])
    return dataset
