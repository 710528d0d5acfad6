"""The record types that the library reads, computes and writes, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())
RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", VECTOR)])
HIT = T.StructType([T.StructField("id", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())])
DATASET = T.StructType([
    T.StructField("seed", T.LongType()), T.StructField("dimension", T.IntegerType()), T.StructField("record_count", T.IntegerType()), T.StructField("query_count", T.IntegerType()),
    T.StructField("metric", T.StringType()), T.StructField("records", T.ArrayType(RECORD)), T.StructField("queries", T.ArrayType(RECORD)),
])
OFFLINE = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("top_k", T.IntegerType()), T.StructField("expand_k", T.IntegerType()), T.StructField("stable_k", T.IntegerType()), T.StructField("boundary_k", T.IntegerType()),
    T.StructField("queries", T.ArrayType(T.StructType([T.StructField("query_id", T.StringType()), T.StructField("source_hits", T.ArrayType(HIT)), T.StructField("target_hits", T.ArrayType(HIT))]))),
])
FINGERPRINT = T.StructType([T.StructField("query_id", T.StringType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("stable_neighbors", "boundary_candidates", "top_k_ids"))])
ARTIFACT = T.StructType([T.StructField("fingerprints", T.ArrayType(FINGERPRINT))])

MAX_DIMENSION = 2000
METRICS = ("cosine", "l2", "ip")
