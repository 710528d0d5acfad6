"""A corpus from raw documents to token ids: five stages, each an operator of driftwell.llm.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each result to the
shared folder as Parquet and reads it as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwell.llm import jaccard, mixing, pieces, pii, quality
from driftwell.llm.common import Scratch, drop, free, gathered, merged, table, written

SMALL = 1_000_000  # rows of two numbers that may be broadcast


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from labelled rows of ``docs``."""
    docs = merged(docs)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    rated = quality.scored(docs, model, docs.columns)
    return rated.filter(F.col(rated.columns[-1]) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of n-gram Jaccard links: that with the least doc_id.

    Documents without an id, or without words, are in no group; each stays. Where rows share a doc_id, each
    of their texts is judged by itself, and of equal ones one row stays.
    """
    docs = merged(docs)
    with Scratch(spark) as scratch:
        linked = scratch.write(jaccard.links(docs, with_key=True).select("doc_id", "kept", "set_key"), "linked", read_later=True)
        ids = linked.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"), F.max("kept").alias("kept")).filter("kept or times > 1")
        ids = scratch.write(gathered(ids, linked.count()), "kept-ids", read_later=True)
        small = F.broadcast if ids.count() <= SMALL else lambda x: x  # a checked size: beyond it the join shuffles
        out = docs.join(small(ids.filter("times = 1").select("doc_id")), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
        if not (several := ids.filter("times > 1").select("doc_id")).isEmpty():
            key = free("set_key", docs.columns)
            rows = jaccard.keyed(docs.join(small(several), "doc_id", "left_semi").select(*docs.columns), key)
            kept = linked.filter("kept and set_key is not null").select("doc_id", F.col("set_key").alias(key)).join(several, "doc_id", "left_semi").distinct()
            chosen = rows.filter(F.col(key).isNotNull()).join(kept, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
            out = out.unionByName(chosen.unionByName(rows.filter(F.col(key).isNull())).select(*docs.columns))
        return out.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return pii.redact(merged(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights, one epoch at most, so that no copy comes back."""
    return mixing.drawn(merged(docs), mixing.Plan(epochs=1))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each text, with a check of the decoded text."""
    return pieces.tokenised(merged(docs))


STAGES = [("quality classifier", quality_filter), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data), ("source mix", source_mix), ("token ids", token_ids)]

ORACLE_SQL = None  # the classifier and the transducer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's result is removed once its successor's is written; the last one is read by the caller."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{i}")
        if before:
            drop(spark, before)
        before = path
    return docs
