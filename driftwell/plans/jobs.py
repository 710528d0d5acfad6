"""Whole jobs: one lazy plan from vectors or hits to one row of metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from driftwell.operators import checks, compare, fingerprint, search
from driftwell.plans.states import State
from driftwell.sources import artifacts, datasets
from driftwell.sources.collections import Collection


@dataclass(frozen=True)
class Outcome:
    job_id: str
    state: State
    summary: dict
    source_fingerprint: str = ""
    target_fingerprint: str = ""
    result: str = ""


@dataclass(frozen=True)
class Settings:
    top_k: int = 3
    expand_k: int = 5
    stable_k: int = 2
    boundary_k: int = 1
    metric: str = "cosine"

    def checked(self) -> Settings:
        checks.artifact_options(self.top_k, self.expand_k, self.stable_k, self.boundary_k)
        checks.metric(self.metric)
        return self


def fingerprints(queries: DataFrame, corpus: DataFrame, s: Settings, guard: bool = True) -> DataFrame:
    """Search and fingerprint of all queries in one plan; with ``guard``, too few hits are an error when it runs."""
    s.checked()
    hits = search.exact_knn(queries, corpus, s.metric, s.expand_k, s.top_k)
    return fingerprint.build(hits, s.top_k, s.stable_k, s.boundary_k, check=False, guard=guard)


def drift(queries: DataFrame, source: DataFrame, target: DataFrame, s: Settings, target_metric: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """The summary for two collections, without intermediate files."""
    other = Settings(s.top_k, s.expand_k, s.stable_k, s.boundary_k, target_metric or s.metric)
    return compare.summarise(compare.per_query(fingerprints(queries, source, s, False), fingerprints(queries, target, other, False)), weights)


def compare_artifacts(spark: SparkSession, source: str, target: str, folder: str, job_id: str = "artifact-compare") -> Outcome:
    """Compare two artifact documents and write the result. Both must come from the same settings."""
    checks.require(bool(job_id), "job_id must not be empty")
    checks.require(bool(folder), "the artifact folder must not be empty")
    sides = [artifacts.read_fingerprints(spark, p) for p in (source, target)]
    summary = checks.summary(compare.compare(*sides).head().asDict())
    return Outcome(job_id, State.SUCCEEDED, summary, source, target, artifacts.write_result(summary, folder, job_id, spark))


def offline_verify(spark: SparkSession, fixture: str, folder: str) -> Outcome:
    """Verify hits from a fixture: artifacts of both sides, then the comparison."""
    checks.require(bool(fixture), "the fixture's path must not be empty")
    checks.require(bool(folder), "the artifact folder must not be empty")
    f = artifacts.read_offline(spark, fixture)
    paths = []
    for side in ("source", "target"):
        hits = search.precomputed(f[side], f["expand_k"])
        built = fingerprint.build(hits, f["top_k"], f["stable_k"], f["boundary_k"])
        paths.append(artifacts.write_fingerprints(built, f"{folder.rstrip('/')}/{f['job_id']}-{side}-fingerprint.json"))
    return compare_artifacts(spark, *paths, folder, f["job_id"])


@dataclass(frozen=True)
class Moved:
    dimension: int
    records_read: int
    records_written: int


def migrate(source: Collection, target: Collection, dimension: int, batch_size: int = 100) -> Moved:
    """Upsert all rows of ``source`` into ``target`` once they are checked. Spark batches by itself; the size is only checked.

    Of rows that share an id the last in the source's order column stays; without that column they are an error.
    """
    checks.require(batch_size > 0, "batch_size must be above 0")
    source.check()
    rows = checks.records(source.records(), dimension)
    written = target.merge(rows, "pos" if "pos" in rows.columns else None)
    return Moved(dimension, written, written)


def migrate_and_verify(spark: SparkSession, source: Collection, target: Collection, queries: DataFrame, folder: str, dimension: int, s: Settings = Settings(), job_id: str = "migrate-and-verify") -> tuple[Moved, Outcome]:
    """Migration, an artifact of either collection, and their comparison; the first failure ends it."""
    s.checked()
    checks.require(bool(folder), "the artifact folder must not be empty")
    moved = migrate(source, target, dimension)
    paths = [artifacts.write_fingerprints(fingerprints(queries, c.read(), s), f"{folder.rstrip('/')}/{job_id}-{side}-fingerprint.json") for side, c in (("source", source), ("target", target))]
    return moved, compare_artifacts(spark, *paths, folder, job_id)


def seed(spark: SparkSession, dataset: str, target: Collection, replace: bool) -> int:
    """Rows of a dataset document written to ``target``: as its only rows, or merged into it. Of records that share an id the last stays."""
    rows = datasets.records(datasets.checked(datasets.read(spark, dataset)))
    return target.replace(rows, "pos") if replace else target.merge(rows, "pos")
