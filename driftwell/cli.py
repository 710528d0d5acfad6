"""Command line: ``python -m driftwell.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession, functions as F

from driftwell.operators import search
from driftwell.plans import jobs
from driftwell.sources import artifacts, collections, datasets

VERSION = "0.1.0"


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftwell", description="Checks that a copy of a vector collection ranks as its source does.")
    top.add_argument("--version", action="version", version=f"driftwell {VERSION}")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **flags):
        p = commands.add_parser(name)
        for flag, default in flags.items():
            kind = type(default) if default is not None and not isinstance(default, bool) else str
            if isinstance(default, bool):
                p.add_argument(f"--{flag.replace('_', '-')}", action="store_true")
            else:
                p.add_argument(f"--{flag.replace('_', '-')}", type=kind, default=default, required=default is None)

    names = {"id_column": "id", "vector_column": "embedding"}
    ks = {"top_k": 3, "expand_k": 5, "metric": "cosine"}
    command("generate-synthetic-fixture", output=None, seed=42, dimension=8, records=100, queries=10, metric="cosine")
    command("offline-verify", fixture=None, artifact_dir=None)
    command("seed", fixture=None, collection=None, merge=False, single_precision=False, **names)
    command("search", fixture=None, collection=None, query_index=0, **ks, **names)
    command("build-artifact", fixture=None, collection=None, output=None, **ks, stable_k=2, boundary_k=1, **names)
    command("compare-artifacts", source=None, target=None, artifact_dir=None, job_id="artifact-compare")
    command("compare", source=None, target=None, output=None, job_id="compare")
    command("migrate", source=None, target=None, dimension=0, batch_size=100, single_precision=False, order_column="", **names)
    command("migrate-and-verify", fixture=None, source=None, target=None, dimension=0, artifact_dir=None, job_id="migrate-and-verify", single_precision=False, order_column="", **ks, stable_k=2, boundary_k=1, **names)
    return top


def _outcome(o: jobs.Outcome) -> list[tuple[str, object]]:
    s = o.summary
    score = [("job_id", o.job_id), ("state", o.state), ("consistency_score", f"{s['consistency_score']:.6f}"), ("fingerprint_distance", f"{s['fingerprint_distance']:.6f}")]
    counts = [("matched_queries", s["matched_query_count"]), ("missing_source_queries", s["missing_source_query_count"]), ("missing_target_queries", s["missing_target_query_count"])]
    return [*score, *counts, ("source_fingerprint", o.source_fingerprint), ("target_fingerprint", o.target_fingerprint), ("result", o.result)]


def run(spark: SparkSession, args: argparse.Namespace) -> list[tuple[str, object]]:
    """The command's summary as (name, value) lines."""
    a = args
    opened = lambda where: collections.opened(spark, where, id_column=a.id_column, vector_column=a.vector_column, single_precision=getattr(a, "single_precision", False), order_column=getattr(a, "order_column", ""))
    plain = lambda where: collections.opened(spark, where, id_column=a.id_column, vector_column=a.vector_column, single_precision=a.single_precision)
    if a.command == "generate-synthetic-fixture":
        return [("fixture", datasets.write(spark, a.output, a.seed, a.dimension, a.records, a.queries, a.metric))]
    if a.command == "offline-verify":
        return _outcome(jobs.offline_verify(spark, a.fixture, a.artifact_dir))
    if a.command == "seed":
        return [("collection", a.collection), ("seeded", jobs.seed(spark, a.fixture, opened(a.collection), not a.merge))]
    if a.command == "search":
        source, queries = opened(a.collection), datasets.queries(datasets.read(spark, a.fixture))
        ids = datasets.read(spark, a.fixture).select(F.size("queries")).head()[0]
        if not 0 <= a.query_index < ids:
            raise ValueError(f"query_index {a.query_index} is outside 0..{ids - 1}")
        wanted = datasets.read(spark, a.fixture).select(F.col("queries")[a.query_index]["id"]).head()[0]
        hits = search.exact_knn(queries.filter(F.col("id") == wanted), source.read(), a.metric, a.expand_k, a.top_k).orderBy("rank").collect()
        return [("count", source.count()), ("query", wanted), *((f"rank {h['rank']}", f"{h['id']} {h['score']:.6f}") for h in hits)]
    if a.command == "build-artifact":
        s = jobs.Settings(a.top_k, a.expand_k, a.stable_k, a.boundary_k, a.metric)
        return [("artifact", artifacts.write_fingerprints(jobs.fingerprints(datasets.queries(datasets.read(spark, a.fixture)), opened(a.collection).read(), s), a.output))]
    if a.command == "compare-artifacts":
        return _outcome(jobs.compare_artifacts(spark, a.source, a.target, a.artifact_dir, a.job_id))
    if a.command == "compare":
        from driftwell.operators.compare import compare

        summary = compare(*(artifacts.read_fingerprints(spark, p) for p in (a.source, a.target))).head().asDict()
        return [("output", artifacts.write_output(summary, a.output, a.job_id, spark)), ("consistency_score", f"{summary['consistency_score']:.6f}")]
    if a.command == "migrate":
        m = jobs.migrate(opened(a.source), plain(a.target), a.dimension, a.batch_size)
        return [("source", a.source), ("target", a.target), ("dimension", m.dimension), ("records_read", m.records_read), ("records_written", m.records_written)]
    s = jobs.Settings(a.top_k, a.expand_k, a.stable_k, a.boundary_k, a.metric)
    m, o = jobs.migrate_and_verify(spark, opened(a.source), plain(a.target), datasets.queries(datasets.read(spark, a.fixture)), a.artifact_dir, a.dimension, s, a.job_id)
    return [("source", a.source), ("target", a.target), ("dimension", m.dimension), ("records_read", m.records_read), ("records_written", m.records_written), *_outcome(o)]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("driftwell").getOrCreate()
    try:
        lines = run(spark, args)
    except (ValueError, PySparkException) as error:
        print(f"{args.command}: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    print(f"{args.command} completed")
    for name, value in lines:
        print(f"{name}: {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
