"""Every registered query of the library and the SQL that states the same rows.

Queries run on the whole tables of a folder. The query vectors of searches are those of
``embeddings`` whose id is divisible by 50 (EVERY), against all rows; where a comparison has queries
without a partner, one side has every other one of them. Rankings of customers by nation or region serve where no vectors are needed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwell.functions import sets, vectors
from driftwell.operators import checks, compare, fingerprint, migrate, search
from driftwell.plans import jobs
from driftwell.sources import artifacts, collections, datasets, files

TOP, EXPAND, STABLE, BOUND = 10, 12, 5, 2
EVERY, SOME, OTHERS = "id % 50 = 0", "id % 100 = 0", "id % 100 = 50"
S = jobs.Settings(TOP, EXPAND, STABLE, BOUND, "cosine")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.doubles("embedding").alias("vector"))


def _queries(spark: SparkSession, sf_dir: str, which: str = EVERY) -> DataFrame:
    return _corpus(spark, sf_dir).filter(which)


def _coarse(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("vector", F.transform("vector", lambda x: F.floor(x * 8).cast("double") / 8))


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def _hits(metric: str):
    def run(spark, sf_dir):
        hits = search.exact_knn(_queries(spark, sf_dir), _corpus(spark, sf_dir), metric, EXPAND, TOP)
        return _rounded(hits.withColumn("rank", F.col("rank").cast("long")), "score")

    return run


def _single(spark, sf_dir):
    one = _queries(spark, sf_dir, "id = 50")
    return _rounded(search.exact_knn(one, _corpus(spark, sf_dir), "cosine", 5).withColumn("rank", F.col("rank").cast("long")), "score")


def _prints(spark, sf_dir, coarse: bool = False, metric: str = "cosine", which: str = EVERY, corpus: DataFrame | None = None) -> DataFrame:
    rows = _corpus(spark, sf_dir) if corpus is None else corpus
    return jobs.fingerprints(_queries(spark, sf_dir, which), _coarse(rows) if coarse else rows, jobs.Settings(TOP, EXPAND, STABLE, BOUND, metric), guard=False)


def _listed(column: str):
    def run(spark, sf_dir):
        return _prints(spark, sf_dir).select("query_id", F.posexplode(column).alias("pos", "id")).withColumn("pos", F.col("pos").cast("long") + 1)

    return run


def _delta(spark, sf_dir):
    hits = search.exact_knn(_queries(spark, sf_dir), _corpus(spark, sf_dir), "cosine", EXPAND, TOP)
    return _rounded(fingerprint.score_delta(hits, TOP, 3, 0.02, check=False).withColumn("rank", F.col("rank").cast("long")), "score")


_DISTANCES = ("stable_neighbor_distance", "boundary_candidate_distance", "boundary_flip_rate")
_SUMMARY = ("consistency_score", "fingerprint_distance", *_DISTANCES)


def _each(spark, sf_dir) -> DataFrame:
    return compare.per_query(_prints(spark, sf_dir), _prints(spark, sf_dir, coarse=True))


def _one(column: str):
    return lambda spark, sf_dir: _rounded(_each(spark, sf_dir).select("query_id", column), column)


def _summary(source: dict, target: dict, weights: dict | None = None):
    def run(spark, sf_dir):
        made = [_prints(spark, sf_dir, **{k: v(spark, sf_dir) if callable(v) else v for k, v in own.items()}) for own in (source, target)]
        return _rounded(compare.compare(*made, weights, check=False), *_SUMMARY)

    return run


def _disjoint(spark, sf_dir):
    target = _prints(spark, sf_dir, coarse=True).withColumn("query_id", F.col("query_id") + 1000000)
    return _rounded(compare.compare(_prints(spark, sf_dir), target, check=False), *_SUMMARY)


def _customers(spark, sf_dir, by: str) -> DataFrame:
    """Customers with the nation or region that their ranking belongs to."""
    c = _table(spark, sf_dir, "customer")
    if by == "nation":
        return c.withColumn("query_id", F.col("c_nationkey"))
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("query_id"))
    return c.join(F.broadcast(nations), "c_nationkey")  # the 25 nations


def _by_balance(spark, sf_dir, by: str = "nation") -> DataFrame:
    rows = _customers(spark, sf_dir, by).select("query_id", F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return search.ranked(rows, [F.col("score").desc_nulls_last(), F.col("id")], EXPAND)


def _by_orders(spark, sf_dir, by: str = "nation") -> DataFrame:
    """Orders are summed by customer before the join."""
    spent = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("spent"))
    c = _customers(spark, sf_dir, by).join(spent, F.col("c_custkey") == F.col("o_custkey"))
    rows = c.select("query_id", F.col("c_custkey").alias("id"), F.col("spent").cast("double").alias("score"))
    return search.ranked(rows, [F.col("score").desc_nulls_last(), F.col("id")], EXPAND)


def _precomputed(spark, sf_dir):
    hits = search.precomputed(_by_balance(spark, sf_dir), TOP, whole=False)
    return _rounded(hits.withColumn("rank", F.col("rank").cast("long")), "score")


def _nations(spark, sf_dir):
    made = [fingerprint.build(h(spark, sf_dir), TOP, STABLE, BOUND, check=False) for h in (_by_balance, _by_orders)]
    return _rounded(compare.per_query(*made), *_DISTANCES)


_OWN_WEIGHTS = {"stable_neighbor_distance": 1.0, "boundary_flip_rate": 3.0}


def _weighted(spark, sf_dir):
    rows = _each(spark, sf_dir)
    return _rounded(rows.select("query_id", sets.weighted({c: F.col(c) for c in _OWN_WEIGHTS}, _OWN_WEIGHTS).alias("distance")), "distance")


def _moved(spark, sf_dir) -> DataFrame:
    """Records to write: every vector, coarse and under its own id; those with even ids once more, later, negated; and each once more under a new id."""
    rows = _corpus(spark, sf_dir)
    again = rows.filter("id % 2 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    new = rows.withColumn("id", -F.col("id") - 1)
    return _coarse(rows).withColumn("ord", F.lit(1)).unionByName(again.withColumn("ord", F.lit(2))).unionByName(new.withColumn("ord", F.lit(1)))


def _flat(rows: DataFrame) -> DataFrame:
    """A vector as two numbers that any engine computes alike."""
    return rows.select("id", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(vectors.norm(F.col("vector")), 6).alias("norm"))


def _upsert(spark, sf_dir):
    """Into all vectors; what it leaves of the target alone are the records without an odd id of their own."""
    return _flat(migrate.upsert(_corpus(spark, sf_dir), _moved(spark, sf_dir).filter("id < 0 or ord = 2"), "ord"))


def _replace(spark, sf_dir):
    return _flat(migrate.replace(_moved(spark, sf_dir), "ord"))


def _collections(spark, sf_dir):
    """The way users take: records with repeated ids from one collection to another, in the source's order."""
    folder = files.shared_folder(spark)
    source, target = (collections.ParquetCollection(spark, f"{folder}/{n}", order_column=o) for n, o in (("source", "ord"), ("target", "")))
    target.replace(_corpus(spark, sf_dir))
    _moved(spark, sf_dir).withColumnRenamed("vector", "embedding").write.parquet(source.path)
    jobs.migrate(source, target, 64)
    return _flat(target.read())


def _document(spark, repeats: int = 0) -> str:
    """A dataset document of 100 records; the first ``repeats`` come again at the end, negated."""
    path = datasets.write(spark, f"{files.shared_folder(spark)}/set.json", 42, 8, 100, 10, "l2")
    if repeats:
        held = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small document
        held["records"] += [{"id": r["id"], "vector": [-x for x in r["vector"]]} for r in held["records"][:repeats]]
        files.write_json(spark, path, held)
    return path


def _axes(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.posexplode("vector").alias("axis", "x")).select("id", F.col("axis").cast("long").alias("axis"), F.round("x", 6).alias("x"))


def _dataset(spark, sf_dir):
    return _axes(datasets.records(datasets.checked(datasets.read(spark, _document(spark)))))


def _seeded(spark, sf_dir):
    """A dataset document, whose first 40 records come twice, merged into a collection that holds its first state."""
    target = collections.ParquetCollection(spark, f"{files.shared_folder(spark)}/items")
    jobs.seed(spark, _document(spark), target, True)
    jobs.seed(spark, _document(spark, 40), target, False)
    return _axes(target.read())


def _artifact(spark, sf_dir) -> tuple[str, str, str]:
    """Two artifacts of the regions' rankings, and their folder."""
    folder = files.shared_folder(spark)
    paths = [artifacts.write_fingerprints(fingerprint.build(h(spark, sf_dir, "region"), TOP, STABLE, BOUND, check=False), f"{folder}/{n}.json") for n, h in (("source", _by_balance), ("target", _by_orders))]
    return *paths, folder


def _artifact_rows(spark, sf_dir):
    rows = artifacts.read_fingerprints(spark, _artifact(spark, sf_dir)[0])
    parts = [rows.select("query_id", F.lit(c).alias("list"), F.posexplode(c).alias("pos", "id")) for c in ("stable_neighbors", "boundary_candidates", "top_k_ids")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("pos", F.col("pos").cast("long") + 1)


_METRICS = ("fingerprint_distance", *_DISTANCES, "matched_query_count", "missing_source_query_count", "missing_target_query_count")


def _document_row(spark, path: str, names: dict[str, str]) -> DataFrame:
    kinds = ", ".join(f"{n} {'long' if n.lower().endswith('count') else 'double'}" for n in names)
    row = spark.read.schema(f"job_id string, consistency_score double, metrics struct<{kinds}>").option("multiLine", True).json(path)
    return _rounded(row.select("job_id", "consistency_score", *(F.col(f"metrics.{n}").alias(c) for n, c in names.items())), "consistency_score", "fingerprint_distance", *_DISTANCES)


def _result(spark, sf_dir):
    source, target, folder = _artifact(spark, sf_dir)
    return _document_row(spark, jobs.compare_artifacts(spark, source, target, folder, "regions").result, artifacts.RESULT_NAMES)


def _output(spark, sf_dir):
    source, target, folder = _artifact(spark, sf_dir)
    summary = compare.compare(*(artifacts.read_fingerprints(spark, p) for p in (source, target))).head().asDict()
    return _document_row(spark, artifacts.write_output(summary, f"{folder}/out.json", "regions", spark), {c: c for c in _METRICS})


def _offline(spark, sf_dir):
    """A fixture of the regions' hits on both sides, verified."""
    folder, sides = files.shared_folder(spark), {}
    for name, hits in (("source_hits", _by_balance), ("target_hits", _by_orders)):
        for r in hits(spark, sf_dir, "region").orderBy("query_id", "rank").collect():  # EXPAND hits of each region
            sides.setdefault(r["query_id"], {"query_id": f"region {r['query_id']}", "source_hits": [], "target_hits": []})[name].append({"id": str(r["id"]), "rank": r["rank"], "score": r["score"]})
    path = files.write_json(spark, f"{folder}/fixture.json", {"job_id": "regions", "top_k": TOP, "expand_k": EXPAND, "stable_k": STABLE, "boundary_k": BOUND, "queries": list(sides.values())})
    return _document_row(spark, jobs.offline_verify(spark, path, folder).result, artifacts.RESULT_NAMES)


def _nothing(spark, sf_dir):
    """Two sets without a fingerprint: every distance is 1."""
    none = _prints(spark, sf_dir).limit(0)
    return _rounded(compare.compare(none, none, check=False), *_SUMMARY)


def _broken(spark, sf_dir) -> DataFrame:
    """The corpus with faults: every 7th vector cut short, every 11th with a component that is not finite."""
    v = F.when(F.col("id") % 7 == 0, F.slice("vector", 1, 63)).when(F.col("id") % 11 == 0, F.transform("vector", lambda x, i: F.when(i == 3, F.lit(float("inf"))).otherwise(x))).otherwise(F.col("vector"))
    return _corpus(spark, sf_dir).withColumn("vector", v)


def _rule(name: str):
    return lambda spark, sf_dir: checks.violations(_broken(spark, sf_dir), 64).filter(F.col("rule") == name).agg(F.count("*").alias("n"))


def _rules(spark, sf_dir):
    """All rules at once, on the corpus with faults, every 13th id of which is empty."""
    rows = _broken(spark, sf_dir).withColumn("id", F.when(F.col("id") % 13 == 0, "").otherwise(F.col("id").cast("string")))
    return checks.violations(rows, 64).groupBy("rule").agg(F.count("*").alias("n"))


def _duplicates(spark, sf_dir):
    return checks.duplicates(_moved(spark, sf_dir), "id")


def _normalised(spark, sf_dir):
    rows = _coarse(_corpus(spark, sf_dir)).withColumn("vector", vectors.normalised(F.col("vector")))
    return _flat(rows)


def _norms(spark, sf_dir):
    return _rounded(_corpus(spark, sf_dir).select("id", vectors.norm(F.col("vector")).alias("norm")), "norm")


def _roundtrip(spark, sf_dir):
    back = vectors.parsed(vectors.literal(F.col("vector")))
    return _corpus(spark, sf_dir).select("id", (back == F.col("vector")).alias("same"), F.size(back).cast("long").alias("dimension"))


def _single_precision(spark, sf_dir):
    coarse = F.transform("vector", lambda x: x / 3.0)
    return _corpus(spark, sf_dir).withColumn("v", coarse).select("id", F.round(vectors.l2_distance(F.col("v"), vectors.as_float32(F.col("v"))) * 1e9, 3).alias("loss_1e9"))


def _synthetic(spark, sf_dir):
    """Seed 42; as many rows as the table has vectors."""
    return _axes(datasets.generated(spark, 42, 8, max(1, _corpus(spark, sf_dir).count()), "l2"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "knn_cosine": _hits("cosine"),
    "knn_l2": _hits("l2"),
    "knn_ip": _hits("ip"),
    "knn_single_query": _single,
    "ranked_hits_precomputed": _precomputed,
    "corpus_count": lambda spark, sf_dir: _corpus(spark, sf_dir).agg(F.count("*").alias("n")),
    "label_count": lambda spark, sf_dir: _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")),
    "fp_stable": _listed("stable_neighbors"),
    "fp_topk": _listed("top_k_ids"),
    "fp_boundary_window": _listed("boundary_candidates"),
    "fp_boundary_score_delta": _delta,
    "jaccard_stable": _one("stable_neighbor_distance"),
    "jaccard_boundary": _one("boundary_candidate_distance"),
    "flip_rate": _one("boundary_flip_rate"),
    "compare_per_query": lambda spark, sf_dir: _rounded(_each(spark, sf_dir), *_DISTANCES),
    "compare_summary": _summary({}, {"coarse": True}),
    "compare_missing_target": _summary({}, {"coarse": True, "which": SOME}),
    "compare_missing_source": _summary({"which": OTHERS}, {"coarse": True}),
    "compare_disjoint": _disjoint,
    "compare_identical": _summary({}, {}),
    "compare_incomplete_corpus": _summary({}, {"corpus": lambda spark, sf_dir: _corpus(spark, sf_dir).filter("id % 10 <> 0")}),
    "compare_metric_change": _summary({}, {"metric": "l2"}),
    "compare_float_vs_quantized": _summary({"corpus": lambda spark, sf_dir: _corpus(spark, sf_dir).withColumn("vector", vectors.as_float32(F.col("vector")))}, {"coarse": True, "metric": "l2"}),
    "compare_own_weights": _summary({}, {"coarse": True}, _OWN_WEIGHTS),
    "ranking_drift_nation": _nations,
    "weighted_distance_custom": _weighted,
    "migrate_upsert": _upsert,
    "migrate_overwrite": _replace,
    "migrate_collections": _collections,
    "dataset_document": _dataset,
    "seed_repeated_ids": _seeded,
    "artifact_roundtrip": _artifact_rows,
    "result_document": _result,
    "output_document": _output,
    "offline_fixture": _offline,
    "compare_nothing": _nothing,
    "violations_by_rule": _rules,
    "validate_dimension": _rule("dimension"),
    "validate_finite": _rule("not finite"),
    "duplicate_ids": _duplicates,
    "normalize_vectors": _normalised,
    "vector_norms": _norms,
    "vector_literal_roundtrip": _roundtrip,
    "float32_roundtrip": _single_precision,
    "synth_dataset": _synthetic,
}

# The same in SQL.

_VECTORS = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"
_COARSE = "SELECT id, list_transform(v, lambda x: floor(x * 8) / 8) AS v FROM c"
_GAP = {"cosine": "1 - list_cosine_similarity(q.v, c.v)", "l2": "list_distance(q.v, c.v)", "ip": "-list_inner_product(q.v, c.v)"}
_SCORE = {"cosine": "1 - gap", "l2": "0 - gap", "ip": "0 - gap"}


def _hits_cte(name: str, corpus: str, metric: str = "cosine", limit: int = EXPAND, where: str = EVERY) -> str:
    return f"""{name} AS (SELECT query_id, id, rank, {_SCORE[metric]} AS score FROM (
        SELECT q.id AS query_id, c.id AS id, {_GAP[metric]} AS gap, row_number() OVER (PARTITION BY q.id ORDER BY {_GAP[metric]}, c.id) AS rank
        FROM (SELECT * FROM c WHERE {where}) q, ({corpus}) c) WHERE rank <= {limit})"""


def _prints_cte(name: str, hits: str) -> str:
    first, last = fingerprint.window_bounds(TOP, BOUND)
    pick = lambda cond: f"coalesce(list(id ORDER BY rank) FILTER (WHERE {cond}), [])"
    return f"{name} AS (SELECT query_id, {pick(f'rank <= {STABLE}')} AS stable, {pick(f'rank BETWEEN {first} AND {last}')} AS bound, {pick(f'rank <= {TOP}')} AS top FROM {hits} GROUP BY query_id)"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE 1 - len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


_PAIR = f"""p AS (SELECT query_id, CASE WHEN s.query_id IS NOT NULL AND t.query_id IS NOT NULL THEN 'matched' WHEN t.query_id IS NULL THEN 'missing_target' ELSE 'missing_source' END AS status,
    CASE WHEN s.query_id IS NULL OR t.query_id IS NULL THEN 1.0 ELSE {_jaccard("s.stable", "t.stable")} END::DOUBLE AS stable_neighbor_distance,
    CASE WHEN s.query_id IS NULL OR t.query_id IS NULL THEN 1.0 ELSE {_jaccard("s.bound", "t.bound")} END::DOUBLE AS boundary_candidate_distance,
    CASE WHEN s.query_id IS NULL OR t.query_id IS NULL THEN 1.0 WHEN len(s.bound) + len(t.bound) = 0 THEN 0.0
        ELSE len(list_filter(list_distinct(list_concat(s.bound, t.bound)), lambda x: list_contains(s.top, x) <> list_contains(t.top, x))) / len(list_distinct(list_concat(s.bound, t.bound))) END::DOUBLE AS boundary_flip_rate
    FROM s FULL JOIN t USING (query_id))"""
_ROUND = "SELECT query_id, status, " + ", ".join(f"round({c}, 6) AS {c}" for c in _DISTANCES) + " FROM p"


def _summary_sql(weights: dict | None = None) -> str:
    weights = weights or compare.WEIGHTS
    total = " + ".join(f"{c} * {w}" for c, w in weights.items())
    means = ", ".join(f"coalesce(avg({c}), 1.0) AS {c}" for c in _DISTANCES)
    counts = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}_query_count" for s in ("matched", "missing_source", "missing_target"))
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in _DISTANCES)
    return f"""SELECT round(greatest(0.0, least(1.0, 1 - d)), 6) AS consistency_score, round(d, 6) AS fingerprint_distance, {rounded}, matched_query_count, missing_source_query_count, missing_target_query_count
        FROM (SELECT *, greatest(0.0, least(1.0, ({total}) / {sum(weights.values())}))::DOUBLE AS d FROM (SELECT {means}, {counts} FROM p))"""


def _compare_sql(tail: str, source: str = "SELECT * FROM c", target: str = _COARSE, s_metric: str = "cosine", t_metric: str = "cosine", s_where: str = EVERY, t_where: str = EVERY, shift: int = 0) -> str:
    t = _prints_cte("t", f"(SELECT query_id + {shift} AS query_id, id, rank FROM ht)" if shift else "ht")
    return f"WITH c AS ({_VECTORS}), {_hits_cte('hs', source, s_metric, where=s_where)}, {_hits_cte('ht', target, t_metric, where=t_where)}, {_prints_cte('s', 'hs')}, {t}, {_PAIR} {tail}"


def _knn_sql(metric: str) -> str:
    return f"WITH c AS ({_VECTORS}), {_hits_cte('h', 'SELECT * FROM c', metric)} SELECT query_id, id, rank, round(score, 6) AS score FROM h"


def _list_sql(low: int, high: int) -> str:
    return f"WITH c AS ({_VECTORS}), {_hits_cte('h', 'SELECT * FROM c')} SELECT query_id, rank - {low - 1} AS pos, id FROM h WHERE rank BETWEEN {low} AND {high}"


def _balance(key: str = "c_nationkey", rows: str = "customer") -> str:
    return f"""hb AS (SELECT * FROM (SELECT {key} AS query_id, c_custkey AS id, c_acctbal AS score, row_number() OVER (PARTITION BY {key} ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM {rows}) WHERE rank <= {EXPAND})"""


def _spent(key: str = "c_nationkey", rows: str = "customer") -> str:
    return f"""ho AS (SELECT * FROM (SELECT {key} AS query_id, c_custkey AS id, row_number() OVER (PARTITION BY {key} ORDER BY spent DESC, c_custkey) AS rank
    FROM {rows} JOIN (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT) AS spent FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey) WHERE rank <= {EXPAND})"""


_REGIONAL = ("n_regionkey", "customer JOIN nation ON c_nationkey = n_nationkey")
_BALANCE, _SPENT = _balance(), _spent()
_MOVED = f"""c AS ({_VECTORS}), m AS (SELECT id, list_transform(v, lambda x: floor(x * 8) / 8) AS v, 1 AS ord FROM c UNION ALL SELECT id, list_transform(v, lambda x: -x), 2 FROM c WHERE id % 2 = 0
    UNION ALL SELECT -id - 1, v, 1 FROM c), l AS (SELECT id, v FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)"""
_FLAT = "SELECT id, round(v[1], 6) AS first, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM"
_FIRST, _LAST = fingerprint.window_bounds(TOP, BOUND)


def _noise_sql(seed: int, rows: str = "(SELECT greatest(count(*), 1) FROM embeddings)", x: str = "x3::DOUBLE / {prime} * 2 - 1") -> str:
    start = f"(({seed * 1000003 + 15485863 + 12345} + id * 104729 + axis * 1299709) % {datasets.PRIME})"
    step = lambda x: f"((({x}) * ({x}) + s + 1013904223) % {datasets.PRIME})"
    return f"""WITH g AS (SELECT id, axis, {start}::BIGINT AS s FROM (SELECT unnest(range(1, {rows} + 1)) AS id), range(8) b(axis)), g1 AS (SELECT *, {step('s')} AS x1 FROM g), g2 AS (SELECT *, {step('x1')} AS x2 FROM g1), g3 AS (SELECT *, {step('x2')} AS x3 FROM g2)
        SELECT printf('vec-%06d', id) AS id, axis, round({x.format(prime=datasets.PRIME)}, 6) AS x FROM g3"""


def _regions_sql(tail: str) -> str:
    return f"WITH {_balance(*_REGIONAL)}, {_spent(*_REGIONAL)}, {_prints_cte('s', 'hb')}, {_prints_cte('t', 'ho')}, {_PAIR} {tail}"


_REGIONS = _regions_sql(f"SELECT 'regions' AS job_id, consistency_score, {', '.join(_METRICS)} FROM ({_summary_sql()})")


ORACLES: dict[str, str] = {
    "knn_cosine": _knn_sql("cosine"),
    "knn_l2": _knn_sql("l2"),
    "knn_ip": _knn_sql("ip"),
    "knn_single_query": f"WITH c AS ({_VECTORS}), {_hits_cte('h', 'SELECT * FROM c', limit=5, where='id = 50')} SELECT query_id, id, rank, round(score, 6) AS score FROM h",
    "ranked_hits_precomputed": f"WITH {_BALANCE} SELECT query_id, id, rank, round(score, 6) AS score FROM hb WHERE rank <= {TOP}",
    "corpus_count": "SELECT count(*) AS n FROM embeddings",
    "label_count": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "fp_stable": _list_sql(1, STABLE),
    "fp_topk": _list_sql(1, TOP),
    "fp_boundary_window": _list_sql(_FIRST, _LAST),
    "fp_boundary_score_delta": f"""WITH c AS ({_VECTORS}), {_hits_cte('h', 'SELECT * FROM c')} SELECT h.query_id, h.id, h.rank, round(h.score, 6) AS score
        FROM h JOIN h k ON h.query_id = k.query_id AND k.rank = {TOP} WHERE h.rank >= {TOP - 3} AND abs(h.score - k.score) <= 0.02 + 1e-12""",
    "jaccard_stable": _compare_sql("SELECT query_id, round(stable_neighbor_distance, 6) AS stable_neighbor_distance FROM p"),
    "jaccard_boundary": _compare_sql("SELECT query_id, round(boundary_candidate_distance, 6) AS boundary_candidate_distance FROM p"),
    "flip_rate": _compare_sql("SELECT query_id, round(boundary_flip_rate, 6) AS boundary_flip_rate FROM p"),
    "compare_per_query": _compare_sql(_ROUND),
    "compare_summary": _compare_sql(_summary_sql()),
    "compare_missing_target": _compare_sql(_summary_sql(), t_where=SOME),
    "compare_missing_source": _compare_sql(_summary_sql(), s_where=OTHERS),
    "compare_disjoint": _compare_sql(_summary_sql(), shift=1000000),
    "compare_identical": _compare_sql(_summary_sql(), target="SELECT * FROM c"),
    "compare_incomplete_corpus": _compare_sql(_summary_sql(), target="SELECT * FROM c WHERE id % 10 <> 0"),
    "compare_metric_change": _compare_sql(_summary_sql(), target="SELECT * FROM c", t_metric="l2"),
    "compare_float_vs_quantized": _compare_sql(_summary_sql(), t_metric="l2"),
    "compare_own_weights": _compare_sql(_summary_sql(_OWN_WEIGHTS)),
    "ranking_drift_nation": f"WITH {_BALANCE}, {_SPENT}, {_prints_cte('s', 'hb')}, {_prints_cte('t', 'ho')}, {_PAIR} {_ROUND}",
    "weighted_distance_custom": _compare_sql("SELECT query_id, round((stable_neighbor_distance * 1 + boundary_flip_rate * 3) / 4, 6) AS distance FROM p"),
    "migrate_upsert": f"WITH {_MOVED} {_FLAT} (SELECT id, v FROM c WHERE id % 2 <> 0 UNION ALL SELECT id, v FROM l WHERE id < 0 OR id % 2 = 0)",
    "migrate_overwrite": f"WITH {_MOVED} {_FLAT} l",
    "migrate_collections": f"WITH {_MOVED} {_FLAT} (SELECT id, v FROM c WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT id, v FROM l)",
    "dataset_document": _noise_sql(42, "100"),
    "seed_repeated_ids": _noise_sql(42, "100", "CASE WHEN id <= 40 THEN -1 ELSE 1 END * (x3::DOUBLE / {prime} * 2 - 1)"),
    "artifact_roundtrip": f"""WITH {_balance(*_REGIONAL)} SELECT query_id::VARCHAR AS query_id, list, rank - first + 1 AS pos, id::VARCHAR AS id
        FROM hb JOIN (VALUES ('stable_neighbors', 1, {STABLE}), ('boundary_candidates', {_FIRST}, {_LAST}), ('top_k_ids', 1, {TOP})) w(list, first, last) ON rank BETWEEN first AND last""",
    "result_document": _REGIONS,
    "output_document": _REGIONS,
    "offline_fixture": _REGIONS,
    "compare_nothing": _compare_sql(_summary_sql(), s_where="false", t_where="false"),
    "violations_by_rule": """SELECT rule, count(*) AS n FROM (SELECT CASE WHEN vec_id % 13 = 0 THEN 'empty id' WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 11 = 0 THEN 'not finite' END AS rule FROM embeddings) WHERE rule IS NOT NULL GROUP BY rule""",
    "validate_dimension": "SELECT count(*) AS n FROM embeddings WHERE vec_id % 7 = 0",
    "validate_finite": "SELECT count(*) AS n FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 11 = 0",
    "duplicate_ids": f"WITH {_MOVED} SELECT id, count(*) AS n FROM m GROUP BY id HAVING count(*) > 1",
    "normalize_vectors": f"""WITH c AS ({_VECTORS}), w AS ({_COARSE}), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM w)
        {_FLAT} (SELECT id, CASE WHEN size = 0 THEN list_transform(v, lambda x, i: CASE WHEN i = 1 THEN 1.0 ELSE 0.0 END) ELSE list_transform(v, lambda x: x / size) END AS v FROM n)""",
    "vector_norms": f"WITH c AS ({_VECTORS}) SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM c",
    "vector_literal_roundtrip": "SELECT vec_id AS id, ('[' || array_to_string(embedding::DOUBLE[], ',') || ']')::DOUBLE[] = embedding::DOUBLE[] AS same, len(embedding) AS dimension FROM embeddings",
    "float32_roundtrip": f"WITH c AS ({_VECTORS}), w AS (SELECT id, list_transform(v, lambda x: x / 3) AS v FROM c) SELECT id, round(list_distance(v, v::FLOAT[]::DOUBLE[]) * 1e9, 3) AS loss_1e9 FROM w",
    "synth_dataset": _noise_sql(42),
}
