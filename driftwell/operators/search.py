"""Exact nearest-neighbour search and rankings computed elsewhere, as hits (query_id, id, rank, score)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from driftwell.functions import vectors
from driftwell.operators import checks

QUERY_BLOCK = 4096  # query vectors that a task holds at once
CORPUS_BLOCK = 65_536  # corpus rows that meet a block of queries in one task, where there are several blocks


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is nearer. Null for cosine with a zero vector; nulls rank last."""
    if metric == "cosine":
        return 1.0 - vectors.cosine_similarity(a, b)
    return vectors.l2_distance(a, b) if metric == "l2" else -vectors.dot(a, b)


def score(metric: str, gap: Column) -> Column:
    """Larger is better, whatever the metric."""
    return 1.0 - gap if metric == "cosine" else 0.0 - gap  # no negative zero


def _gaps(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances up to rounding; rows of x against rows of q. Where there is none: infinity."""
    if metric == "ip":
        return -(x @ q.T)
    if metric == "l2":
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1) - 2 * (x @ q.T), 0))
    size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, 1 - (x @ q.T) / size, np.inf)


class _Nearest:
    """The ``limit`` best distances that a block of queries has seen, and which rows of a batch may be among them.

    One matrix product scores a batch; a row stays if it is within rounding of the best.
    """

    def __init__(self, matrix: np.ndarray, metric: str, limit: int):
        self.matrix, self.metric, self.limit = matrix, metric, limit
        self.best = np.full(len(matrix), np.inf)
        self.slack = 1e-6 * (1 + float(np.abs(matrix).max(initial=0)))

    def among(self, col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries of the candidates among vectors without nulls."""
        width = self.matrix.shape[1]
        if (np.asarray(pc.list_value_length(col)) != width).any():
            raise ValueError(f"a corpus vector has not the queries' dimension {width}")
        x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        gaps = _gaps(self.metric, x, self.matrix)
        if len(x) >= self.limit:
            self.best = np.minimum(self.best, np.partition(gaps, self.limit - 1, axis=0)[self.limit - 1])
        return np.nonzero((gaps <= self.best + self.slack * (1 + np.abs(x).max(initial=0))) | ~np.isfinite(gaps) & ~np.isfinite(self.best))


def _candidates(corpus: DataFrame, ids: list, matrix: np.ndarray, metric: str, limit: int) -> DataFrame:
    """A superset of the nearest ``limit`` rows of each query, a few times ``limit`` for each task; all tasks hold all queries."""

    def run(batches):
        near = _Nearest(matrix, metric, limit)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                b = b.filter(pc.is_valid(b.column("vector")))
                if b.num_rows:
                    col = b.column("vector")
                    rows, queries = near.among(col)
                    yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int32()), b.column("id").take(pa.array(rows)), col.take(pa.array(rows)).cast(pa.list_(pa.float64()))], names=["q", "id", "vector"])

    schema = T.StructType([T.StructField("q", T.IntegerType()), corpus.schema["id"], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return corpus.mapInArrow(run, schema)


def _dealt_candidates(corpus: DataFrame, queries: DataFrame, count: int, metric: str, limit: int) -> DataFrame:
    """(query_id, query_vector, id, vector): the same from a grid of tasks, each a block of queries and a block of the corpus.

    Neither side passes through the driver; a task holds its queries and streams its rows.
    """
    blocks, chunks = -(-count // QUERY_BLOCK), max(1, -(-corpus.count() // CORPUS_BLOCK))
    vector = T.ArrayType(T.DoubleType())
    kinds = {"query_id": queries.schema["query_id"].dataType, "query_vector": vector, "id": corpus.schema["id"].dataType, "vector": vector}

    def side(rows: DataFrame, key: str, own: int, other: int, task, number: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(own))
        columns = [F.col(c).cast(kind).alias(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
        return rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))).select(task.alias("task"), F.lit(number).alias("side"), *columns)

    grid = side(queries, "query_id", blocks, chunks, F.col("block") * chunks + F.col("other"), 0).unionByName(side(corpus.filter("vector is not null"), "id", chunks, blocks, F.col("other") * chunks + F.col("block"), 1))

    def run(batches):
        now, held, near, ids = None, [], None, None
        for whole in batches:
            marks = whole.column("task").to_numpy() * 2 + whole.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                task, corpus_side = divmod(int(marks[a]), 2)
                if task != now:
                    now, held, near = task, [], None
                part = whole.slice(a, b - a)
                if not corpus_side:
                    held.append(part.select(["query_id", "query_vector"]))
                    continue
                if not held:
                    continue
                if near is None:
                    ids = pa.concat_batches(held)
                    own = ids.column("query_vector")
                    sizes = set(np.asarray(pc.fill_null(pc.list_value_length(own), 0)).tolist())
                    if len(sizes) > 1 or 0 in sizes:
                        raise ValueError("query vectors must be non-empty and of one dimension")
                    near = _Nearest(own.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), metric, limit)
                for at in range(0, len(part), 8192):
                    some = part.slice(at, 8192)
                    rows, queries_ = near.among(some.column("vector"))
                    yield pa.RecordBatch.from_arrays([*(ids.column(c).take(pa.array(queries_)) for c in ("query_id", "query_vector")), *(some.column(c).take(pa.array(rows)) for c in ("id", "vector"))], names=list(kinds))

    schema = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])
    return grid.repartition("task").sortWithinPartitions("task", "side").mapInArrow(run, schema)


def exact_knn(queries: DataFrame, corpus: DataFrame, metric: str, expand_k: int, top_k: int | None = None) -> DataFrame:
    """The ``expand_k`` nearest rows of ``corpus`` (id, vector) to each of ``queries`` (id, vector).

    Ties go by id. Up to QUERY_BLOCK queries reach all tasks, and the corpus stays where it is; more are
    dealt in blocks against blocks of the corpus. Only candidates leave a task. Their scores are then computed in the plan, so that
    equal vectors tie exactly. Rows without a vector are in no ranking.
    """
    checks.metric(metric)
    checks.search_options(expand_k if top_k is None else top_k, expand_k)
    corpus = corpus.select("id", "vector")
    queries = queries.select(F.col("id").alias("query_id"), vectors.doubles("vector").alias("query_vector"))
    rows = queries.limit(QUERY_BLOCK + 1).collect()  # a block and one more at most
    if len(rows) > QUERY_BLOCK:
        found = _dealt_candidates(corpus, queries, queries.count(), metric, expand_k)
    elif rows:
        sizes = {len(r["query_vector"] or ()) for r in rows}
        checks.require(len(sizes) <= 1 and 0 not in sizes, "query vectors must be non-empty and of one dimension")
        matrix = np.array([r["query_vector"] for r in rows], np.float64)
        numbered = T.StructType([T.StructField("q", T.IntegerType()), queries.schema["query_id"], queries.schema["query_vector"]])
        table = corpus.sparkSession.createDataFrame([(n, r["query_id"], r["query_vector"]) for n, r in enumerate(rows)], numbered)
        found = _candidates(corpus, [r["query_id"] for r in rows], matrix, metric, expand_k).join(F.broadcast(table), "q")  # one block of queries
    else:
        kind = corpus.schema["id"].dataType.simpleString()
        return corpus.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, rank int, score double")
    scored = found.select("query_id", "id", distance(metric, F.col("query_vector"), F.col("vector")).alias("gap"))
    return ranked(scored.withColumn("score", score(metric, F.col("gap"))), [F.col("gap").asc_nulls_last(), F.col("id")], expand_k)


def ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each query in ``order``, numbered from 1."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", place).filter(F.col("rank") <= limit).select("query_id", "id", F.col("rank").cast("int").alias("rank"), "score")


def precomputed(hits: DataFrame, expand_k: int, whole: bool = True) -> DataFrame:
    """The first ``expand_k`` hits by rank, then input_pos if there is one, then id. With ``whole``, fewer is an error."""
    checks.require(expand_k > 0, "expand_k must be above 0")
    if whole:
        checks.hits(hits, expand_k)
    order = [F.col("rank"), F.col("input_pos") if "input_pos" in hits.columns else F.col("id")]
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("pos", place).filter(F.col("pos") <= expand_k).select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"))
