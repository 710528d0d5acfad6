"""N-gram Jaccard join: MinHash banding, then exact comparison of whole n-gram sets.

A text is cut at white space; its n-grams are the runs of N words (a shorter text is one n-gram of
all its words). Texts with equal sets form a class at once. A class's MinHash signature is cut into
bands; band and row counts come from the target recall at the threshold, with the fewest false
candidates among those that reach it within ``max_hashes``. Only verified links unite classes: first
each class is compared with the least one of every band bucket that it is in, each such pair
once; then, in buckets whose other members those links leave apart, members outside the
largest part are compared with all others, so that every pair of a bucket is either
compared or already in one group. Chance meetings in a bucket unite nothing. Each group is then compared in full,
block pair by block pair, in numpy, which gives the number of links of each class. Tasks hold two blocks at most,
whatever the size of a group or bucket, and give counts and spanning forests, never all pairs.

The n-gram sets of classes that share a bucket are written once. Their ids are broadcast while
they are SMALL at most; beyond that the join with the texts shuffles, after Spark's runtime
Bloom filter on the ids.

Null and empty texts, and those of white space alone, have no n-grams and link with nothing.
Repeated rows are copies of one another; rows of one doc_id with different texts count as one
document, whose links are those of all. Rows without an id take the class of their text, but are no
one's link: they are in no count, and kept is null. An empty table gives an empty result. Columns of other names are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from driftwell.llm.blocks import dealt, per_task
from driftwell.llm.common import Scratch, gathered, map_texts, spread_join, table
from driftwell.llm.components import Forest, components

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
BLOCK = 256
WORDS = 100_000  # word hashes a task keeps
SMALL = 200_000  # rows of two numbers and a key, some 60 bytes each, that may be broadcast


def bands_for(threshold: float, recall: float, max_hashes: int = 160) -> tuple[int, int]:
    """Bands and rows that reach the recall at the threshold; of those, the pair that fewest dissimilar texts pass."""
    best = None
    for rows in range(1, 33):
        met = threshold**rows  # chance that a band agrees
        bands = 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log1p(-met))
        if bands * rows <= max_hashes:
            passed = sum(1 - (1 - (s / 100 * threshold) ** rows) ** bands for s in range(100))
            if best is None or passed < best[0]:
                best = (passed, bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall within max_hashes")
    return best[1], best[2]


class _Words(dict):
    """64-bit hashes of words, of bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = got
        return got


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = _mix(out + h[k : len(h) - width + 1 + k])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def _bands(grams: np.ndarray, bands: int, rows: int, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """One hash for each band."""
    least = np.full(bands * rows, np.uint64(2**64 - 1))
    for at in range(0, len(grams), 2048):  # bounds the working array
        least = np.minimum(least, (grams[at : at + 2048] * times[:, None] + plus[:, None]).min(axis=1))
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = _mix(out + column)
    return out.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N, seed: int = 1) -> DataFrame:
    """doc_id, set_key (128 bits of the n-gram set, null without n-grams) and bands."""

    def run(part, texts):
        times, plus = _permutations(bands * rows, seed)
        keys, hashes = [], []
        memo: dict[bytes, np.ndarray] = {}
        for t in texts:
            g = ngrams(t, n)
            key = xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None
            keys.append(key)
            if key is None:
                hashes.append(None)
                continue
            if key not in memo:
                memo[key] = _bands(g, bands, rows, times, plus)
            hashes.append(memo[key])
        return {"doc_id": part.column("doc_id"), "set_key": pa.array(keys, pa.binary()), "bands": pa.array(hashes, pa.list_(pa.int64()))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, set_key binary, bands array<bigint>", limit=2_000_000)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` with grams in place of text; rows whose set is not the wanted one go."""
    keep = [c for c in docs.columns if c != "text"]

    def run(part, texts):
        grams = [ngrams(t, n) for t in texts]
        right = pa.array([xxhash.xxh3_128_digest(g.tobytes()) == k for g, k in zip(grams, part.column("set_key").to_pylist())], pa.bool_())
        return {**{c: part.column(c).filter(right) for c in keep}, "grams": pa.array([g.tobytes() for g in grams], pa.binary()).filter(right)}

    ddl = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(docs, run, f"{ddl}, grams binary", limit=2_000_000)


def _verify(threshold: float):
    """Counts of links, weighted by copies, and a spanning forest, for one task."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column("id").to_numpy()
        if (ids[1:] == ids[:-1]).any():  # repeated rows of one document
            own = [(i, g) for i, g in zip(ids.tolist(), batch.column("grams").to_pylist())]
            batch = batch.filter(pa.array([k == 0 or own[k] != own[k - 1] for k in range(len(own))]))
        ids, side, times = (batch.column(c).to_numpy() for c in ("id", "side", "times"))
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in batch.column("grams")]
        sizes = np.array([len(g) for g in grams])
        flat = np.concatenate(grams)
        values, number, seen = np.unique(flat, return_inverse=True, return_counts=True)
        shared = seen[number] > 1  # an n-gram of one text links nothing
        owner = np.repeat(np.arange(len(ids)), sizes)[shared]
        number = (np.cumsum(seen > 1) - 1)[number[shared]]
        at = np.searchsorted(owner, np.arange(len(ids) + 1))
        mark = np.zeros(int((seen > 1).sum()), bool)
        counts, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
        bipartite = side[0] != 0
        split = int((side == 1).sum()) if bipartite else 0
        for i in range(split if bipartite else len(ids) - 1):
            own = number[at[i] : at[i + 1]]
            first = split if bipartite else i + 1
            if not len(own) or at[first] == at[-1]:
                continue
            mark[own] = True
            hits = np.bincount(owner[at[first] :][mark[number[at[first] :]]] - first, minlength=len(ids) - first)
            mark[own] = False
            union = sizes[i] + sizes[first:] - hits
            near = np.flatnonzero(hits >= threshold * union - 1e-9 * union) + first
            counts[i] += times[near].sum()
            counts[near] += times[i]
            for j in near.tolist():
                if forest.join(i, j):
                    edges.append((i, j))
        other = ids.copy()  # each row's own id where the forest has no further edge
        out_ids, out_n, out_to = [ids], [counts], [other]
        if edges:
            e = np.array(edges)
            out_ids.append(ids[e[:, 1]])
            out_n.append(np.zeros(len(e), np.int64))
            out_to.append(ids[e[:, 0]])
        return {"id": np.concatenate(out_ids), "n": np.concatenate(out_n), "to": np.concatenate(out_to)}

    return run


def _by_hub(pairs: DataFrame) -> DataFrame:
    """task, side and id for pairs (hub, id): each task compares one hub with BLOCK of its ids, about."""
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("hub_rows"))
    parts = F.expr(f"hub_rows div {BLOCK} + 1")
    name = lambda part: F.concat_ws("-", "hub", part)
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).select(name(F.col("part")).alias("task"), F.lit(1).alias("side"), F.col("hub").alias("id"))
    sized = spread_join(pairs, sizes, "hub", "hub_rows", pairs.count())
    return hubs.unionByName(sized.select(name(F.pmod(F.xxhash64("id"), parts)).alias("task"), F.lit(2).alias("side"), "id"))


def _by_bucket(met: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame | None:
    """task, side and id for buckets whose members, but for the hub, are in several groups; None without such buckets.

    Blocks of members outside the bucket's largest group meet all blocks of the bucket.
    """
    members = met.filter("id <> hub").select("hash", "id").join(groups, "id", "left").select("hash", "id", F.coalesce("component", "id").alias("part"))
    members = scratch.write(members, "jaccard-members")
    sizes = members.groupBy("hash", "part").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("hash").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.sum("n").alias("rows"), F.max("n").alias("n")).filter("n < rows")
    open_ = scratch.write(gathered(open_.withColumn("few", F.expr("rows - n")), members.count()), "jaccard-open")
    if open_.isEmpty():
        return None
    found = spread_join(members, open_, "hash", "rows", members.count()).filter("most is not null")
    few = F.expr(f"few div {BLOCK} + 1")  # blocks of members outside the largest part, numbered first
    many = F.expr(f"n div {BLOCK} + 1")
    own = F.when(F.col("part") == F.col("most"), few + F.pmod(F.xxhash64("id"), many)).otherwise(F.pmod(F.xxhash64("id"), few))
    placed = found.withColumn("own", own).withColumn("few_", few).withColumn("all_", few + many)
    others = F.when(F.col("own") < F.col("few_"), F.sequence(F.lit(0).cast("long"), F.col("all_") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("few_") - 1))
    pairs = placed.withColumn("other", F.explode(others))
    task = F.concat_ws("-", "hash", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return pairs.select(task.alias("task"), side.alias("side"), "id")


def keyed(docs: DataFrame, name: str, n: int = N) -> DataFrame:
    """The rows of ``docs`` with the key of their text's n-gram set as column ``name``."""
    columns = docs.columns

    def run(part, texts):
        grams = [ngrams(t, n) for t in texts]
        return {**{c: part.column(c) for c in columns}, name: pa.array([xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in grams], pa.binary())}

    return map_texts(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]), limit=2_000_000)


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, seed: int = 1, with_key: bool = False) -> DataFrame:
    """doc_id, class_id (least doc_id reachable by links), n_links, kept for every row; ``with_key`` adds set_key."""
    bands, rows = bands_for(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.write(signatures(docs, bands, rows, n, seed), "jaccard-signatures", read_later=True)
        classes = signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("times"), F.first("bands").alias("bands"))
        classes = scratch.write(gathered(classes, signed.count()), "jaccard-classes")
        all_ = classes.select("id", F.explode("bands").alias("hash"))  # the band's number is in its hash
        stars = scratch.write(all_.groupBy("hash").agg(F.min("id").alias("hub"), F.max("id").alias("far"), F.count("*").alias("rows")).filter("hub < far").drop("far"), "jaccard-stars")
        met = scratch.write(spread_join(all_, stars, "hash", "rows", classes.count()).filter("hub is not null").select("hash", "hub", "id"), "jaccard-met")
        pairs = scratch.write(gathered(met.filter("id <> hub").select("hub", "id").distinct(), met.count()), "jaccard-hub-pairs")
        ids = pairs.select("id").union(pairs.select("hub")).distinct()
        wanted = scratch.write(gathered(classes.select("id", "set_key", "times").join(ids, "id"), signed.count()), "jaccard-wanted")
        known = wanted.withColumnRenamed("id", "doc_id")
        known = F.broadcast(known) if wanted.count() <= SMALL else known.hint("merge")  # files are smaller than rows: no choice by their size
        sets = scratch.write(_sets(docs.join(known, "doc_id").withColumnRenamed("doc_id", "id"), n), "jaccard-sets")
        if not sets.filter("times > 1").groupBy("id", "set_key").count().filter("count > 1").isEmpty():  # repeated rows
            sets = scratch.write(sets.filter("times = 1").unionByName(sets.filter("times > 1").dropDuplicates(["id", "set_key"])), "jaccard-sets")

        def verified(tasks: DataFrame, name: str) -> DataFrame:
            tasks = scratch.write(tasks, f"{name}-tasks")
            tasks = F.broadcast(tasks) if tasks.count() <= SMALL else tasks.hint("merge")
            return scratch.write(per_task(sets.drop("set_key").join(tasks, "id"), _verify(threshold), "id long, n long, to long"), name)

        tied = lambda found: found.filter("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))
        edges = tied(verified(_by_hub(pairs), "jaccard-hubs"))
        groups = scratch.write(components(edges, "jaccard"), "jaccard-groups")
        left = _by_bucket(met, groups, scratch)
        if left is not None and not (more := tied(verified(left, "jaccard-buckets"))).isEmpty():
            groups = scratch.write(components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "jaccard"), "jaccard-groups")
        counted = verified(dealt(groups.withColumnRenamed("component", "grp"), BLOCK).drop("grp"), "jaccard-links").groupBy("id").agg(F.sum("n").alias("n"))
        summary = classes.select("set_key", "id", "times").join(groups, "id", "left").join(counted, "id", "left")
        summary = summary.select("set_key", "times", F.coalesce("component", "id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
        summary = scratch.write(summary, "jaccard-summary", read_later=True)
        total = classes.agg(F.sum("times")).first()[0] or 0
    out = spread_join(signed.select("doc_id", "set_key"), summary, "set_key", "times", total)
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("doc_id") == class_id).alias("kept"), *(["set_key"] if with_key else []))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"))


SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - {N - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {N - 1}], ' ')))) AS gram FROM w WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE both_ * 10 >= {round(THRESHOLD * 10)} * (na.n + nb.n - both_)),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS least_ FROM r GROUP BY a),
    d AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
    SELECT doc_id, least(doc_id, coalesce(least_, doc_id)) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, doc_id <= coalesce(least_, doc_id) AS kept
    FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)"""
