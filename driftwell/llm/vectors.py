"""Embedding near-duplicates by sorted projection passes.

Equal vectors form a class first; one of each class goes on. In each pass a vector's key is the
signs of its products with random directions, read as one number; a sign is taken against the
median of a bounded sample (``SAMPLE`` vectors) that shares the signs before it, so that a common
direction or a dense region is cut in halves as well. All keys of a pass are sorted and numbered
over the whole table, and each vector is compared with the ``window`` before it: a task has a run
of rows and the window before them, wherever partitions end, so results do not depend on their
number. Rows travel as one byte a component with a bound of what that loses; pairs the bound
cannot decide are compared from the whole vectors. Links unite; unions of all passes give
components by stars. Then the members of each component are compared in full, block by block, so
that a vector's links are complete however many its component has.

The number of passes is measured. Probes are made, each a partner of a sampled vector at a cosine just above the
threshold, and as deep among its neighbours; how often a probe shares the first signs with its
vector gives the first passes, and then the probes go through them like any row. A probe counts as met
if a link of it lies in the component of that vector. Passes are added until the target share is met in
each tenth of the probes by density. Tables of all sizes go through passes; where one window holds
all vectors, one pass compares all.

A pair links if its cosine is at the threshold or above. Within 1e-9 of it the cosine of the
doubles is taken from sums rounded once (math.fsum), so that a pair at the threshold falls alike in
every block.

Vectors that are null or zero, or hold null or non-finite components, link with nothing. Lengths must
agree (else ValueError). Ids may repeat: every row is a vector, and counts as one; different vectors
of one id are one node, whose links are those of all. Rows without an id are returned without links. An empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwell.llm.blocks import dealt, per_task
from driftwell.llm.common import Scratch, small_batches, spread_join, table
from driftwell.llm.components import components

BITS = 40  # signs of a key
WINDOW = 2048
RUN = 4  # windows that one task compares with what is before them
BLOCK = 512
CHUNK = 1024  # rows of one matrix product
EDGE = 1e-9  # about the threshold, where the exact rule decides
SAMPLE, LEAF, PROBES, NEIGHBOURS = 4096, 32, 1024, 64  # vectors that the driver fits medians to and draws probes from, those of them that share a median, probes, and neighbours of each, at most


def passes_needed(vectors: int, threshold: float, window: int = WINDOW, recall: float = 0.99) -> int:
    agree = 1 - math.acos(threshold) / math.pi
    near = agree ** max(0.0, math.log2(max(vectors, 2) / window))
    return 1 if near >= recall else math.ceil(math.log(1 - recall) / math.log(1 - near))


def _doubles(raw: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(len(raw), -1)


def _length1(data: np.ndarray) -> np.ndarray:
    return data / np.sqrt((data * data).sum(1))[:, None]


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b (doubles as given) link."""
    cosine = _length1(a) @ _length1(b).T
    near = cosine >= threshold + EDGE
    for i, j in zip(*np.nonzero(~near & (cosine >= threshold - EDGE))):
        near[i, j] = math.fsum(a[i] * b[j]) >= threshold * math.sqrt(math.fsum(a[i] * a[i]) * math.fsum(b[j] * b[j]))
    return near


class _Union:
    """Union-find over numbers below n for many pairs at once; ``edges`` joined what was apart."""

    def __init__(self, n: int):
        self.up, self.edges = np.arange(n), []

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, rows: np.ndarray, cols: np.ndarray) -> None:
        while len(rows):
            up = self.roots()
            apart = up[rows] != up[cols]
            rows, cols = rows[apart], cols[apart]
            for k in np.unique(rows, return_index=True)[1].tolist():  # one pair of each row, then those still apart
                i, j = int(rows[k]), int(cols[k])
                u, v = i, j
                while self.up[u] != u:
                    u = int(self.up[u])
                while self.up[v] != v:
                    v = int(self.up[v])
                if u != v:
                    self.up[max(u, v)] = min(u, v)
                    self.edges.append((i, j))


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id and the bytes of its doubles; null where the vector links with nothing."""

    def run(batches):
        for b in batches:
            out = []
            for v in b.column("embedding").to_pylist():
                x = None if v is None or any(c is None for c in v) else np.array(v, "<f8") + 0.0  # no negative zero
                size = 0.0 if x is None or not len(x) else float(x @ x)
                if x is not None and (size == math.inf or 0 < np.abs(x).max(initial=0) and size < 1e-200) and np.isfinite(x).all():
                    x = x / np.abs(x).max()  # same direction, within range
                    size = float(x @ x)
                out.append(x.tobytes() if size > 0 and math.isfinite(size) else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, raw binary")


def _sampled(reps: DataFrame, vectors: int, seed: int) -> tuple[list[int], np.ndarray]:
    """Ids and unit vectors of SAMPLE rows at most, by hash."""
    place = F.pmod(F.xxhash64("raw", F.lit(seed)), F.lit(1 << 30))
    share = min(1.0, 2 * SAMPLE / max(vectors, 1))  # so that few more rows than the sample are sorted
    rows = reps.filter(place <= int(share * (1 << 30))).orderBy(place, "id").limit(SAMPLE).select("id", "raw").collect()
    return [r["id"] for r in rows], _length1(_doubles(pa.array([bytes(r["raw"]) for r in rows], pa.binary())))


def probes_of(sample: np.ndarray, count: int, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A partner just above the threshold for each of the first ``count``, as deep among its neighbours as itself; of whom it is; its tenth by density."""
    rng = np.random.default_rng(seed)
    t = threshold + 0.05 * (1 - threshold)
    made, of, near = [], [], []
    for n, x in enumerate(sample[:count]):
        gaps = sample @ x
        order = np.argsort(-np.where(gaps >= threshold, -2.0, gaps), kind="stable")[: min(NEIGHBOURS, int((gaps < threshold).sum()))]
        mean = sample[order].sum(0) if len(order) else x
        mean = mean / max(math.sqrt(mean @ mean), 1e-300)
        cos = float(mean @ x)
        inward = mean - cos * x
        size = math.sqrt(inward @ inward)
        inward = inward / size if size > 1e-9 else np.zeros_like(x)
        side = rng.choice((-1.0, 1.0), len(order)) @ sample[order] if len(order) else rng.normal(size=len(x))
        side = side - (side @ x) * x
        side = side - (side @ inward) * inward
        length = math.sqrt(side @ side)
        if length < 1e-9 and size <= 1e-9:
            continue
        part = min(1.0, max(0.0, cos * (1 - t) / (math.sqrt(1 - t * t) * size))) if size > 1e-9 and t < 1 else 0.0
        away = inward if length < 1e-9 else part * inward + math.sqrt(1 - part * part) * side / length
        made.append(t * x + math.sqrt(1 - t * t) * away)
        of.append(n)
        near.append(float(gaps[order].mean()) if len(order) else 0.0)
    if not made:
        return np.zeros((0, sample.shape[1])), np.zeros(0, int), np.zeros(0, int)
    return np.array(made), np.array(of), np.argsort(np.argsort(near, kind="stable")) * 10 // len(near)


def _medians(sample: np.ndarray, directions: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each of the first signs a median by the signs before it, and for the leaves so reached the medians of all other signs."""
    level = max(0, int(math.log2(max(len(sample), 1) / LEAF)))
    along = sample @ directions.T
    node, cuts = np.zeros(len(sample), np.int64), []
    for k in range(level):
        cut = np.array([np.median(along[node == n, k]) if (node == n).any() else 0.0 for n in range(1 << k)])
        node = 2 * node + (along[:, k] > cut[node])
        cuts.append(cut)
    return cuts, np.array([np.median(along[node == n, level:], axis=0) if (node == n).any() else np.zeros(BITS - level) for n in range(1 << level)])


def _keys(x: np.ndarray, directions: np.ndarray, cuts: list[np.ndarray], leaves: np.ndarray) -> np.ndarray:
    along = x @ directions.T
    node = np.zeros(len(x), np.int64)
    for k, cut in enumerate(cuts):
        node = 2 * node + (along[:, k] > cut[node])
    rest = along[:, len(cuts) :] > leaves[node]
    return (node << rest.shape[1]) + rest.astype(np.int64) @ (np.int64(1) << np.arange(rest.shape[1] - 1, -1, -1, dtype=np.int64))


def _passes_for(sample: np.ndarray, probes: np.ndarray, of: np.ndarray, tenth: np.ndarray, vectors: int, window: int, recall: float, seed: int, trials: int = 16) -> int:
    """Passes by the share of probes, in the worst tenth, that agree with their vectors in the signs that leave ``window`` vectors together."""
    signs = min(BITS, math.ceil(max(0.0, math.log2(vectors / window))))
    together = np.zeros(len(probes))
    for p in range(trials):
        directions = np.random.default_rng([seed, p]).normal(size=(BITS, sample.shape[1]))
        fitted = _medians(sample, directions)
        together += _keys(probes, directions, *fitted) >> (BITS - signs) == _keys(sample[of], directions, *fitted) >> (BITS - signs)
    near = min(1 - 1e-9, max(1 / (2 * trials * len(probes)), min(together[tenth == k].mean() / trials for k in np.unique(tenth))))
    return max(1, math.ceil(math.log(max(1 - recall, 1e-12)) / math.log(1 - near)))


def _codes(x: np.ndarray) -> list[bytes]:
    """One byte for each component, then the scale and the length of what is lost, rounded up."""
    scale = (np.abs(x).max(1) / 127).astype("<f4")
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    off = x - q * scale[:, None].astype(float)
    lost = (np.sqrt((off * off).sum(1)) * (1 + 1e-6) + 1e-9).astype("<f4")
    return [a.tobytes() + b.tobytes() + c.tobytes() for a, b, c in zip(q, scale, lost)]


def _numbered(reps: DataFrame, numbers: range, sample: np.ndarray, probes: np.ndarray, seed: int, scratch: Scratch) -> DataFrame:
    """task, number, id, probe and code: rows of each pass in the order of their keys, numbered over the whole table."""
    width = sample.shape[1]
    spark = reps.sparkSession
    fitted = {p: _medians(sample, np.random.default_rng([seed, p]).normal(size=(BITS, width))) for p in numbers}
    held = spark.sparkContext.broadcast(fitted)  # SAMPLE / LEAF medians for each sign and pass

    def keys(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                x = _length1(_doubles(b.column("raw")))
                codes = pa.array(_codes(x), pa.binary())
                for p in numbers:
                    key = _keys(x, np.random.default_rng([seed, p]).normal(size=(BITS, width)), *held.value[p])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p), pa.int32()), pa.array(key), b.column("id"), b.column("probe"), codes], names=["pass", "key", "id", "probe", "code"])

    def count(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            numbers_ = b.column("pass").to_numpy()
            place = np.empty(len(numbers_), np.int64)
            for p in np.unique(numbers_).tolist():
                own = numbers_ == p
                first = seen.get(p, 0)
                seen[p] = first + int(own.sum())
                place[own] = np.arange(first, seen[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers_), part), pa.int32()), pa.array(place), *(b.column(c) for c in ("pass", "id", "probe", "code"))], names=["part", "place", "pass", "id", "probe", "code"])

    all_ = reps.select("id", "raw", F.lit(-1).alias("probe"))
    if len(probes):
        all_ = all_.unionByName(spark.createDataFrame([(-1, bytearray(v.tobytes()), i) for i, v in enumerate(probes)], "id long, raw binary, probe int"))
    keyed = all_.mapInArrow(keys, "pass int, key long, id long, probe int, code binary")
    in_order = keyed.repartitionByRange("pass", "key", "id").sortWithinPartitions("pass", "key", "id", "probe", "code")
    placed = scratch.write(in_order.mapInArrow(count, "part int, place long, pass int, id long, probe int, code binary"), "vector-order")
    before, upto = [], {}
    for r in placed.groupBy("pass", "part").agg(F.count("*").alias("n")).orderBy("pass", "part").collect():  # one row for each partition, and one more for each pass
        before.append((r["pass"], r["part"], upto.get(r["pass"], 0)))
        upto[r["pass"]] = upto.get(r["pass"], 0) + r["n"]
    offsets = spark.createDataFrame(before, "pass int, part int, before long")
    return placed.join(F.broadcast(offsets), ["pass", "part"]).select("pass", (F.col("before") + F.col("place")).alias("number"), "id", "probe", "code")


def _compared(rows: DataFrame, threshold: float, window: int) -> DataFrame:
    """What each run of rows finds: edges (a, b), links of probes (a, probe), and members (task, a or probe) that need the whole vectors."""
    run_ = RUN * window

    def compare(batch: pa.RecordBatch) -> dict:
        task, number = batch.column("task")[0].as_py(), batch.column("number").to_numpy()
        ids, probes = batch.column("id").to_numpy(), batch.column("probe").to_numpy()
        first = int(np.searchsorted(number, (task & 0xFFFFFFFFFF) * run_))
        data = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        tail = data[:, -8:].copy().view("<f4").astype(float)
        lost, x = tail[:, 1], data[:, :-8].view(np.int8).astype(np.float32) * tail[:, :1].astype(np.float32)
        most, rounding = float(lost.max()), 1e-5 + 2e-7 * x.shape[1]
        forest, unsure, met = _Union(len(ids)), np.zeros(len(ids), bool), []
        for at in range(first, len(ids), CHUNK):
            end, low = min(at + CHUNK, len(ids)), max(0, at - window)
            product = x[at:end] @ x[low:end].T
            row, col = np.nonzero(product >= threshold - 2 * most - most * most - rounding)
            value = product[row, col].astype(float)
            row, col = row + at, col + low
            slack = lost[row] * (1 + lost[col]) + lost[col] + rounding
            wanted = (col < row) & (row - col <= window) & (value + slack >= threshold) & ~((probes[row] >= 0) & (probes[col] >= 0))
            row, col, sure = row[wanted], col[wanted], (value - slack >= threshold)[wanted]
            probe = (probes[row] >= 0) | (probes[col] >= 0)
            forest.join(row[sure & ~probe], col[sure & ~probe])
            r, c = row[sure & probe], col[sure & probe]
            met.append(np.column_stack((np.maximum(probes[r], probes[c]), np.where(probes[r] >= 0, c, r))))
            up = forest.roots()
            open_ = ~sure & (probe | (up[row] != up[col]))
            unsure[row[open_]] = unsure[col[open_]] = True
        up = forest.roots()
        links = np.concatenate(met) if met else np.zeros((0, 2), int)
        links = np.unique(np.column_stack((links[:, 0], up[links[:, 1]])), axis=0)
        edges = np.array(forest.edges, int).reshape(-1, 2)
        left = np.flatnonzero(unsure)
        no = [None] * len(edges)
        return {
            "task": no + [None] * len(links) + [task] * len(left), "a": [*ids[edges[:, 0]].tolist(), *ids[links[:, 1]].tolist(), *ids[left].tolist()],
            "b": [*ids[edges[:, 1]].tolist(), *([None] * (len(links) + len(left)))], "probe": [*no, *links[:, 0].tolist(), *probes[left].tolist()],
        }

    block = F.expr(f"number div {run_}")
    both = F.when(F.col("number") % run_ >= run_ - window, F.array(block, block + 1)).otherwise(F.array(block))
    dealt_ = rows.withColumn("block", F.explode(both)).select((F.shiftleft(F.col("pass").cast("long"), 40) + F.col("block")).alias("task"), "number", "id", "probe", "code")
    return per_task(dealt_, compare, "task long, a long, b long, probe int", order=("number",))


def _settled(members: DataFrame, probes: np.ndarray, threshold: float) -> DataFrame:
    """Edges (a, b) and links of probes (a, probe) among members (task, a, probe, raw) of each task, from the whole vectors."""

    def run(batch: pa.RecordBatch) -> dict:
        ids, own = batch.column("a").to_numpy(), batch.column("probe").to_numpy()
        x = np.array([probes[p] if p >= 0 else np.frombuffer(r, "<f8") for p, r in zip(own.tolist(), batch.column("raw").to_pylist())])
        forest, met = _Union(len(ids)), []
        for at in range(0, len(ids), CHUNK):
            row, col = np.nonzero(_linked(x[at : at + CHUNK], x[: at + CHUNK], threshold))
            row = row + at
            below = col < row
            row, col = row[below], col[below]
            probe = (own[row] >= 0) | (own[col] >= 0)
            forest.join(row[~probe], col[~probe])
            one = probe & ((own[row] < 0) | (own[col] < 0))
            r, c = row[one], col[one]
            met.append(np.column_stack((np.maximum(own[r], own[c]), np.where(own[r] >= 0, c, r))))
        links = np.concatenate(met)
        links = np.unique(np.column_stack((links[:, 0], forest.roots()[links[:, 1]])), axis=0)
        edges = np.array(forest.edges, int).reshape(-1, 2)
        return {
            "a": [*ids[edges[:, 0]].tolist(), *ids[links[:, 1]].tolist()], "b": [*ids[edges[:, 1]].tolist(), *([None] * len(links))],
            "probe": [*([None] * len(edges)), *links[:, 0].tolist()],
        }

    return per_task(members, run, "a long, b long, probe int", order=("probe", "a"))


def _pass_edges(reps: DataFrame, numbers: range, sample: np.ndarray, probes: np.ndarray, threshold: float, window: int, seed: int, scratch: Scratch) -> DataFrame:
    """Verified edges (a, b) that unite what the windows of the passes link, and links of probes (a, probe)."""
    found = scratch.write(_compared(_numbered(reps, numbers, sample, probes, seed, scratch), threshold, window), "vector-found")
    open_ = found.filter("task is not null").drop("b")
    whole = open_.filter("probe < 0").join(reps.select(F.col("id").alias("a"), "raw"), "a").select("task", "a", "probe", "raw")
    whole = whole.unionByName(open_.filter("probe >= 0").select("task", "a", "probe", F.lit(None).cast("binary").alias("raw")))
    settled = scratch.write(_settled(whole, probes, threshold), "vector-settled")
    return found.filter("task is null").drop("task").unionByName(settled)


def _groups(reps: DataFrame, threshold: float, window: int, recall: float, seed: int, scratch: Scratch) -> DataFrame:
    """(id, component) of all vectors with links, up to the recall."""
    spark, vectors = reps.sparkSession, reps.count()
    if not vectors:
        return spark.createDataFrame([], "id long, component long")
    ids, sample = _sampled(reps, vectors, seed)
    made, of, tenth = probes_of(sample, min(PROBES, max(64, vectors // 16)) if vectors > window else 0, threshold, seed)  # one window that holds all needs none
    total, more = 0, _passes_for(sample, made, of, tenth, vectors, window, recall, seed) if len(made) else passes_needed(vectors, threshold, window, recall)
    partners = spark.createDataFrame([(k, ids[n]) for k, n in enumerate(of.tolist())], "probe int, partner long")
    found = None
    while True:
        out = _pass_edges(reps, range(total, total + more), sample, made, threshold, window, seed, scratch)
        found = out if found is None else found.unionByName(out)
        total += more
        links = found.filter("probe is not null").select("probe", "a")
        met = np.zeros(len(made), bool)
        met[[r["probe"] for r in links.select("probe").distinct().collect()]] = True  # PROBES rows at most
        if (missed := _worst(met, tenth)) <= 1 - recall + 1e-12:  # components can only lower it
            groups = scratch.write(components(found.filter("probe is null").select("a", "b"), "vectors"), "vector-components")
            if not len(made):
                return groups
            where = lambda rows, column, name: rows.join(groups.withColumnRenamed("id", column), column, "left").select("probe", F.coalesce("component", column).alias(name))
            seen = where(links, "a", "one").join(F.broadcast(where(partners, "partner", "other")), "probe").filter("one = other").select("probe").distinct().collect()  # PROBES rows at most
            met[:] = False
            met[[r["probe"] for r in seen]] = True
            if (missed := _worst(met, tenth)) <= 1 - recall + 1e-12:
                return groups
        wanted = total if missed >= 1 else math.ceil(total * math.log(1 - recall) / math.log(missed)) - total if recall < 1 else total
        more = min(total, max(wanted, total // 4, 1))


def _worst(met: np.ndarray, tenth: np.ndarray) -> float:
    """The largest share of probes not met in a tenth."""
    return max((float(1 - met[tenth == k].mean()) for k in np.unique(tenth)), default=0.0)


def _count(threshold: float):
    def run(batch: pa.RecordBatch) -> dict:
        ids, side = batch.column("id").to_numpy(), batch.column("side").to_numpy()
        x, times = _doubles(batch.column("raw")), batch.column("times").to_numpy()
        if side[0] == 0:
            near = _linked(x, x, threshold)
            np.fill_diagonal(near, False)
            return {"id": ids, "n": near @ times}
        first = side == 1
        near = _linked(x[first], x[~first], threshold)
        return {"id": ids, "n": np.concatenate((near @ times[~first], near.T @ times[first]))}

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, window: int = WINDOW, recall: float = 0.99, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    small_batches(vectors.sparkSession)
    with Scratch(vectors.sparkSession) as scratch:
        rows = scratch.write(_classes(vectors), "vectors", read_later=True)
        known = rows.filter("raw is not null and vec_id is not null")
        reps = scratch.write(known.groupBy("raw").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("times")), "vector-classes")
        sizes = [r[0] for r in reps.select(F.octet_length("raw").alias("w")).distinct().orderBy("w").limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError("vectors differ in length")
        groups = _groups(reps, threshold, window, recall, seed, scratch)
        members = scratch.write(reps.join(groups, "id").select(F.col("component").alias("grp"), "id", "raw", "times"), "vector-members")
        counted = per_task(dealt(members, BLOCK), _count(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        summary = reps.join(groups, "id", "left").join(counted, "id", "left").select("raw", "times", F.coalesce("component", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"))
        summary = scratch.write(summary, "vector-links", read_later=True)
        total = reps.agg(F.sum("times")).first()[0] or 0
    found = spread_join(rows, summary, "raw", "times", total)
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return found.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS least_ FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least_, vec_id)) AS component_id, vec_id <= coalesce(least_, vec_id) AS kept
    FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""
