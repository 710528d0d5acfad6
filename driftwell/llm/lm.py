"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are words between ASCII white space with A-Z in lower case, and one end after each text.
The model's units are its ``shortlist`` most frequent tokens, the end among them, and ``groups``
spelling groups (by the last three bytes) that share out all other words. Both grow with the
vocabulary, with its fourth root (``units_for``), so that the pairs of units, which the driver gathers, grow
with the root of the words. A context is the unit
before (the end, before the first token). The score of a unit after a context is the product of
two learned vectors and the unit's bias; batched matrix products give the sum over all units for every
context, and with it normalised log-probabilities. Inside a group a word has its discounted share of the
group's count. Words never seen in training are one outcome of their group and take the
discounted mass, so that all outcomes sum to one.

What is learned covers all training texts: counts of all words (shuffled after partial sums) and
counts of all unit pairs that occur. NCE takes its expectation over these pair
counts and the unigram noise itself, in numpy on the driver, CELLS scores at a time; nothing is sampled.

Scoring looks words up in a table of at most ``hot`` frequent words that every task holds; all
others, whatever their number, are joined with the counts by a shuffle (a word that only held-out
texts have, and many of them, is split by Spark's adaptive skew join).

Null texts count as empty and score their end alone. Repeated rows score alike. Without training
texts counts are 0 and the model is uniform over its units.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwell.llm.common import crc32_mod, map_texts, small_batches, table, written

END = b""  # no word is empty
FOLDS, HELD = 7, 2
LIMIT = 1_000_000
KEPT = 200_000  # counts and spellings that a task keeps
PAIRS = 1_000_000  # counts of unit pairs that a task keeps
CELLS = 4_000_000  # scores that the driver computes at once


def units_for(distinct: int) -> tuple[int, int]:
    """Shortlist and groups for a vocabulary."""
    shortlist = max(1000, math.ceil(30 * distinct**0.25))
    return shortlist, shortlist // 5


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def group_of(word: bytes, groups: int) -> int:
    return zlib.crc32(word[-3:]) % groups


def _group(word, groups: int):
    """``group_of`` as a column."""
    return F.pmod(F.crc32(F.substring(word, -3, 3)), F.lit(groups)).cast("int")


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all texts of ``docs``."""

    def run(batches):
        from driftwell.llm.common import text_slices

        held: Counter = Counter()

        def emit():
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, texts in text_slices(batch, "text", LIMIT):
                for t in texts:
                    held.update(words(t))
                held[END] += len(texts)
                if len(held) > KEPT:
                    yield emit()
        if held:
            yield emit()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Index(dict):
    """word -> place in the table of known words, or for any other ``first`` plus its group."""

    def __init__(self, known: list[bytes], first: int, groups: int):
        super().__init__(zip(known, range(len(known))))
        self.first, self.groups, self.most = first, groups, len(known) + KEPT

    def __missing__(self, word: bytes) -> int:
        got = self.first + group_of(word, self.groups)
        if len(self) < self.most and len(word) <= 64:
            self[word] = got
        return got


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


@dataclass
class Pairs:
    """Counts of (unit before, unit) that occur, in order; ``size`` units."""

    size: int
    keys: np.ndarray
    n: np.ndarray


def pair_counts(docs: DataFrame, units: list[bytes], groups: int) -> Pairs:
    """From all texts of ``docs``."""
    size = len(units) + groups

    def run(batches):
        from driftwell.llm.common import text_slices

        index = _Index(units, len(units), groups)
        end = index[END]
        keys, counts, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def out():
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000]), pa.array(counts[i : i + 200_000])], names=["pair", "n"])

        for batch in batches:
            for _, texts in text_slices(batch, "text", LIMIT):
                flat = [end]
                for t in texts:
                    flat += map(index.__getitem__, words(t))
                    flat.append(end)
                u = np.array(flat, np.int64)
                fresh.append(np.unique(u[:-1] * size + u[1:], return_counts=True))
                if sum(len(k) for k, _ in fresh) > PAIRS:
                    keys, counts = _summed(np.concatenate((keys, *(k for k, _ in fresh))), np.concatenate((counts, *(n for _, n in fresh))))
                    fresh = []
                    if len(keys) > PAIRS:
                        yield from out()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = _summed(np.concatenate((keys, *(k for k, _ in fresh))), np.concatenate((counts, *(n for _, n in fresh))))
        yield from out()

    small_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # pairs of units: some 1300 times the root of distinct words at most
    return Pairs(size, *_summed(found.column("pair").to_numpy(), found.column("n").to_numpy()))


@dataclass
class Bilinear:
    """Vectors of contexts and of units, biases, and the log of each context's sum; all natural logs."""

    context: np.ndarray
    unit: np.ndarray
    bias: np.ndarray
    total: np.ndarray

    def log10(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The log10 probability of each unit after the unit before it."""
        product = np.einsum("ij,ij->i", self.context[before], self.unit[after]).astype(np.float64)
        return (product + self.bias[after] - self.total[before]) / math.log(10)


def train(pairs: Pairs, width: int = 32, noise: int = 20, steps: int = 120, rate: float = 0.05, decay: float = 1e-7, seed: int = 5) -> Bilinear:
    size, total = pairs.size, float(pairs.n.sum())
    if not total:
        return Bilinear(np.zeros((size, width), np.float32), np.zeros((size, width), np.float32), np.zeros(size), np.full(size, math.log(size)))
    before, after, share = (pairs.keys // size).astype(np.int32), (pairs.keys % size).astype(np.int32), (pairs.n / total).astype(np.float32)
    unigram = (np.bincount(after, share, size) * total + 1) / (total + size)
    contexts = np.bincount(before, share, size)
    rng = np.random.default_rng(seed)
    w = {"context": rng.normal(0, 0.1, (size, width)).astype(np.float32), "unit": rng.normal(0, 0.1, (size, width)).astype(np.float32), "bias": np.log(unigram)}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    offset = np.log(noise * unigram)
    scale = (1 / np.sqrt(np.maximum(contexts, 1e-6))).astype(np.float32)[:, None]  # rare contexts learn as fast as common ones
    rows = max(1, CELLS // size)
    blocks = [(a, min(a + rows, size)) for a in range(0, size, rows)]
    at = [np.searchsorted(before, block) for block in blocks]
    for step in range(1, steps + 1):
        g = {k: np.zeros_like(x) for k, x in w.items()}
        for (a, b), (first, last) in zip(blocks, at):
            s = w["context"][a:b] @ w["unit"].T + (w["bias"] - offset).astype(np.float32)
            np.clip(s, -30, 30, out=s)
            np.exp(-s, out=s)
            s += 1
            np.reciprocal(s, out=s)  # that a pair is no noise
            own = before[first:last] - a, after[first:last]
            more = share[first:last] * (s[own] - 1)
            s *= (noise * contexts[a:b, None] * unigram).astype(np.float32)
            s[own] += more  # slope of the NCE loss in each score
            g["context"][a:b] = s @ w["unit"] * scale[a:b]
            g["unit"] += s.T @ w["context"][a:b]
            g["bias"] += s.sum(0)
        for k in w:
            grad = g[k] + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            w[k] = (w[k] - rate * (1 - 0.95 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-10)).astype(w[k].dtype)
    sums = np.empty(size)
    for a, b in blocks:
        s = (w["context"][a:b] @ w["unit"].T).astype(np.float64) + w["bias"]
        top = s.max(1)
        sums[a:b] = top + np.log(np.exp(s - top[:, None]).sum(1))
    return Bilinear(w["context"], w["unit"], w["bias"], sums)


@dataclass
class Model:
    """units come first in known; ``share`` has for each group: count, discount, log10 of the mass for unseen words."""

    known: list[bytes]
    counts: np.ndarray
    units: int
    known_unit: np.ndarray
    log_q: np.ndarray
    steps: Bilinear
    share: np.ndarray
    tokens: int
    distinct: int
    groups: int


def fit(docs: DataFrame, counts: DataFrame, shortlist: int | None = None, groups: int | None = None, hot: int = 200_000, seed: int = 5) -> Model:
    """``docs``: the training texts; ``counts``: their words, written. Units follow from the vocabulary unless they are given."""
    bins = F.floor(F.log2("n") * 8).cast("int")
    spread = counts.groupBy(bins.alias("b")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()  # some 500 bins at most
    tokens, distinct = sum(r["n"] for r in spread), sum(r["k"] for r in spread)
    wanted = units_for(distinct)
    shortlist, groups = shortlist or wanted[0], groups or wanted[1]
    seen, least = 0, 10**6
    for r in sorted(spread, key=lambda r: -r["b"]):
        seen += r["k"]
        if seen > hot:
            break
        least = r["b"]
    frequent = counts.filter((bins >= least) | (F.col("word") == F.lit(END))).toArrow()  # ``hot`` words at most, and the end
    order = sorted(((w, group_of(w, groups), n) for w, n in zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist())), key=lambda x: (x[0] != END, -x[2], x[0]))
    units = [x[0] for x in order[:shortlist]] or [END]
    size = len(units)
    rows = counts.groupBy(_group("word", groups).alias("grp")).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()  # one for each group
    of = np.zeros((groups, 4))
    for r in rows:
        of[r["grp"]] = r["n"], r["k"], r["one"], r["two"]
    for word, grp, n in order[:size]:
        of[grp] -= n, 1, n == 1, n == 2
    discount = np.clip((of[:, 2] + 0.5) / (of[:, 2] + 2 * of[:, 3] + 1), 0.05, 0.95)
    some = np.maximum(of[:, 0], 1)
    unseen = np.where(of[:, 0] > 0, discount * of[:, 1] / some, 1.0)
    share = np.column_stack((some, discount, np.log10(unseen)))
    pairs = pair_counts(docs, units, groups)
    n = np.array([x[2] for x in order], np.int64)
    grp = np.array([x[1] for x in order], np.int64)
    unit = np.where(np.arange(len(order)) < size, np.arange(len(order)), size + grp)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_q = np.where(np.arange(len(order)) < size, 0.0, np.log10((n - discount[grp]) / some[grp]))
    if not order:
        n, unit, log_q = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1)
    return Model([x[0] for x in order] or [END], n, size, unit, log_q, train(pairs, seed=seed), share, tokens, distinct, groups)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every text."""
    first = len(model.known)
    unit_of = np.concatenate((model.known_unit, model.units + np.arange(model.groups)))
    log_q = np.concatenate((model.log_q, np.zeros(model.groups)))
    log_c = np.concatenate((np.log10(model.counts + 1.0), np.zeros(model.groups)))
    is_known = np.concatenate((model.counts > 0, np.zeros(model.groups, bool)))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.known, unit_of, log_q, log_c, is_known, model.steps))  # ``hot`` words, and two vectors for each unit
    groups = model.groups
    state: dict = {}

    def run(part, texts):
        known, units, q, c, sure, steps = held.value
        if "index" not in state:
            state["index"], state["row"] = _Index(known, first, groups), TaskContext.get().partitionId() << 36
        index, end = state["index"].__getitem__, state["index"][END]
        made: dict[str, list] = {k: [] for k in ("rid", "n_tokens", "n_known", "base", "model", "rare")}
        for t in texts:
            own = words(t)
            at = np.fromiter(map(index, own), np.int64, len(own))
            at = np.append(at, end)
            u = units[at]
            state["row"] += 1
            made["rid"].append(state["row"])
            made["n_tokens"].append(len(at))
            made["n_known"].append(int(sure[at].sum()))
            made["base"].append(float(c[at].sum()))
            made["model"].append(float(steps.log10(np.append(units[end], u[:-1]), u).sum() + q[at].sum()))
            made["rare"].append([{"word": w, "times": k} for w, k in Counter(own[i] for i in np.flatnonzero(at >= first).tolist()).items()])
        return {"doc_id": part.column("doc_id"), **made}

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, rid long, n_tokens long, n_known long, base double, model double, rare array<struct<word:binary,times:int>>", limit=LIMIT)
    slim, _ = written(slim, "lm-scored")
    share = spark.createDataFrame([(g, *map(float, x)) for g, x in enumerate(model.share)], "grp int, total double, discount double, unseen double")  # one row for each group
    rare = slim.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    rated = counts.withColumn("grp", _group("word", groups)).join(F.broadcast(share), "grp").select("word", "n", F.log10((F.col("n") - F.col("discount")) / F.col("total")).alias("q"))
    met = rare.join(rated, "word", "left").withColumn("grp", _group("word", groups)).join(F.broadcast(share.select("grp", "unseen")), "grp")
    sums = met.groupBy("rid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.coalesce(F.log10(F.col("n") + 1.0), F.lit(0.0))).alias("more_base"),
        F.sum(F.col("times") * F.coalesce("q", "unseen")).alias("more_model"),
    )
    each = math.log10(model.tokens + model.distinct + 1)
    return slim.join(sums, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"), (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score"),
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.filter(crc32_mod("doc_id", FOLDS) != HELD)
    counts, _ = written(word_counts(learned), "lm-counts")
    model = fit(learned, counts)
    return score(docs, model, counts).select("doc_id", (crc32_mod("doc_id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
