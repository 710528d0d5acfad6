"""Quality classifier: gated-attention multiple-instance learning over the passages of a document.

A text is cut into passages of equal length, of PASSAGE bytes at most, whatever their number. Each is encoded from counts of byte classes and words (never label, language, source or
id). A learned tanh layer turns them into representations, gated attention weighs them, and a
logistic unit scores the weighted sum. Only documents are labelled; numpy and Adam fit all
parts together on the driver.

The labelled rows learned from are a bounded sample: those of the training fold with the
smallest hashes of doc_id, ``max_docs`` at most, and of each ``BAG`` passages at most, evenly spaced; of rows that share an id, the
least text, of labels that differ the greatest. Every text is scored, and whole: passages are
scored in blocks of bounded size, and a running softmax joins the blocks of a text exactly.

Null texts count as empty; an empty text is one passage without content and gets a score like
any other. Label rows that are null or lack a document are ignored; without two classes to learn
from, every score is the share of label 1 (0.5 without labels). Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwell.llm.common import crc32_mod, free, map_texts, table

PASSAGE = 600
BAG = 64  # passages of a labelled document that are learned from
CHUNK = 2_000_000  # bytes of passages that are counted at once, unless one has more
FOLDS = 5
THRESHOLD = 0.3

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "'\";:()-", "!?", "#$%&*+/<=>@[\\]^_`{|}~")
_TABLE = np.full(256, len(_CLASSES) + 1, np.uint8)
_TABLE[:128] = len(_CLASSES)
for _i, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _TABLE[ord(_c)] = _i
KINDS = len(_CLASSES) + 2
WIDTH = KINDS + 9


def blocks(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of all passages in order, and the text of each, some CHUNK bytes at a time."""
    sizes = np.array([len(r) for r in raws], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(raws)), counts)
    k = np.arange(int(counts.sum())) - np.repeat(counts.cumsum() - counts, counts)
    length = sizes[owner] * (k + 1) // counts[owner] - sizes[owner] * k // counts[owner]
    buf = np.frombuffer(b"".join(raws), np.uint8)
    upto = np.concatenate(([0], length.cumsum()))
    i = 0
    while i < len(length):  # bounds the working arrays
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + CHUNK, side="right")) - 1)
        yield np.column_stack((_features(buf[upto[i] : upto[j]], length[i:j]), np.log1p(sizes[owner[i:j]]) / 10)), owner[i:j]
        i = j


def passages(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text."""
    parts = list(blocks(raws))
    features = np.concatenate([x for x, _ in parts]) if parts else np.zeros((0, WIDTH))
    return features, np.bincount(np.concatenate([o for _, o in parts]), minlength=len(raws)) if parts else np.zeros(0, np.int64)


def _features(buf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What is counted in passages that stand one after the other; a word ends with its passage."""
    total, n = len(length), len(buf)
    kind = _TABLE[buf]
    passage = np.repeat(np.arange(total), length)
    classes = np.bincount(passage * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS).astype(np.float64)
    inner = (kind != 3) & (kind != 4)
    edge = np.zeros(n + 1, bool)
    edge[length.cumsum() - length] = True
    edge[n] = True
    starts = np.flatnonzero(inner & (edge[:-1] | ~np.append(False, inner[:-1]))) if n else np.zeros(0, np.int64)
    stops = np.flatnonzero(inner & (edge[1:] | ~np.append(inner[1:], False))) + 1 if n else starts
    of, span = passage[starts], stops - starts
    key = span.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(8):  # the first and the last bytes tell words apart well enough for shares
        head, tail = buf[starts + np.minimum(i, span - 1)], buf[stops - 1 - np.minimum(i, span - 1)]
        key = (key ^ head) * np.uint64(0x100000001B3) ^ (tail.astype(np.uint64) << np.uint64(32))
    words = np.bincount(of, minlength=total).astype(np.float64)
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    mixed = key ^ (of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(mixed, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = mixed[order[1:]] != mixed[order[:-1]]
    per = lambda mask: np.bincount(of[mask], minlength=total)
    some = np.maximum(words, 1)
    last = kind[stops - 1]
    return np.column_stack((
        classes / np.maximum(length, 1)[:, None],
        per(same) / some, np.bincount(of[order[fresh]], minlength=total) / some, np.bincount(of, span, total) / some / 10, np.bincount(of, span.astype(float) ** 2, total) / some / 100,
        per(last == 9) / some, per(last == 8) / some, per(kind[starts] == 1) / some, np.log1p(words) / 5,
    ))


@dataclass
class Attention:
    """Parameters; ``score`` takes many texts at once."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict
    prior: float | None = None

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scaled features, representations, the gate's two halves, and the logit of each passage's weight."""
        w = self.w
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["we"] + w["be"])
        v, u = np.tanh(h @ w["wv"] + w["bv"]), 1 / (1 + np.exp(-(h @ w["wu"] + w["bu"])))
        return x, h, v, u, (v * u) @ w["wa"]

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.w["wo"] + self.w["bo"], -30, 30)))

    def parts(self, x: np.ndarray, counts: np.ndarray) -> dict:
        x, h, v, u, a = self.encoded(x)
        at = counts.cumsum() - counts
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), counts))
        a /= np.repeat(np.add.reduceat(a, at), counts)
        z = np.add.reduceat(h * a[:, None], at)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "p": self.probability(z)}

    def score(self, raws: list[bytes]) -> np.ndarray:
        """The score of each text; passages come in blocks, and each text keeps its greatest logit, its sum of weights and its weighted sum."""
        if self.prior is not None:
            return np.full(len(raws), self.prior)
        most, total, z = np.full(len(raws), -np.inf), np.zeros(len(raws)), np.zeros((len(raws), len(self.w["wo"])))
        for x, owner in blocks(raws):
            _, h, _, _, a = self.encoded(x)
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            own = owner[at]
            top = np.maximum(most[own], np.maximum.reduceat(a, at))
            old = np.exp(most[own] - top)
            a = np.exp(a - np.repeat(top, np.diff(np.append(at, len(owner)))))
            total[own] = total[own] * old + np.add.reduceat(a, at)
            z[own] = z[own] * old[:, None] + np.add.reduceat(h * a[:, None], at)
            most[own] = top
        return self.probability(z / total[:, None])


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 16, gates: int = 8, steps: int = 200, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Attention:
    if not len(y) or y.min() == y.max():
        return Attention(np.zeros(WIDTH), np.ones(WIDTH), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    w = {"we": draw(WIDTH, hidden), "be": np.zeros(hidden), "wv": draw(hidden, gates), "bv": np.zeros(gates), "wu": draw(hidden, gates), "bu": np.zeros(gates), "wa": draw(gates, 1)[:, 0], "wo": draw(hidden, 1)[:, 0], "bo": np.zeros(1)}
    model = Attention(x.mean(0), x.std(0) + 1e-3, w)
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    at = counts.cumsum() - counts
    for step in range(1, steps + 1):
        f = model.parts(x, counts)
        d = (f["p"] - y) / len(y)
        dz = d[:, None] * w["wo"]
        dzr = np.repeat(dz, counts, axis=0)
        da = (dzr * f["h"]).sum(1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), counts))
        gate = da[:, None] * w["wa"]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh = (dzr * f["a"][:, None] + dv @ w["wv"].T + du @ w["wu"].T) * (1 - f["h"] ** 2)
        g = {"wo": f["z"].T @ d, "bo": d.sum(keepdims=True), "wa": (f["v"] * f["u"]).T @ da, "wv": f["h"].T @ dv, "bv": dv.sum(0), "wu": f["h"].T @ du, "bu": du.sum(0), "we": f["x"].T @ dh, "be": dh.sum(0)}
        for k in w:
            grad = g[k] + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad**2
            w[k] -= rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 2500, seed: int = 3) -> Attention:
    """Fit on the bounded sample; only its features reach the driver."""
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", FOLDS) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, 2 * max_docs / max(own.count(), 1))  # so that few more rows than the sample are sorted
    chosen = own.filter(place <= int(share * (1 << 30))).orderBy(place, "doc_id").limit(max_docs)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one row for each id: max_docs at most

    def run(part, texts):
        x, counts = passages([t.encode("utf-8", "replace") for t in texts])
        ends = counts.cumsum()
        bags = [x[e - c : e] if c <= BAG else x[e - c + np.arange(BAG) * c // BAG] for e, c in zip(ends, counts)]
        return {"doc_id": part.column("doc_id"), "quality": part.column("quality"), "features": pa.array([b.astype("<f4").tobytes() for b in bags], pa.binary())}

    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    rows = map_texts(found, run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, features binary", limit=1_000_000).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["features"])))
    bags = [np.frombuffer(r["features"], "<f4").reshape(-1, WIDTH).astype(np.float64) for r in rows]
    return fit(np.concatenate(bags) if bags else np.zeros((0, WIDTH)), np.array([len(b) for b in bags]), np.array([float(r["quality"]) for r in rows]), seed=seed)


def scored(docs: DataFrame, model: Attention, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, and the score of each text as the last column: quality_score, unless that name is taken."""
    from pyspark.sql import types as T

    name = free("quality_score", keep)

    def run(part, texts):
        return {**{c: part.column(c) for c in keep}, name: model.score([t.encode("utf-8", "replace") for t in texts])}

    given = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([given.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    return map_texts(given, run, schema, limit=1_000_000)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", (crc32_mod("doc_id", FOLDS) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
