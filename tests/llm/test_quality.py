import math
import zlib

import numpy as np

from driftwell.llm import quality
from tests.llm.helpers import EDGES, documents, folder


def corpus():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeinorst"), rng.integers(2, 9))) for _ in range(500)]
    rows, marks = [], []
    for i in range(300):
        own = rng.choice(words, 150)
        bad = i % 3 == 0
        text = " ".join(w + "%%%" for w in own) if bad and i % 2 else " ".join(np.repeat(own[:20], 8)) if bad else " ".join(own) + "."
        rows.append((i, text))
        marks.append((i, 0 if bad else 1, 0))
    return rows, marks


def test_held_out_documents(spark, tmp_path):
    rows, marks = corpus()
    labels = spark.createDataFrame([*marks, (None, 1, 0), (5, None, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    sf = folder(tmp_path, documents=documents(spark, [*rows, *((1000 + i, t) for i, (_, t) in enumerate(EDGES))]), labels=labels)
    got = {r.doc_id: r for r in quality.op7_quality(spark, sf).collect()}
    assert len(got) == len(rows) + len(EDGES)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == marks[i][1] for i in held]) > 0.95


def test_without_classes(spark):
    docs = documents(spark, EDGES)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r[-1] for r in quality.scored(docs, quality.learn(docs, empty), ["doc_id"]).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert {r[-1] for r in quality.scored(docs, quality.learn(docs, one), ["doc_id"]).collect()} == {1.0}
    assert quality.scored(docs.limit(0), quality.learn(docs, one), docs.columns).count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    counts = np.array([2, 1, 3])
    x = rng.normal(size=(6, quality.WIDTH))
    y = np.array([1.0, 0.0, 1.0])
    m = quality.fit(x, counts, y, steps=60)
    p = m.parts(x, counts)["p"]
    assert (p[[0, 2]] > 0.8).all() and p[1] < 0.2
    assert np.allclose(np.add.reduceat(m.parts(x, counts)["a"], [0, 2, 3]), 1)


def test_cutting_into_chunks_changes_nothing(monkeypatch):
    texts = [t.encode() for _, t in corpus()[0][:20]] + [b"", b"x" * 5000]
    whole, counts = quality.passages(texts)
    monkeypatch.setattr(quality, "CHUNK", 700)
    parts, again = quality.passages(texts)
    assert np.allclose(whole, parts) and (counts == again).all()


def test_repeated_rows_do_not_push_others_out(spark):
    ids = [i for i in range(30) if zlib.crc32(str(i).encode()) % 5][:10]
    labels = spark.createDataFrame([(i, int(k == 0)) for k, i in enumerate(ids)], "doc_id long, quality int")
    docs = documents(spark, [(i, f"text {i}") for i in ids] + [(ids[0], f"text {ids[0]}")] * 45)
    assert quality.learn(docs, labels, max_docs=20).prior is None


def plain_features(raw):
    """Each passage's features, byte by byte and word by word."""
    rows, count = [], max(1, -(-len(raw) // quality.PASSAGE))
    for k in range(count):
        part = raw[len(raw) * k // count : len(raw) * (k + 1) // count]
        kinds = [next((n for n, chars in enumerate(quality._CLASSES) if chr(b) in chars), len(quality._CLASSES)) if b < 128 else quality.KINDS - 1 for b in part]
        words, own = [], []
        for b, kind in zip(part, kinds):
            if kind in (3, 4):
                words, own = words + [own] * bool(own), []
            else:
                own = own + [(b, kind)]
        words += [own] * bool(own)
        texts = [bytes(b for b, _ in w) for w in words]
        some = max(1, len(words))
        rows.append([
            *(kinds.count(n) / max(1, len(part)) for n in range(quality.KINDS)), sum(a == b for a, b in zip(texts, texts[1:])) / some, len(set(texts)) / some, sum(map(len, texts)) / some / 10,
            sum(len(t) ** 2 for t in texts) / some / 100, sum(w[-1][1] == 9 for w in words) / some, sum(w[-1][1] == 8 for w in words) / some, sum(w[0][1] == 1 for w in words) / some, math.log1p(len(words)) / 5, math.log1p(len(raw)) / 10,
        ])
    return rows


def plain_score(m, rows):
    """Gated attention over the passages, without arrays."""
    mul = lambda x, w, b: [sum(x[i] * w[i][j] for i in range(len(x))) + b[j] for j in range(len(b))]
    logits, hidden = [], []
    for x in rows:
        x = [min(6.0, max(-6.0, (v - a) / s)) for v, a, s in zip(x, m.mean, m.scale)]
        h = [math.tanh(v) for v in mul(x, m.w["we"], m.w["be"])]
        gate = [math.tanh(a) / (1 + math.exp(-b)) for a, b in zip(mul(h, m.w["wv"], m.w["bv"]), mul(h, m.w["wu"], m.w["bu"]))]
        logits.append(sum(g * w for g, w in zip(gate, m.w["wa"])))
        hidden.append(h)
    weights = [math.exp(a - max(logits)) for a in logits]
    z = [sum(w * h[j] for w, h in zip(weights, hidden)) / sum(weights) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-min(30, max(-30, sum(v * w for v, w in zip(z, m.w["wo"])) + m.w["bo"][0]))))


def test_features_and_scores_by_hand(monkeypatch):
    texts = [t for _, t in corpus()[0][:12]] + ["", " ", "one", "Ünï códe 😀 WHAT?! now# a a a\nB\tc", "w " * 9000, "x" * 4000]
    raws = [t.encode() for t in texts]
    x, counts = quality.passages(raws)
    want = [r for raw in raws for r in plain_features(raw)]
    assert counts.tolist() == [len(plain_features(raw)) for raw in raws] and np.allclose(x, want)
    m = quality.fit(x, counts, np.arange(len(raws)) % 2 * 1.0, steps=20)
    scores = [plain_score(m, plain_features(raw)) for raw in raws]
    assert np.allclose(m.score(raws), scores)
    monkeypatch.setattr(quality, "CHUNK", 1500)  # long texts come in several blocks
    assert np.allclose(m.score(raws), scores)


def test_differing_labels_and_long_documents(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:6]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)] + [(ids[0], 1)], "doc_id long, quality int")
    docs = documents(spark, [(i, ("good text. " if k % 2 or not k else "%%% ## ") * 20_000) for k, i in enumerate(ids)])
    assert quality.learn(docs, labels).prior is None  # the greatest label counts, and a bag is bounded
