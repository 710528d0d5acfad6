import collections
import math
import re
import zlib

import numpy as np
import pytest

from driftwell.llm import lm
from tests.llm.helpers import EDGES, documents, folder


def brute(rows):
    tokens = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return {i: (h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for (i, _), t, h in zip(rows, tokens, held)}


def test_base_and_gain(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "Gamma", "delta"] + [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words[:4]) + " " + rng.choice(words) for _ in range(40)) + f" unique{i}") for i in range(120)] + [(200 + i, t) for i, (_, t) in enumerate(EDGES)]
    sf = folder(tmp_path, documents=documents(spark, rows))
    got = {r.doc_id: r for r in lm.op3_lm(spark, sf).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score <= 0
    prose = [i for i in want if want[i][0] and i < 120]
    assert sum(got[i].score for i in prose) > sum(got[i].base_score for i in prose)


def test_many_rare_words_go_through_the_join(spark):
    docs = documents(spark, [(i, " ".join(f"r{(i * 7 + k) % 90}" for k in range(30))) for i in range(20)])
    counts = lm.word_counts(docs).cache()
    few = lm.fit(docs, counts, shortlist=10, groups=50, hot=15)
    many = lm.fit(docs, counts, shortlist=10, groups=50, hot=10_000)
    a, b = ({r.doc_id: r for r in lm.score(docs, m, counts).collect()} for m in (few, many))
    assert len(few.known) <= 16 < len(many.known)
    for i in a:
        assert a[i].n_known == b[i].n_known == 31
        assert a[i].base_score == pytest.approx(b[i].base_score, abs=1e-9) and a[i].score == pytest.approx(b[i].score, abs=1e-9)


def test_outcomes_sum_to_one(spark):
    docs = documents(spark, [(i, "the cat sat on the mat and ran off " * (i % 3 + 1) + f"x{i}") for i in range(30)])
    counts = lm.word_counts(docs).cache()
    m = lm.fit(docs, counts, shortlist=5, groups=20)
    size = m.units + m.groups
    all_ = m.steps.log10(np.repeat(np.arange(size), size), np.tile(np.arange(size), size)).reshape(size, size)
    assert np.allclose((10**all_).sum(1), 1, atol=1e-5)
    for g in range(20):
        inside = [10 ** m.log_q[i] for i in range(m.units, len(m.known)) if m.known_unit[i] == m.units + g]
        assert sum(inside) + 10 ** m.share[g, 2] == pytest.approx(1)


def test_no_training_texts(spark, tmp_path):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.op3_lm(spark, folder(tmp_path, documents=documents(spark, [(held, "a b")]))).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_scores_by_hand(spark):
    """Every token's factor from the model's parts, one at a time."""
    texts = ["the cat sat on the mat", "the dog", "", "a cat ran zzz", "the the the mat"]
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)] + [(9, None)])
    counts = lm.word_counts(docs.filter("doc_id < 3")).cache()
    m = lm.fit(docs.filter("doc_id < 3"), counts, shortlist=4, groups=3, hot=2)
    n = {bytes(r.word): r.n for r in counts.collect()}
    units = m.known[: m.units]
    unit = lambda w: units.index(w) if w in units else m.units + lm.group_of(w, 3)
    row = lambda u: [float(m.steps.context[u] @ m.steps.unit[k]) + m.steps.bias[k] for k in range(m.units + 3)]
    for r in lm.score(docs, m, counts).collect():
        total, before = 0.0, unit(b"")
        for w in [*((texts + [""] * 9)[r.doc_id]).encode().split(), b""]:
            u, scores = unit(w), row(before)
            total += scores[u] / math.log(10) - math.log10(sum(math.exp(s) for s in scores))
            if u >= m.units:
                inside = {x: c for x, c in n.items() if x not in units and lm.group_of(x, 3) == u - m.units}
                held, discount = max(1, sum(inside.values())), m.share[u - m.units, 1]
                total += math.log10((inside[w] - discount) / held) if w in inside else m.share[u - m.units, 2]
            before = u
        assert r.score == pytest.approx(total, abs=1e-4)


def test_units_grow_with_the_vocabulary():
    assert lm.units_for(10**4)[0] == 1000 < lm.units_for(10**7)[0] < lm.units_for(10**9)[0]


def test_rows_and_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 400, 150))
    pairs = lm.Pairs(20, keys, rng.integers(1, 50, len(keys)))
    whole = lm.train(pairs, steps=30)
    monkeypatch.setattr(lm, "CELLS", 60)
    parts = lm.train(pairs, steps=30)
    assert np.allclose(whole.total, parts.total, atol=1e-2)
    dense = np.zeros((20, 20))
    dense[keys // 20, keys % 20] = pairs.n
    seen = dense.sum(1) > 0
    log = whole.log10(np.repeat(np.arange(20), 20), np.tile(np.arange(20), 20)).reshape(20, 20)
    uniform = np.log10((dense.sum(0) + 1) / (dense.sum() + 20))
    assert (dense * log).sum() > (dense * uniform).sum() and seen.any()


def test_empty_table(spark, tmp_path):
    sf = folder(tmp_path, documents=documents(spark, EDGES).limit(0))
    assert lm.op3_lm(spark, sf).count() == 0
