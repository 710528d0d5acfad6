import hashlib
from collections import defaultdict

import pytest

from driftwell.llm import mixing
from tests.llm.helpers import EDGES, documents


def fill(children, budget):
    """Water-filling by rounds, for (name, weight, capacity)."""
    given, rest = {}, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while rest:
        name, w, cap = rest[0]
        if cap * sum(c[1] for c in rest) <= w * budget:
            given[name] = cap
            budget -= cap
            rest = rest[1:]
        else:
            total = sum(c[1] for c in rest)
            for n, w, _ in rest:
                given[n] = w * budget // total
            break
    return given


def brute(rows, plan):
    place = lambda s: "web" if s == "src0" else "reference" if s in {f"src{i}" for i in range(1, 10)} else "community"
    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        leaves[place(source or "unknown"), lang or "unknown", source or "unknown"].append((i, len((text or "").split())))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    under = lambda *p: plan.epochs * sum(n for k, n in size.items() if k[: len(p)] == p)
    tops = fill([(d, plan.domains.get(d, 1), under(d)) for d in {k[0] for k in size}], sum(size.values()) * plan.percent // 100)
    out = {}
    for d, b in tops.items():
        for lang, b2 in fill([(x, plan.langs.get(x, 1), under(d, x)) for x in {k[1] for k in size if k[0] == d}], b).items():
            for s, b3 in fill([(x, plan.sources.get(x, 1), under(d, lang, x)) for x in {k[2] for k in size if k[:2] == (d, lang)}], b2).items():
                total = size[d, lang, s]
                full, rest = (b3 // total, b3 % total) if total else (0, 0)
                held = 0
                for i, n in sorted(leaves[d, lang, s], key=lambda r: (hashlib.md5(f"{plan.seed}|{full + 1}|{r[0]}".encode()).hexdigest(), r[1])):
                    held += n
                    out.setdefault(i, []).append(full + (held <= rest))
    return {i: sorted(v) for i, v in out.items()}


ROWS = [(i, "w " * (i * 37 % 23 + 1), ("en", "fr", "de", None)[i % 7 % 4], ("src0", "src0", "src1", "src12", "src2", None)[i % 6]) for i in range(400)] + [(1000 + i, t, "en", "src3") for i, (_, t) in enumerate(EDGES)]


@pytest.mark.parametrize("plan", [mixing.Plan(), mixing.Plan(percent=150, epochs=3, seed=5), mixing.Plan(domains={"web": 50}, percent=30), mixing.Plan(percent=100, epochs=1)])
def test_against_rounds(spark, monkeypatch, plan):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "RUN", 3)
    got = defaultdict(list)
    for r in mixing.mix(documents(spark, ROWS), plan).select("row.doc_id", "mix_copies").collect():
        got[r.doc_id].append(r.mix_copies)
    assert {i: sorted(v) for i, v in got.items()} == brute(ROWS, plan)


def test_drawn_rows_keep_their_columns(spark):
    docs = documents(spark, ROWS)
    rows = mixing.drawn(docs, mixing.Plan(percent=50, epochs=1))
    assert rows.columns == docs.columns and 0 < rows.count() < len(ROWS)
    assert mixing.drawn(docs.limit(0)).count() == 0


def test_rows_without_an_id(spark):
    rows = [(None, "a b c", "en", "src1"), (None, "a b c", "en", "src1"), (None, None, None, None), (1, "x y", "en", "src1")]
    out = mixing.mix(documents(spark, rows), mixing.Plan(percent=100, epochs=1)).collect()
    assert len(out) == 4 and sorted(r.mix_copies for r in out if r.mix_tokens) == [1, 1, 1]
