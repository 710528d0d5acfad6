import random

import pytest

from driftwell.llm import jaccard
from tests.llm.helpers import EDGES, documents


def brute(rows, threshold=0.8, n=5):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets.setdefault(i, []).append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    flat = [(i, s) for i, own in sets.items() for s in own]
    near = [[a != b and bool(x) and len(x & y) * 5 >= len(x | y) * 4 for b, (_, y) in enumerate(flat)] for a, (_, x) in enumerate(flat)]
    up = list(range(len(flat)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(flat)):
        for b in range(a):
            if near[a][b]:
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(flat):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, least[find(a)], sum(near[a])) for a, (i, _) in enumerate(flat))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # the large group takes several blocks
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows = [(i, " ".join(word() for _ in range(rng.randint(3, 90)))) for i in range(60)]
    base = [word() for _ in range(200)]
    for i in range(70):  # one large group of near copies
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(200)] = word()
        rows.append((100 + i, " ".join(own)))
    passage = " ".join(word() for _ in range(60))  # a passage that many share
    rows += [(300 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(40)]
    rows += [(500 + i, t) for i, (_, t) in enumerate(EDGES)] + [rows[0], (999, rows[1][1])]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.links(documents(spark, rows)).collect())
    assert got == brute(rows)


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995
    with pytest.raises(ValueError):
        jaccard.bands_for(0.3, 0.99999, max_hashes=10)


def test_empty_table_and_missing_ids(spark):
    docs = documents(spark, EDGES)
    assert jaccard.links(docs.limit(0)).count() == 0
    lost = jaccard.links(documents(spark, [(None, "a b c d e f g"), (2, "a b c d e f g")])).collect()
    assert sorted((r.doc_id is None, r.class_id) for r in lost)[0] == (False, 2)


def test_many_tasks_of_few_rows_are_not_broadcast(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    docs = documents(spark, [(i, " ".join([*base, f"own{i}"])) for i in range(60)])
    want = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.links(docs).collect())
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # 60 rows, 15 tasks each
    monkeypatch.setattr(jaccard, "SMALL", 500)

    allowed = jaccard.F.broadcast

    def refuse(frame):
        assert "task" not in frame.columns or frame.count() <= 500
        return allowed(frame)

    monkeypatch.setattr(jaccard.F, "broadcast", refuse)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.links(docs).collect()) == want
    assert want[5] == (5, 0, 59)


def test_chance_meetings_unite_nothing(spark, monkeypatch):
    """Bands of one row let texts with few shared n-grams meet; only links make groups, and no link is lost."""
    monkeypatch.setattr(jaccard, "bands_for", lambda threshold, recall: (24, 1))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for g in range(12):  # groups of near copies, which share a passage with all others
        base = common + [f"g{g}w{i}" for i in range(60)]
        for i in range(rng.randint(1, 9)):
            own = list(base)
            own[rng.randrange(45, 100)] = f"own{i}"
            rows.append((100 * g + i, " ".join(own)))
    rng.shuffle(rows)
    wide = jaccard.dealt
    largest = []

    def dealt(members, block):
        largest.append(members.groupBy("grp").count().agg({"count": "max"}).first()[0])
        return wide(members, block)

    monkeypatch.setattr(jaccard, "dealt", dealt)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.links(documents(spark, rows)).collect())
    want = brute(rows)
    assert got == want
    sizes = {}
    for _, c, _ in want:
        sizes[c] = sizes.get(c, 0) + 1
    assert largest == [max(sizes.values())]
