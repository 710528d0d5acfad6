import math

import numpy as np
import pytest

from driftwell.llm import vectors
from driftwell.llm.common import Scratch
from driftwell.llm.components import components


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n string")


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[100:220] = x[100] + 0.02 * rng.normal(size=(120, 16))  # one large group
    x[300:310] = x[300]  # copies
    x[400] = 3 * x[401]
    x = x.astype(np.float32)
    got = {r.vec_id: r for r in vectors.near_duplicates(table(spark, enumerate(x.tolist())), window=24).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(1)
    found = np.array([got[i].n_links for i in range(600)])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    assert all(got[i].component_id == 100 and got[i].kept == (i == 100) for i in range(100, 220))
    assert (got[305].n_links, got[305].component_id, got[401].component_id) == (9, 300, 400)


def test_odd_vectors_link_with_nothing(spark):
    rows = [(1, None), (2, [0, 0]), (3, [math.nan, 1]), (4, [math.inf, 1]), (5, [None, 1]), (6, [1, 0]), (7, [1, 0]), (7, [1, 0]), (8, [-0.0, 1]), (9, [0.0, 1])]
    got = vectors.near_duplicates(table(spark, rows)).collect()
    seen = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got)
    assert seen == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 2, 6, True), (7, 2, 6, False), (7, 2, 6, False), (8, 1, 8, True), (9, 1, 8, False)]
    assert vectors.near_duplicates(table(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        vectors.near_duplicates(table(spark, [(1, [1, 2]), (2, [1, 2, 3])])).collect()


def test_passes_grow_with_the_table():
    few, many = (vectors.passes_needed(n, 0.9) for n in (10_000, 10_000_000))
    assert 1 <= few < many and vectors.passes_needed(10, 0.9) == 1


def united(groups):
    up = {r.id: r.component for r in groups.collect()}
    return lambda i, j: up.get(i, i) == up.get(j, j)


def lost(spark, x, window):
    """Share of the linked pairs of unit vectors ``x`` that end in different components."""
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    reps = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, raw binary")
    with Scratch(spark) as scratch:
        same = united(vectors._groups(reps, 0.9, window, 0.99, 17, scratch))
    row, col = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert len(row) > 200
    return 1 - np.mean([same(i, j) for i, j in zip(row.tolist(), col.tolist())])


def partner(rng, x, cosine):
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    cosine = np.reshape(cosine, (-1, 1))
    return cosine * x + (1 - cosine**2) ** 0.5 * away / np.linalg.norm(away, axis=1)[:, None]


def test_a_dense_cone_keeps_the_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:3000] = x[:3000] * 0.25**0.5 + np.eye(64)[0] * 0.75**0.5  # mean cosine 0.75
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = x[200:400] - (x[:200] * x[200:400]).sum(1)[:, None] * x[:200]
    x[400:600] = 0.905 * x[:200] + (1 - 0.905**2) ** 0.5 * away / np.linalg.norm(away, axis=1)[:, None]
    assert lost(spark, x, 8) <= 0.02


@pytest.mark.parametrize("shared, parts", [(0.0, 8), (2.0, 8), (1.5, 40)])
def test_isolated_pairs_are_found_whatever_the_partitions(spark, shared, parts):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64)) / 8 + shared * np.eye(64)[3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.concatenate((x, partner(rng, x, rng.uniform(0.9, 0.93, 2000))))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.enabled", "false" if parts == 40 else "true")
        assert lost(spark, x, 64) <= 0.01
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_partitions_do_not_change_the_groups(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    reps = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, raw binary")
    sample = x[:500]
    seen = []
    for parts in ("3", "20"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        with Scratch(spark) as scratch:
            out = vectors._pass_edges(reps, range(2), sample, np.zeros((0, 8)), 0.9, 16, 17, scratch)
            seen.append({(r.id, r.component) for r in components(out.select("a", "b"), "test").collect()})
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0]) > 100


def test_one_window_that_holds_all_misses_nothing(spark):
    x = np.random.default_rng(2).normal(size=(1200, 4)).tolist()
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table(spark, enumerate(x))).collect()}
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    assert [got[i] for i in range(1200)] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


def test_all_blocks_where_passes_would_compare_more(spark):
    x = np.random.default_rng(2).normal(size=(1200, 4)).tolist()
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table(spark, enumerate(x)), window=400).collect()}
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    assert [got[i] for i in range(1200)] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


def test_tables_of_all_sizes_go_through_passes(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.concatenate((x, partner(rng, x, rng.uniform(0.9, 0.93, 700))))
    passes, run = [], vectors._pass_edges

    def counted(reps, numbers, *rest):
        passes.extend(numbers)
        return run(reps, numbers, *rest)

    monkeypatch.setattr(vectors, "_pass_edges", counted)
    assert lost(spark, x, 400) <= 0.01 and len(passes) > 1  # all pairs of blocks would be fewer comparisons


def test_pairs_at_the_threshold_link_in_every_block():
    a = np.zeros((40, 8))
    a[:, 0], a[:, 1] = 3.0, 4.0  # cosine with the first axis: 0.6
    for size in (1, 7, 40):
        assert vectors._linked(a[:size], np.eye(8)[:1], 0.6).all()
    assert not vectors._linked(a[:3], np.eye(8)[:1], np.nextafter(0.6, 1)).any()


def test_clashing_columns_and_repeats_of_an_id(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "k", 1), (1, [0.0, 1.0], "k", 1), (2, [1.0, 0.0], "k", 1), (None, [1.0, 0.0], "k", 1)], "vec_id long, embedding array<double>, raw string, n int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(rows.withColumnRenamed("n", "times")).collect())
    assert [g for g in got if g[0]] == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
