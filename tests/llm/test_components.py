import random

from driftwell.llm import common, components as module
from driftwell.llm.components import components


def test_against_search(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 70)]  # a long path
    edges += [(1000, 1000 + rng.randint(1, 400)) for _ in range(300)]  # a hub
    edges += [(2000 + rng.randint(0, 300), 2000 + rng.randint(0, 300)) for _ in range(200)] + [(5, 5), (4000, 3999), (3999, 4000), (None, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    rows = components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert {r.id: r.component for r in rows} == {x: find(x) for x in up} and len(rows) == len(up)
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_small_tables_are_few_files_and_larger_ones_more(spark, monkeypatch):
    files = []

    def counted(df, name):
        out, path = common.written(df, name)
        files.append(len(out.inputFiles()))
        return out, path

    monkeypatch.setattr(module, "written", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300, 2)] + [(900, i) for i in range(300)], "a long, b long")
    for rows, least in ((4096, 1), (50, 2)):
        files.clear()
        monkeypatch.setattr(common, "FILE_ROWS", rows, raising=False)
        before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        try:
            spark.conf.set("spark.sql.shuffle.partitions", "40")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            found = {(r.id, r.component) for r in components(edges, "test").collect()}
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        assert found == {(i, 0) for i in (*range(300), 900)}
        assert least <= max(files) <= 2 * 450 // rows + 2, files
