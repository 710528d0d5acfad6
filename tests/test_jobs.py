import json
import os
import stat

import pytest

from driftwell import cli
from driftwell.plans import config, jobs, states
from driftwell.sources import artifacts, collections, datasets
from driftwell.sources.files import MemoryStore

def ranked(ids):
    return [{"id": i, "rank": n + 1, "score": 0.8 - 0.07 * n} for n, i in enumerate(ids.split())]


FIXTURE = {
    "job_id": "rankings", "top_k": 4, "expand_k": 6, "stable_k": 2, "boundary_k": 2,
    "queries": [{"query_id": "only", "source_hits": ranked("p1 p2 p3 p4 p5 p6"), "target_hits": ranked("p1 p7 p3 p2 p5 p9")}],
}


def written(tmp_path, value, name="fixture.json"):
    (tmp_path / name).write_text(json.dumps(value))
    return str(tmp_path / name)


def test_offline_verify(spark, tmp_path):
    o = jobs.offline_verify(spark, written(tmp_path, FIXTURE), str(tmp_path / "out"))
    s = o.summary
    assert (s["stable_neighbor_distance"], s["fingerprint_distance"], s["consistency_score"]) == pytest.approx((2 / 3, 7 / 15, 8 / 15))
    assert s["boundary_candidate_distance"] == pytest.approx(2 / 3) and s["boundary_flip_rate"] == pytest.approx(1 / 6)
    left = json.loads(open(o.source_fingerprint).read())["fingerprints"]
    assert left == [{"query_id": "only", "stable_neighbors": ["p1", "p2"], "boundary_candidates": ["p3", "p4", "p5", "p6"], "top_k_ids": ["p1", "p2", "p3", "p4"]}]
    result = json.loads(open(o.result).read())
    assert o.result.endswith("/rankings-result.json") and result["state"] == "SUCCEEDED" and result["metrics"]["MatchedQueryCount"] == 1 and set(result["metrics"]) == set(artifacts.RESULT_NAMES)
    assert stat.S_IMODE(os.stat(o.result).st_mode) == 0o600


@pytest.mark.parametrize("change", [{"job_id": ""}, {"expand_k": 2}, {"stable_k": 9}, {"expand_k": 7}, {"queries": []}, {"queries": FIXTURE["queries"] * 2}])
def test_bad_fixtures(spark, tmp_path, change):
    with pytest.raises(ValueError):
        jobs.offline_verify(spark, written(tmp_path, FIXTURE | change), str(tmp_path / "out"))


def test_artifacts(spark, tmp_path):
    with pytest.raises(ValueError):
        artifacts.read_fingerprints(spark, written(tmp_path, {"fingerprints": []}))
    with pytest.raises(ValueError):
        artifacts.read_fingerprints(spark, str(tmp_path / "none.json"))
    row = artifacts.read_fingerprints(spark, written(tmp_path, {"fingerprints": [{"query_id": "q"}]})).head()
    assert row[1:] == ([], [], [])


def test_migrate_and_verify(spark, tmp_path):
    path = datasets.write(spark, str(tmp_path / "set.json"))
    source, target = (collections.opened(spark, str(tmp_path / n)) for n in ("source", "target"))
    assert jobs.seed(spark, path, source, True) == 100
    queries = datasets.queries(datasets.read(spark, path))
    moved, o = jobs.migrate_and_verify(spark, source, target, queries, str(tmp_path / "out"), 8)
    assert (moved.records_read, moved.records_written, target.count()) == (100, 100, 100)
    assert o.summary["consistency_score"] == 1 and o.summary["matched_query_count"] == 10 and o.state.terminal
    with pytest.raises(ValueError):
        jobs.migrate(source, target, 9)
    with pytest.raises(Exception, match="fewer than 3 hits"):
        jobs.fingerprints(queries, source.read().limit(2), jobs.Settings()).collect()
    # on unit vectors both metrics rank alike
    same = jobs.drift(queries, source.read(), target.read(), jobs.Settings(), target_metric="l2").head()
    assert same["fingerprint_distance"] == 0


def test_the_last_of_repeated_ids_stays(spark, tmp_path):
    rows = [(f"r{i}", [float(n), 1.0], 40 * i + n) for i in range(50) for n in range(40)]
    source = collections.opened(spark, str(tmp_path / "source"), order_column="seq")
    spark.createDataFrame(rows, "id string, embedding array<double>, seq int").repartition(7).write.parquet(source.path)
    target = collections.opened(spark, str(tmp_path / "target"))
    assert jobs.migrate(source, target, 2).records_written == 2000
    assert {r.vector[0] for r in target.read().collect()} == {39.0} and target.count() == 50
    with pytest.raises(ValueError, match="duplicate"):
        jobs.migrate(collections.opened(spark, source.path), target, 2)
    assert target.count() == 50  # a failure leaves the collection as it was
    document = {"seed": 1, "dimension": 2, "record_count": 3, "query_count": 0, "metric": "l2", "records": [{"id": "a", "vector": [1, 0]}, {"id": "b", "vector": [2, 0]}, {"id": "a", "vector": [3, 0]}], "queries": []}
    assert jobs.seed(spark, written(tmp_path, document), target, False) == 3 and target.count() == 52
    assert {r.id: r.vector[0] for r in target.read().filter("id in ('a', 'b')").collect()} == {"a": 3.0, "b": 2.0}
    assert cli.main(["seed", "--fixture", written(tmp_path, document), "--collection", str(tmp_path / "other")], spark) == 0
    assert {r.id: r.vector[0] for r in collections.opened(spark, str(tmp_path / "other")).read().collect()} == {"a": 3.0, "b": 2.0}


def test_a_collection_may_be_written_from_itself(spark, tmp_path):
    store = collections.opened(spark, str(tmp_path / "c"))
    store.replace(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<double>"))
    assert store.merge(store.read().filter("id = 'a'").selectExpr("id", "transform(vector, x -> x + 5) as vector")) == 1
    assert {r.id: r.vector[0] for r in store.read().collect()} == {"a": 6.0, "b": 2.0}
    os.rename(store.path, f"{store.path}.old")  # as after a failure between the two moves
    assert store.count() == 2 and not os.path.exists(f"{store.path}.old")


def test_command_line(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    run = lambda *a: cli.main(list(map(str, a)), spark)
    assert run("generate-synthetic-fixture", "--output", at("set.json"), "--records", 30, "--queries", 4) == 0
    for name in ("one", "two"):
        assert run("seed", "--fixture", at("set.json"), "--collection", at(name), "--single-precision") == 0
        assert run("build-artifact", "--fixture", at("set.json"), "--collection", at(name), "--output", at(f"{name}.json")) == 0
    assert run("search", "--fixture", at("set.json"), "--collection", at("one"), "--query-index", 3) == 0
    assert run("search", "--fixture", at("set.json"), "--collection", at("one"), "--query-index", 4) == 1
    assert run("compare-artifacts", "--source", at("one.json"), "--target", at("two.json"), "--artifact-dir", at("out")) == 0
    assert run("compare", "--source", at("one.json"), "--target", at("two.json"), "--output", at("c.json")) == 0
    assert json.loads(open(at("c.json")).read())["metrics"]["fingerprint_distance"] == 0
    assert run("migrate", "--source", at("one"), "--target", at("three"), "--dimension", 8) == 0
    assert run("migrate-and-verify", "--fixture", at("set.json"), "--source", at("one"), "--target", at("four"), "--dimension", 8, "--artifact-dir", at("out")) == 0
    assert run("offline-verify", "--fixture", written(tmp_path, FIXTURE), "--artifact-dir", at("out")) == 0
    out = capsys.readouterr()
    assert "consistency_score: 0.533333" in out.out and "query_index 4 is outside" in out.err


YAML = """
job: {name: j}
runtime: {artifact_store: {type: local, path: ./a}}
source: {type: memory, collection: s}
target: {type: memory, collection: t}
query: {top_k: 10, expand_k: 20, sample_size: 5, filters: {enabled: false}}
fingerprint: {boundary: {rank_before_k: 2, delta: 0.03}, weights: {stable: 0.5, flip: 1}}
report: {formats: [json, markdown]}
"""


def test_configuration(tmp_path):
    c = config.parse(YAML)
    assert (c.query.expand_k, c.fingerprint.boundary.delta, c.report.formats) == (20, 0.03, ("json", "markdown"))
    for old, new in (("name: j", "name: ''"), ("type: local", "type: cloud"), ("top_k: 10", "top_k: 0"), ("expand_k: 20", "expand_k: 9"), ("sample_size: 5", "sample_size: 0"), ("delta: 0.03", "delta: -1"), ("flip: 1", "flip: -1"), ("weights: {stable: 0.5, flip: 1}", "weights: {}"), ("json, m", "pdf, m"), ("job:", "jobs:"), ("top_k: 10", "top_k: ten"), ("top_k", "topk")):
        with pytest.raises(ValueError):
            config.parse(YAML.replace(old, new, 1))
    with pytest.raises(ValueError, match="nowhere"):
        config.load(str(tmp_path / "nowhere.yaml"))


def test_states_and_store():
    assert states.parse("FAILED").terminal and not states.parse("CREATED").terminal and len(states.State) == 12
    with pytest.raises(ValueError):
        states.parse("LOST")
    store = MemoryStore()
    store.put("a", b"1")
    assert store.get("a") == b"1" and store.exists("a") and not store.exists("b")
    for bad in (lambda: store.get("b"), lambda: store.put("", b"")):
        with pytest.raises((KeyError, ValueError)):
            bad()
