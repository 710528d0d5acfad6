import os

import duckdb
import pytest

from driftwell.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "customer", "orders", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows_equal_the_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    relation = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == want and want


def test_scans_are_pruned(spark):
    plan = catalog._queries(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "% 50" in plan and "label" not in plan.split("ReadSchema")[1]
    plan = catalog.QUERIES["ranking_drift_nation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan and "c_mktsegment" not in plan
