import os

import pytest

import __spark_entry__ as entry_point


def test_registered_queries():
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries) and {"knn_cosine", "compare_summary", "migrate_upsert"} <= set(sql)


@pytest.mark.skipif(not os.path.isdir(entry_point.SMALL), reason="the tables are not here")
def test_flagship(spark):
    rows = entry_point.entry(spark).collect()
    queries = spark.read.parquet(f"{entry_point.SMALL}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert len(rows) == 1 and 0 < rows[0].consistency_score < 1 and rows[0].matched_query_count == queries
