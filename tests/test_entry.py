import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.01"
FAST = ["exact_knn", "knn_where", "coarse_assign", "pq_encode", "shortlist_rerank", "bernoulli_sample", "table_info"]


def test_contract():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 30


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", FAST)
def test_rows_of_the_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    got, want = entry.queries()[name](spark, DIR), con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
