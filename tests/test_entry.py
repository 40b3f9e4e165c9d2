import os

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 37


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["dump_tokenize_pages", "redirect_closure", "trimmed_graph_reindexed", "title_complete", "json_index_extract"])
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("customer", "orders", "events", "part"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = e.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = c.execute(f"select {', '.join(cols)} from ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))
