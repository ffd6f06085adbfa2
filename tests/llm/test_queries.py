"""The registered queries against their SQL on the smallest data."""

import os

import pytest

from quarrystone.llm.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    got = QUERIES[name](spark, DATA)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    same = lambda rows: sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert same(map(tuple, got.collect())) == same(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_every_document_is_encoded_and_placed(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert QUERIES["p8_ids"](spark, DATA).count() == n
    placed = QUERIES["p9_containers"](spark, DATA)
    assert placed.select("doc_id").distinct().count() == n
    assert placed.groupBy("container_id").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 2048


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_splits_keep_what_is_tied_together(spark):
    splits = QUERIES["p4_splits"](spark, DATA)
    rows = spark.read.parquet(f"{DATA}/dataset.parquet").select("row_id", "extractant")
    assert splits.count() == rows.count()
    assert splits.join(rows, "row_id").groupBy("extractant").agg({"split": "approx_count_distinct"}).where("`approx_count_distinct(split)` > 1").count() == 0
