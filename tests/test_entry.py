"""The registry: names, and every query that runs in seconds on the smallest data."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def _core():
    from quarrystone.plans import registry

    return registry


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(_core().QUERIES))
def test_every_core_query_runs_and_agrees_with_its_sql(spark, con, name):
    got = _core().QUERIES[name](spark, DATA)
    rows = got.collect()
    if name in _core().SQL:
        want = con.execute(f"""SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({_core().SQL[name]})""").fetchall()
        same = lambda rows: sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
        assert same(map(tuple, rows)) == same(want)
