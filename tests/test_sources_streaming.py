"""File sources and sinks, and streams against their batch results."""

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import files as S
from quarrystone.streaming import windows as W


def test_text_csv_keeps_everything_as_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,NA\n2,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,v\n3,007\n", encoding="utf-8")
    rows = {r["id"]: r for r in S.read_text_csv(spark, str(tmp_path), ["id", "v"]).collect()}
    assert rows["1"]["v"] == "NA" and rows["2"]["v"] == "" and rows["3"]["v"] == "007" and rows["3"]["source_file"] == "b.csv"
    with pytest.raises(Exception):
        S.read_text_csv(spark, str(tmp_path), ["id", "other"]).collect()
    assert {r["join_key"] for r in S.read_joined_csv(spark, str(tmp_path), "id").collect()} == {"a:1", "a:2", "b:3"}


def test_pinned_and_manifest(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("part-*.parquet"))
    digest = S.file_digest(str(part))
    assert S.read_pinned(spark, str(part), digest).count() == 5
    with pytest.raises(ValueError):
        S.read_pinned(spark, str(part), "0" * 64)
    listed = {r["file"]: r["sha256"] for r in S.manifest(spark, str(tmp_path / "t")).collect()}
    assert listed[part.name] == digest


def test_nested_columns_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", None], {"k": 1.5}), (2, None, None)], "i int, l array<string>, m map<string,double>")
    S.write_nested_csv(df, str(tmp_path / "c"))
    back = S.read_nested_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(back.collect(), key=lambda r: r["i"]) == df.collect()


def test_folds_store(spark, tmp_path):
    from quarrystone.operators.folds import fingerprint

    df = spark.createDataFrame([("a", "r1", 0), ("a", "r2", 1), ("b", "r1", 1)], "design string, row_id string, fold int")
    S.write_folds(df, str(tmp_path / "f"), "design")
    digest = fingerprint(df.where("design = 'a'"), ["row_id", "fold"]).first()["digest"]
    assert S.read_folds(spark, str(tmp_path / "f"), "design", "a", digest).count() == 2
    with pytest.raises(ValueError):
        S.read_folds(spark, str(tmp_path / "f"), "design", "b", digest)


def test_small_sinks(spark, tmp_path):
    S.write_json_strict({"a": float("nan"), "b": [1, float("inf")]}, str(tmp_path / "x.json"))
    assert "null" in (tmp_path / "x.json").read_text() and "NaN" not in (tmp_path / "x.json").read_text()
    assert S.markdown_table(spark.createDataFrame([(1, "a|b")], "i int, t string")).splitlines()[2] == r"| 1 | a\|b |"
    (tmp_path / "r.csv").write_text("# regime: nitrate\n# seed: 3\na,b\n1,2\n", encoding="utf-8")
    assert S.regime_header(str(tmp_path / "r.csv")) == {"regime": "nitrate", "seed": "3"} and S.read_regime_csv(spark, str(tmp_path / "r.csv")).count() == 1


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02}:{m:02}:00", u, float(v)) for i, (h, m, u, v) in enumerate([(0, 5, 1, 2), (0, 50, 1, 3), (1, 10, 2, 4), (3, 0, 1, 5), (3, 20, 1, 6), (23, 0, 2, 7)])]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    return df, W.read_events(spark, str(tmp_path / "in"), df.schema), str(tmp_path)


def test_stream_windows_equal_batch(events):
    df, stream, tmp = events
    got = W.run_to_table(W.windowed(stream, "ts", "user_id", "value", "1 hour", late="1 day"), "w1", "complete", tmp + "/c1").collect()
    assert sorted(got) == sorted(W.windowed(df, "ts", "user_id", "value", "1 hour").collect())
    got = W.run_to_table(W.sessions(stream, "ts", "user_id", "1 hour", "1 day"), "w2", "complete", tmp + "/c2").collect()
    assert sorted(got) == sorted(W.sessions(df, "ts", "user_id", "1 hour").collect())


def test_stream_duplicates_and_state(events):
    df, stream, tmp = events
    assert W.run_to_table(W.first_deliveries(stream.union(stream), "ts", "event_id", "2 days"), "w3", "append", tmp + "/c3").count() == df.count()
    got = {r["user_id"]: (r["n"], r["total"]) for r in W.run_to_table(W.running_totals(stream, "user_id", "value"), "w4", "update", tmp + "/c4").collect()}
    assert got == {1: (4, 16.0), 2: (2, 11.0)}
