"""Problem 1: survivors of duplicate groups."""

import random

from pyspark.sql import functions as F

from quarrystone.functions.clean import date_key, label_key
from quarrystone.llm.survivors import best_representative, merged_fields, ranked_records

SCHEMA = "g string, id string, a double, b string, added string, flags array<string>, group_id string"


def _records(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    bad = spark.createDataFrame([("bad",), ("worse",)], "flag string")
    return df, ranked_records(df, "g", "id", ["a", "b"], date_key(F.col("added")), "flags", bad)


def test_dominating_record(spark):
    rows = [
        ("x", "1", 1.0, "m", "2020-01-02", None, "z"),
        ("x", "2", float("nan"), "m", "01.01.2020", [" BAD "], "z"),
        ("x", "2", float("nan"), "m", "01.01.2020", [" BAD "], "z"),  # delivered again
        ("y", "3", 1.0, "m", "2020-01-02", [], "z"),
        ("y", "4", 1.0, "m", "2020-01-02", ["Bad", "bad"], "z"),
        ("y", "5", 1.0, "m", "20200102", None, "z"),  # ties with 3
        ("w", "6", None, "-", None, None, "z"),
        (None, "7", 1.0, "m", "2020-01-02", None, "z"),
    ]
    _, rec = _records(spark, rows)
    out = {r["group_id"]: r for r in best_representative(rec).collect()}
    assert set(out) == {"x", "y", "w"}
    assert out["x"]["rec_id"] == "1" and out["x"]["dominates"] and out["x"]["unique"] and out["x"]["several"]
    assert out["y"]["rec_id"] == "3" and not out["y"]["unique"]
    assert not out["w"]["several"] and out["w"]["recent"] == -1


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"g{rng.randint(0, 30)}" if rng.random() < 0.7 else "hot", f"r{i}", rng.choice([None, 1.0]), rng.choice(["n/a", "q"]), f"2020010{rng.randint(1, 4)}", rng.choice([None, ["bad"], ["bad", "worse"]]), "z") for i in range(400)]
    _, rec = _records(spark, rows)
    got = {(r["group_id"], r["rec_id"]) for r in best_representative(rec.repartition(7)).where("several AND dominates AND unique").collect()}
    by = {}
    for g, i, a, b, d, f, _ in rows:
        by.setdefault(g, []).append((i, (a is not None) + (b == "q"), int(d), -len(f or [])))
    want = set()
    for g, rs in by.items():
        best = [r[0] for r in rs if all(all(x >= y for x, y in zip(r[1:], o[1:])) for o in rs)]
        if len(rs) > 1 and len(best) == 1:
            want.add((g, best[0]))
    assert got == want


def test_merged_fields_and_empty(spark):
    _, rec = _records(spark, [("x", "1", None, "m", "2020-01-02", None, "z"), ("x", "2", 5.0, "?", "2019-01-02", ["bad"], "z"), ("x", "3", 4.0, "k", None, None, "z")])
    row = merged_fields(rec, ["a", "b"]).collect()[0]
    assert (row["a"], row["b"]) == (4.0, "m")
    _, rec = _records(spark, [])
    assert best_representative(rec).count() == 0 and merged_fields(rec, ["a"]).count() == 0


def test_the_class_is_the_groups(spark):
    """A row without a class wins in a group whose other rows carry one; a group of another class is not represented."""
    rows = [("x", "1", 1.0, "m", "2020-01-02", None, None), ("x", "2", None, "m", "2019-01-02", None, " a "), ("y", "3", 1.0, "m", "2020-01-02", None, "E"), ("y", "4", 1.0, None, "2020-01-02", None, None), ("w", "5", 1.0, "m", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("group_id", "kind"))
    bad = spark.createDataFrame([("bad",)], "flag string")
    rec = ranked_records(df, "g", "id", ["a", "b"], date_key(F.col("added")), "flags", bad, label_key(F.col("kind")).isin("a", "b"))
    assert [(r["group_id"], r["rec_id"]) for r in best_representative(rec).where("several AND dominates AND unique").collect()] == [("x", "1")]
    assert [(r["group_id"], r["a"], r["b"]) for r in merged_fields(rec, ["a", "b"]).collect()] == [("x", 1.0, "m")]


def test_one_id_in_two_groups_keeps_its_own_values(spark):
    _, rec = _records(spark, [("x", "1", 1.0, "m", "2020-01-02", None, "z"), ("y", "1", 2.0, "k", "2020-01-02", None, "z")])
    assert {r["group_id"]: (r["a"], r["b"]) for r in merged_fields(rec, ["a", "b"]).collect()} == {"x": (1.0, "m"), "y": (2.0, "k")}


def test_nulls_long_texts_and_clashing_columns(spark):
    schema = "g string, id string, a double, b string, added string, flags array<string>, member boolean, group_id string, rec_id string, filled int"
    df = spark.createDataFrame([("x", "1", None, "t" * 100_000, None, [None, "bad"], None, "q", "q", 9), ("x", None, 1.0, "m", None, None, None, "q", "q", 9), (None, None, None, None, None, None, None, None, None, None), ("x", "2", 1.0, "", "soon", [], None, "q", "q", 9)], schema)
    rec = ranked_records(df, "g", "id", ["a", "b"], date_key(F.col("added")), "flags", spark.createDataFrame([("bad",), (None,)], "flag string"))
    row = best_representative(rec).collect()
    assert [(r["group_id"], r["rec_id"], r["filled"], r["recent"], r["suspect"]) for r in row] == [("x", "2", 1, -1, 0)]
