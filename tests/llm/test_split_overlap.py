"""Problem 6: records repeated across splits."""

import random

from pyspark.sql import functions as F

from quarrystone.functions.clean import smiles_key, split_role, squeeze
from quarrystone.llm import split_overlap
from quarrystone.llm.split_overlap import coverage, split_overlaps

SCHEMA = "id string, s string, m string, a double, b double, y double, role string, eval_id string"


def _run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = split_overlaps(df, "id", F.col("s"), F.col("m"), [F.col("a"), F.col("b")], F.col("y"), F.col("role"))
    return {(r["eval_id"], r["train_id"]) for r in out.where("train_id IS NOT NULL").collect()}, {r["eval_id"]: r["coverage"] for r in coverage(out, 3).collect()}


def _brute(rows):
    same = lambda x, y: (x is None and y is None) or (x is not None and y is not None and abs(x - y) <= 1e-3 * max(abs(x), abs(y)))
    out = set()
    for e in rows:
        for t in rows:
            if e[6] in ("validation", "test") and t[6] == "train" and None not in (e[1], e[2], e[5], t[5]) and e[1:3] == t[1:3] and same(e[3], t[3]) and same(e[4], t[4]) and abs(round(e[5] * 1000) - round(t[5] * 1000)) <= 10:
                out.add((e[0], t[0]))
    return out


def _rows(rng, n, hot):
    value = lambda: rng.choice([None, 0.0, -5.0, 1.0, 1.0005, 0.9995, 2.7182818, 2.7209, 2.7155])
    return [(f"i{k}", "S" if rng.random() < hot else rng.choice(["S", "T", None]), rng.choice(["Nd", "Eu"]), 1.0 if rng.random() < hot else value(), value(), rng.choice([None, 1.0, 1.01, 1.011, 1.021, -2.0, 0.0]), rng.choice(["train", "train", "test", "validation", None]), "z") for k in range(n)]


def test_against_brute_force(spark):
    rows = _rows(random.Random(3), 600, 0.2)
    pairs, _ = _run(spark, rows)
    assert pairs == _brute(rows) and pairs


def test_hot_subjects_are_cut_on_both_sides(spark, monkeypatch):
    """A third and more of the evaluation and of the training rows share structure, metal and conditions; every task holds few of either."""
    monkeypatch.setattr(split_overlap, "HOT", 7)
    monkeypatch.setattr(split_overlap, "SHARD", 5)
    monkeypatch.setattr(split_overlap, "PAIRS", 10)
    rows = _rows(random.Random(4), 500, 0.7)
    pairs, parts = _run(spark, rows)
    assert pairs == _brute(rows)
    monkeypatch.undo()
    assert _run(spark, rows) == (pairs, parts)  # cutting changes no coverage


def test_coverage_and_edges(spark):
    rows = [("t", "S", "Nd", 1.0, None, 1.0, "train", "z"), ("e", "S", "Nd", 1.0, None, 3.0, "test", "z"), ("f", "S", "Nd", 1.0, None, 1.005, "test", "z")]
    pairs, coverage = _run(spark, rows)
    assert pairs == {("f", "t")} and coverage["f"] == 1.0 and coverage["e"] == 2 / 3
    assert _run(spark, []) == (set(), {})
    assert _run(spark, [("t", None, None, None, None, None, None, None)]) == (set(), {})


def test_partial_coverage_from_several_training_rows(spark):
    """Runs met in different training rows at different places are merged; those of another metal do not count."""
    schema = "id string, s string, m string, a double, b double, c double, d double, y double, role string"
    rows = [("e", "S", "Nd", 1.0, 2.0, 3.0, 4.0, 1.0, "test"), ("t1", "S", "Nd", 1.0, 2.0, 3.0, 9.0, 5.0, "train"), ("t2", "S", "Nd", 9.0, 2.0, 3.0, 4.0, 5.0, "train"), ("t3", "S", "Eu", 1.0, 2.0, 3.0, 4.0, 1.0, "train"), ("g", "S", "Eu", 9.0, 9.0, None, 4.0, 1.0, "validation")]
    df = spark.createDataFrame(rows, schema)
    out = split_overlaps(df, "id", F.col("s"), F.col("m"), [F.col(c) for c in "abcd"], F.col("y"), F.col("role"))
    assert {r["eval_id"]: (r["covered"], r["repeated"]) for r in coverage(out, 5).collect()} == {"e": (0b01111, False)}


def test_order_white_space_and_case_of_the_inputs_do_not_matter(spark):
    rows = [("t", "B.A", " Nd", 1.0, 2.0, 1.0, " TRAIN", None), ("e", "A.\tB ", "Nd", 1.0, 2.0, 1.0, "Test", None), ("f", "A .B", "Nd\t", 1.0, 2.0, 1.01, "val", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = split_overlaps(df, "id", smiles_key(F.col("s")), squeeze(F.col("m")), [F.col("a"), F.col("b")], F.col("y"), split_role(F.col("role")))
    assert {(r["eval_id"], r["train_id"]) for r in out.where("train_id IS NOT NULL").collect()} == {("e", "t"), ("f", "t")}
