"""Problem 4: tied records and the search for splits."""

import random

from pyspark.sql import functions as F

from quarrystone.llm.split_search import connected_components, search_splits, tie_edges


def _brute(edges):
    label = {x: x for e in edges for x in e}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 300)}", f"n{rng.randint(0, 300)}") for _ in range(200)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("hub", f"h{i}") for i in range(50)] + [("alone", "alone")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, "x")], "a string, b string")).collect()}
    assert got == _brute(edges)
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_tie_edges(spark):
    df = spark.createDataFrame([(["p", "q"], "e", "x"), (None, "e", "x"), ([], None, "x")], "p array<string>, e string, a string")
    assert {(r["a"], r["b"]) for r in tie_edges(df, F.col("p"), F.array("e")).collect()} == {("e", "e"), ("e", "p"), ("e", "q")}


def test_search(spark):
    rng = random.Random(3)
    rows = [(f"k{i}", rng.choice(["a", "b", None]), int(rng.paretovariate(1.2))) for i in range(800)] + [("big", "a", 300)]
    df = spark.createDataFrame(rows, "component string, label string, n long").groupBy("component", "label").agg(F.sum("n").alias("n"))
    want = {"train": 0.8, "validation": 0.1, "test": 0.1}
    out = search_splits(df, want, n_units=100, chains=2, steps=3000)
    chosen = {r["component"]: r["split"] for r in out.collect()}
    assert len(chosen) == 801 and out.count() == 801
    total, per = sum(r[2] for r in rows), dict.fromkeys(want, 0)
    for c, _, n in rows:
        per[chosen[c]] += n
    assert all(abs(per[s] / total - want[s]) < 0.02 for s in want)
    again = {r["component"]: r["split"] for r in search_splits(df.repartition(3), want, n_units=100, chains=2, steps=3000).collect()}
    assert again == chosen
    assert search_splits(df.where("false"), want).count() == 0


def test_more_labels_than_are_named(spark):
    """Labels beyond the named ones are balanced in bins of their own: no component is split and the sizes keep their shares."""
    rng = random.Random(5)
    df = spark.createDataFrame([(f"k{i}", f"label{rng.randint(0, 40)}", rng.randint(1, 5)) for i in range(600)], "component string, label string, n long").groupBy("component", "label").agg(F.sum("n").alias("n"))
    want = {"train": 0.8, "validation": 0.1, "test": 0.1}
    chosen = search_splits(df, want, n_units=100, chains=2, steps=3000, max_labels=4)
    joined = df.join(chosen, "component").groupBy("split").agg(F.sum("n").alias("n"))
    per = {r["split"]: r["n"] for r in joined.collect()}
    assert chosen.count() == 600 and all(abs(per[s] / sum(per.values()) - want[s]) < 0.03 for s in want)
