"""Designs, guards, hulls, text functions and the operators on covariances."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import advanced as A
from quarrystone.operators import designs as G
from quarrystone.operators import hull as H


def test_guard_raises_only_for_held_out_rows(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    assert G.guarded(rows, spark.createDataFrame([(3,)], "id int"), "id").count() == 2
    with pytest.raises(Exception, match="held-out row scored"):
        G.guarded(rows, spark.createDataFrame([(2,)], "id int"), "id").collect()


def test_arms_share_their_test_rows(spark):
    core = spark.createDataFrame([(f"r{i}", i % 3) for i in range(30)], "row_id string, fold int")
    extra = spark.createDataFrame([(f"x{i}",) for i in range(4)], "row_id string")
    out = G.fixed_test_arms(core, extra, "row_id", "fold", 3, 1).collect()
    n = {(a, r): sum(1 for x in out if x["arm"] == a and x["role"] == r) for a in ("BASE", "EXPANDED", "ROWMATCHED") for r in ("test", "train")}
    assert n == {("BASE", "test"): 30, ("EXPANDED", "test"): 30, ("ROWMATCHED", "test"): 30, ("BASE", "train"): 60, ("EXPANDED", "train"): 72, ("ROWMATCHED", "train"): 60}


def test_greedy_tables():
    assert G.greedy_bins([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert G.closest_fit([("a", 9), ("b", 4), ("c", 2)], 6) == ["b", "c"]


def test_hull_holds_every_point(spark):
    rng = random.Random(1)
    pts = [("g", rng.gauss(0, 1), rng.gauss(0, 2)) for _ in range(400)] + [("h", 1.0, 1.0), ("h", 1.0, 1.0), ("g", None, 1.0), ("g", float("nan"), 0.0)]
    out = H.hulls(spark.createDataFrame(pts, "k string, x double, y double"), "k", "x", "y").collect()
    corners = [(r["x"], r["y"]) for r in sorted(out, key=lambda r: r["place"]) if r["k"] == "g"]
    inside = sum(all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9 for a, b in zip(corners, corners[1:] + corners[:1])) for k, x, y in pts[:400])
    assert inside == 400 and [(r["x"], r["y"]) for r in out if r["k"] == "h"] == [(1.0, 1.0)]


def test_text_functions(spark):
    df = spark.createDataFrame([(0, "A with 25% B"), (1, "kerosene 0.8, TBP 0.2"), (2, "1,2-dichloroethane"), (3, "- -"), (4, None)], "i int, t string")
    got = [None if r[0] is None else [(p["name"], round(p["fraction"], 6)) for p in r[0]] for r in df.orderBy("i").select(T.parse_mixture(F.col("t"))).collect()]
    assert got == [[("A", 0.75), ("B", 0.25)], [("kerosene", 0.8), ("TBP", 0.2)], [("1,2-dichloroethane", 1.0)], None, None]
    kv = spark.createDataFrame([("Acid: HCl; temp : 25 ; note; Acid: HNO3; other: x",), (None,)], "t string").select(T.key_values(F.col("t"), ["acid", "temp"]).alias("m")).collect()
    assert [r["m"] for r in kv] == [{"acid": "HNO3", "temp": "25"}, {}]
    one = spark.createDataFrame([("ﬁne–x  y",)], "t string").select(T.nfkc(F.col("t"))).collect()[0][0]
    assert one == "fine-x y"
    names = spark.createDataFrame([(["HCl", "nitric", None],)], "p array<string>").select(T.canonical_names(F.array_compact("p"), {"nitric": "HNO3"})).collect()[0][0]
    assert names == ["HCl", "HNO3"]


def test_blup_returns_what_is_measured_when_there_is_no_noise(spark):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        level = rng.gauss(0, 1)
        rows += [(f"c{c}", m, level + rng.gauss(0, 0.1)) for m in "abcd" if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "cell string, item string, v double")
    cov = A.pair_covariance(df, ["cell"], "item", "v", 5)
    assert cov.count() == 10
    seen = {(r[0], r[1]): r[2] for r in rows}
    for r in A.blup(df, "cell", "item", "v", cov, 1e-9).collect():
        if r["observed"]:
            assert math.isclose(r["estimate"], seen[r["cell"], r["item"]], abs_tol=1e-3)
    shapes = A.principal_shapes(spark, cov, 1).collect()
    assert len(shapes) == 4 and shapes[0]["share"] > 0.9


def test_weights_find_the_right_arm(spark):
    df = spark.createDataFrame([(float(i), float(i) + 0.01, -float(i)) for i in range(20)], "y double, a double, b double")
    w = A.simplex_weights(df, "y", ["a", "b"])
    assert math.isclose(sum(w), 1.0, abs_tol=1e-9) and w[0] > 0.99
