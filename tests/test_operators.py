"""Core operators on small fixtures: brute force, ties, NULLs, empty tables, repartitioning."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import keys as K
from quarrystone.operators import cohort as C
from quarrystone.operators import curves as V
from quarrystone.operators import dedup as D
from quarrystone.operators import folds as P
from quarrystone.operators import metrics as M
from quarrystone.operators import ranking as R
from quarrystone.operators import resample as B
from quarrystone.operators import selection as Q
from quarrystone.operators import similarity as S
from quarrystone.operators.graph import connected_components


def _panel(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(f"r{i}", rng.choice("abcde"), rng.choice("xyz"), rng.choice([None, *[float(k) for k in range(6)]]), float(rng.randint(0, 5)), rng.randint(1, 4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id string, unit string, block string, y double, p double, w int")


def test_quantised_keys(spark):
    cases = [(0.123456789, "123457e-1"), (1234567.0, "123457e6"), (-0.0, "0"), (None, "NA"), (float("nan"), "NA"), (9.9999999, "100000e1"), (-2.5, "-250000e0")]
    got = [r[0] for r in spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x double").orderBy("i").select(K.quantised(F.col("x"), 6)).collect()]
    assert got == [c[1] for c in cases]


def test_written_figures(spark):
    cases = [("0.050", 2), ("1500", 2), ("1.50", 3), ("-3e5", 1), ("abc", None), (None, None), ("0", 1)]
    got = [r[0] for r in spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string").orderBy("i").select(K.written_figures(F.col("x"))).collect()]
    assert got == [c[1] for c in cases]


def test_level_and_shape_identity(spark):
    rows, df = _panel(spark)
    long = M.long_arms(df, ["unit"], "y", ["p"])
    out = M.level_and_shape(long, "unit", ["arm"]).collect()[0]
    per = defaultdict(list)
    for r in rows:
        if r[3] is not None:
            per[r[1]].append(r[4] - r[3])
    mean = {u: sum(v) / len(v) for u, v in per.items()}
    assert math.isclose(out["level_mae"], sum(abs(m) for m in mean.values()) / len(mean))
    assert math.isclose(out["level_share"], sum(len(v) * mean[u] ** 2 for u, v in per.items()) / sum(e * e for v in per.values() for e in v))
    assert M.level_and_shape(long.where("false"), "unit", ["arm"]).count() == 0


def test_kendall_against_pairs(spark):
    rows, df = _panel(spark, 120)
    got = M.kendall(df, ["unit"], "y", "p").collect()
    for r in got:
        x = [(q[3], q[4]) for q in rows if q[1] == r["unit"] and q[3] is not None]
        s = ta = tb = 0
        for i in range(len(x)):
            for j in range(i):
                a, b = x[i][0] - x[j][0], x[i][1] - x[j][1]
                s += (a * b > 0) - (a * b < 0)
                ta += a == 0
                tb += b == 0
        n = len(x) * (len(x) - 1) / 2
        assert math.isclose(r["tau_b"], s / math.sqrt((n - ta) * (n - tb)))


def test_bands_keep_empty_ones(spark):
    _, df = _panel(spark)
    out = {r["band"]: r["n"] for r in M.banded(df, F.col("p"), [("none", None, -1.0), ("low", -1.0, 2.0), ("high", 2.0, None)], []).collect()}
    assert out["none"] == 0 and out["all"] == 300 == out["low"] + out["high"]


def test_peers_median(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("g", "c", 2.0), ("g", "d", 9.0), ("h", "a", 1.0), ("g", "e", None)], "g string, e string, v double")
    got = {(r["g"], r["e"]): r["peers"] for r in M.peers_median(df, "g", "e", "v", 3.0).collect()}
    assert got == {("g", "a"): 2.0, ("g", "b"): 2.0, ("g", "c"): 2.0, ("g", "d"): 2.0, ("h", "a"): None}


def test_validated_joins_fail_when_they_should(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")
    assert C.join_validated(b, a, ["k"]).count() == 2
    with pytest.raises(Exception, match="key not unique"):
        C.join_validated(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="one side only"):
        C.align(a, b.limit(1), ["k"]).collect()
    assert C.align(a, a.withColumnRenamed("v", "u"), ["k"]).count() == 2


def test_as_of_and_range_joins(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.randint(0, 50)) for i in range(60)]
    right = [(rng.choice("ab"), t, float(t)) for t in rng.sample(range(50), 20)]
    got = {r["i"]: r["v"] for r in C.as_of_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v double"), "k", "t", ["v"]).collect()}
    for i, k, t in left:
        before = [r for r in right if r[0] == k and r[1] <= t]
        assert got[i] == (max(before, key=lambda r: r[1])[2] if before else None)
    ranges = spark.createDataFrame([("a", 3.0, 20.0), ("a", 19.0, 21.0), ("b", 5.0, 4.0)], "k string, lo double, hi double")
    points = spark.createDataFrame([(i, k, float(t)) for i, k, t in left], "i int, k string, x double")
    assert C.range_join(points, ranges, "k", "x", "lo", "hi", 4.0).count() == sum((k == "a" and 3 <= t <= 20) + (k == "a" and 19 <= t <= 21) for _, k, t in left)


def test_ladder_is_monotone_or_fails(spark):
    df = spark.createDataFrame([("A b",), ("a b",), ("a  b",), (None,), (None,)], "t string")
    x = F.col("t")
    out = {r["name"]: r["n_redundant"] for r in D.ladder(df, [("raw", x), ("case", F.lower(x)), ("space", F.regexp_replace(F.lower(x), " +", " "))]).collect()}
    assert out == {"raw": 1, "case": 2, "space": 3}
    with pytest.raises(Exception, match="not monotone"):
        D.ladder(df, [("case", F.lower(x)), ("raw", x)]).collect()


def test_duplicate_classes(spark):
    df = spark.createDataFrame([("1", "k", 1.0, "p"), ("2", "k", 1.0, "p"), ("3", "m", 1.0, "p"), ("4", "m", 2.0, "p"), ("5", "n", 1.0, "p"), ("6", "n", 1.0, "q"), ("7", "o", None, "p"), ("8", "o", 1.0, "p"), ("9", "u", 1.0, "p")], "i string, k string, v double, s string")
    got = {r["key"]: r["class"] for r in D.classify_groups(df, F.col("k"), "i", F.col("v"), [F.col("s")], [F.col("v")], F.lit(5)).collect()}
    assert got == {"k": "A", "m": "E", "n": "B", "o": "F", "u": "UNIQUE"}


def test_folds_do_not_depend_on_partitions_or_targets(spark):
    _, df = _panel(spark)
    a = {tuple(r) for r in P.grouped_folds(df, "unit", 3, 7).collect()}
    b = {tuple(r) for r in P.grouped_folds(df.repartition(9).withColumn("y", F.rand()), "unit", 3, 7).collect()}
    assert a == b and sorted(f for _, f in a) == [0, 0, 1, 1, 2]


def test_leaks_are_found(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), (None, 0), (None, 1)], "g string, fold int")
    assert P.leak_audit(df, "fold", ["g"]).collect()[0]["n_leaking"] == 0
    assert P.leak_audit(df.union(spark.createDataFrame([("a", 1)], "g string, fold int")), "fold", ["g"]).collect()[0]["n_leaking"] == 1


def test_permutation_keeps_values(spark):
    rows, df = _panel(spark)
    out = P.permuted(df, "row_id", "w", 3, ["unit"]).collect()
    assert len(out) == 300 and sorted((r["unit"], r["w"]) for r in out) == sorted((r[1], r[5]) for r in rows)
    assert any(r["w"] != {q[0]: q[5] for q in rows}[r["row_id"]] for r in out)


def test_fingerprint_ignores_order(spark):
    _, df = _panel(spark)
    cols = ["row_id", "unit", "y"]
    a = P.fingerprint(df, cols).first()["digest"]
    assert a == P.fingerprint(df.repartition(5).select(*reversed(df.columns)), cols).first()["digest"]
    assert a != P.fingerprint(df.withColumn("y", F.col("y") + 1), cols).first()["digest"]


def test_one_curve(spark):
    rows = [(f"r{i}", "s", 10.0 ** (-2 + i / 3), 0.5, None, float(-i)) for i in range(7)] + [("z", "s", 1.0, 0.7, None, 0.0), ("q", None, 1.0, 0.5, None, 0.0)]
    df = spark.createDataFrame(rows, "row_id string, series string, acid double, ligand double, temp double, y double")
    m = V.curve_members(df, "series", "row_id", {a: F.col(a) for a in ("acid", "ligand", "temp")})
    assert {r["row_id"] for r in m.collect()} == {f"r{i}" for i in range(7)} and m.select("curve_id").distinct().count() == 1
    assert V.curve_stats(m, df, "row_id", "y").collect()[0]["trend"] == "down"
    assert V.training_pairs(m).where("kind = 'adjacent'").count() == 6
    sides = spark.createDataFrame([(f"r{i}", i % 2) for i in range(7)], "row_id string, side int")
    assert V.closure(m, sides, "row_id", "side").count() == 1
    assert V.curve_members(df.where("false"), "series", "row_id", {"acid": F.col("acid")}).count() == 0


def test_transitive_projection_is_the_identity(spark):
    s = {"a": 1.0, "b": -2.0, "c": 1.0}
    pairs = [("k", x, y, s[x] - s[y]) for x in s for y in s if x < y]
    got = {r["item"]: r["score"] for r in V.transitive_scores(spark.createDataFrame(pairs, "cell string, a string, b string, p double"), "cell", "a", "b", "p").collect()}
    assert all(math.isclose(got[x] - got[y], s[x] - s[y], abs_tol=1e-9) for x in s for y in s)


def test_topk_expectation_against_enumeration(spark):
    from itertools import permutations

    items = [(1.0, True), (1.0, False), (1.0, True), (0.5, True), (2.0, False)]
    df = spark.createDataFrame([("g", a, b) for a, b in items], "g string, s double, good boolean")
    got = R.expected_topk(df, ["g"], "s", F.col("good"), 3).collect()[0]
    total = [sum(x[1] for x in sorted(p, key=lambda x: -x[0])[:3]) for p in permutations(items)]
    assert math.isclose(got["expected_good"], sum(total) / len(total)) and got["taken"] == 3


def test_seats_and_budget(spark):
    df = spark.createDataFrame([("g", "a", 5), ("g", "b", 3), ("g", "c", 2)], "g string, i string, n int")
    assert {r["i"]: r["seats"] for r in R.largest_remainder(df, ["g"], "i", "n", 7).collect()} == {"a": 4, "b": 2, "c": 1}
    assert {r["i"]: r["taken"] for r in R.budget_prefix(df, ["g"], [F.desc("n")], "n", 6).collect()} == {"a": 5, "b": 1}


def test_one_block_has_no_width(spark):
    _, df = _panel(spark)
    one = B.block_sums(df.withColumn("b", F.lit("all")), "b", F.col("p"))
    out = B.bootstrap_interval(one, 50, 3).collect()[0]
    assert out["low"] == out["high"] == out["point"]
    low, high = B.bca_interval(B.block_sums(df, "unit", F.col("p")), 200, 3)
    assert low <= df.agg(F.avg("p")).first()[0] <= high


def test_bh_against_definition(spark):
    ps = [0.01, 0.02, 0.03, 0.5, 0.02]
    got = {r["i"]: r["adjusted"] for r in B.benjamini_hochberg(spark.createDataFrame([("g", i, p) for i, p in enumerate(ps)], "g string, i int, p double"), ["g"], "p", "i").collect()}
    order = sorted(range(5), key=lambda i: (ps[i], i))
    want = {i: min(1.0, min(ps[j] * 5 / (k + 1) for k, j in enumerate(order) if k >= order.index(i))) for i in range(5)}
    assert all(math.isclose(got[i], want[i]) for i in want)


def test_block_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, [float(rng.random() < 0.4) for _ in range(32)]) for i in range(70)] + [(100, None), (101, [0.0] * 32)]
    df = spark.createDataFrame(rows, "id long, v array<float>")

    def alike(a, b):
        both = sum(x * y for x, y in zip(a, b))
        return both / (sum(a) + sum(b) - both) if sum(a) + sum(b) - both else 0.0

    good = [r for r in rows if r[1] is not None]
    got = defaultdict(list)
    for r in S.block_search(df, "id", "v", F.col("id") % 5 == 0, "tanimoto", 3).orderBy("query", "place").collect():
        got[r["query"]].append(r["other"])
    for i, v in good:
        if i % 5 == 0:
            assert got[i] == [j for _, j in sorted((-alike(v, u), j) for j, u in good if j != i)[:3]]
    links = {(r["a"], r["b"]) for r in S.similarity_links(df, "id", "v", 0.5).collect()}
    assert links == {(i, j) for i, v in good for j, u in good if i < j and alike(v, u) >= 0.5}


def test_edges_tie_what_links_tie_without_copying_rows(spark, monkeypatch):
    rng = random.Random(5)
    cores = [[float(rng.random() < 0.3) for _ in range(96)] for _ in range(9)]
    rows = [(i, [x if rng.random() < 0.96 else 1 - x for x in rng.choice(cores)]) for i in range(120)]
    rows += [(200 + i, rows[i % 4][1]) for i in range(30)] + [(300, [0.0] * 96), (301, [0.0] * 96), (302, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = {tuple(r) for r in connected_components(S.similarity_links(df, "id", "v", 0.6)).collect()}
    monkeypatch.setattr(S, "TILE", 32)
    for chunk in (50, 262_144):
        monkeypatch.setattr(S, "CHUNK", chunk)
        monkeypatch.setattr(S, "similarity_links", None)
        edges = [tuple(r) for r in S.similarity_edges(df, "id", "v", 0.6).collect()]
        assert len(edges) == len(set(edges)) and {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_selection(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"r{i}", rng.random(), rng.choice([None, rng.random()])) for i in range(40)]
    df = spark.createDataFrame(rows, "u string, i string, x double, z double")
    out = Q.maxmin_order(df, "u", "i", ["x", "z"], 4).collect()
    assert {r["step"] for r in out} == {0, 1, 2, 3} and len({(r["u"], r["i"]) for r in out}) == 8
    whole = {r["i"] for r in out}
    monkeypatch.setattr(Q, "CHUNK", 7)
    cut = Q.maxmin_order(df, "u", "i", ["x", "z"], 4).collect()
    assert len(cut) == 8 and {r["u"] for r in cut} == {"a", "b"} and whole
    gone = spark.createDataFrame([("a", "1", None), ("b", "2", 1.0)], "u string, i string, x double")
    assert [r["u"] for r in Q.maxmin_order(gone, "u", "i", ["x"], 2).collect()] == ["b"] == [r["u"] for r in Q.d_optimal(gone, "u", "i", ["x"], 2).collect()]
    assert Q.d_optimal(df.where("false"), "u", "i", ["x"], 4).count() == 0
    assert Q.revealed(df, "u", "i", 2, "RANDOM", "x", 1).where("revealed").count() == 4
    off = {r["u"]: r["offset"] for r in Q.shrunk_offsets(df, "u", "x", 2.0).collect()}
    a = [r[2] for r in rows if r[0] == "a"]
    assert math.isclose(off["a"], sum(a) / len(a) * len(a) / (len(a) + 2))


def test_draws_are_reproducible(spark):
    a = Q.normal_draws(spark, 50, {"x": (0.0, 1.0, -1.0, 1.0), "y": (5.0, 2.0, 0.0, 9.0)}, 0.5, 3).collect()
    b = Q.normal_draws(spark, 50, {"x": (0.0, 1.0, -1.0, 1.0), "y": (5.0, 2.0, 0.0, 9.0)}, 0.5, 3).repartition(3).orderBy("draw").collect()
    assert sorted(a) == sorted(b) and all(-1 <= r["x"] <= 1 for r in a)


def test_policies_read_no_target(spark):
    """Permuting the target moves no choice; medoids and centres against brute force; NULL axes, ties, empty tables."""
    rng = random.Random(8)
    rows = [(rng.choice("ab"), f"r{i:02}", float(rng.randint(1, 5)), rng.choice([None, 0.5, 1.0, 4.0]), rng.random(), rng.random(), rng.random()) for i in range(60)]
    schema = "u string, i string, x double, z double, p double, s double, y double"
    df, moved = spark.createDataFrame(rows, schema), spark.createDataFrame([(*r[:6], -r[6]) for r in rows], schema)
    pick = lambda d, policy, k: {(r["u"], r["i"]) for r in Q.acquire(d, "u", "i", k, policy, ["x", "z"], "p", "s").collect()}
    for policy in ("CENTRAL", "FARTHEST", "MEDOID", "MID", "MEDIAN_PREDICTION", "MAX_SPREAD", "MIN_SPREAD"):
        assert pick(df, policy, 2) == pick(moved.repartition(3), policy, 2) and len(pick(df, policy, 2)) == 4, policy
        assert pick(df.where("false"), policy, 2) == set()
    for u in "ab":
        mine = [r for r in rows if r[0] == u and r[3] is not None]
        sd = [max(np.std([r[c] for r in mine]), 1e-12) for c in (2, 3)]
        cost = {r[1]: round(sum(abs(r[2] - o[2]) / sd[0] + abs(r[3] - o[3]) / sd[1] for o in mine), 6) for r in mine}
        assert (u, min(cost, key=lambda i: (cost[i], i))) in pick(df, "MEDOID", 1)


def test_ridge_corrections_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, e = rng.normal(size=(6, 2)), rng.normal(size=6)
    df = spark.createDataFrame([("u", float(a), float(b), float(r)) for (a, b), r in zip(x, e)] + [("v", 1.0, 2.0, 0.5), ("w", 1.0, 1.0, None)], "u string, a double, b double, e double")
    got = {r["u"]: r for r in Q.ridge_corrections(df, "u", "e", ["a", "b"], 1.0).collect()}
    design = np.column_stack([np.ones(6), x])
    want = np.linalg.solve(design.T @ design + np.diag([0.0, 1.0, 1.0]), design.T @ e)
    assert np.allclose([got["u"][f"b{k}"] for k in range(3)], want) and set(got) == {"u", "v"}
    assert math.isclose(got["v"]["b0"], 0.5) and math.isclose(got["v"]["b1"], 0.0, abs_tol=1e-9)


def test_ledgers_tell_lost_invented_and_wrong_lines(spark):
    raw = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    ledger = lambda rows: C.ledger_balance(raw, spark.createDataFrame(rows, "k string, n long"), "k", "n").first()
    assert ledger([("a", 2), ("b", 1), (None, 1)])["balanced"]
    row = ledger([("a", 3), ("c", 1), (None, 1)])
    assert (row["n_lost"], row["n_invented"], row["n_wrong"], row["balanced"], row["raw_rows"], row["ledger_rows"]) == (1, 1, 1, False, 4, 5)


def test_classes_and_canonical_rows(spark):
    rows = [("A", "r10", 1.0, "s"), ("A", "r9", 1.0, "s"), ("B", "r1", 1.0, "s"), ("B", "r2", 1.0, None), ("E", "r3", 1.0, "s"), ("E", "r4", 2.0, "s"), ("F", "r5", None, "s"), ("U", "r6", 1.0, "s")]
    df = spark.createDataFrame(rows, "k string, i string, v double, s string")
    for digits, other in ((5, "B"), (4, "C")):
        c = D.classify_groups(df, F.col("k"), "i", F.col("v"), [F.col("s")], [F.col("v")], F.lit(digits))
        assert {r["key"]: r["class"] for r in c.collect()} == {"A": "A", "B": other, "E": "E", "F": "F", "U": "UNIQUE"}
        kept = {r["i"] for r in D.canonical_rows(df, F.col("k"), "i", c).where("is_canonical_row").collect()}
        assert kept == {"r9", "r1", "r3", "r4", "r5", "r6"} | ({"r2"} if other == "C" else set())


def test_group_lines_beside_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, x double")
    assert sorted((r["g"] or "", r["x"], r["m"]) for r in M.beside(df, ["g"], F.avg("x").alias("m")).collect()) == [("", 5.0, 6.0), ("", 7.0, 6.0), ("a", 1.0, 2.0), ("a", 3.0, 2.0)]
