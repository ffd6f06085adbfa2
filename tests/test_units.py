"""Problem 7: units of quantities."""

import itertools
import random
from unittest import mock

import numpy as np
from pyspark.sql import functions as F

from quarrystone.functions.units import UNITS, micromolar, noted_unit, significant, stated_number, stated_unit
from quarrystone.operators import unit_hmm
from quarrystone.operators.unit_hmm import _decode, decode_units, viterbi_units


def test_texts(spark):
    cases = [("ca. 1,5 x 10^-2 mol·L^-1", 0.015, "M"), ("6000  mmol·L⁻¹", 6000.0, "mM"), ("3e-1 M", 0.3, "M"), ("~9 g·dm-3", 9.0, "g/L"), ("10 μM", 10.0, "uM"), ("10 µmol/l", 10.0, "uM"), ("c = 20 mol/m³", 20.0, "mol/m3"), ("1.1169ppm", 1.1169, "mg/L"), ("1 × 10^2 mol m-3", 100.0, "mol/m3"), ("0.2", 0.2, None), ("- -", None, None), ("N/A", None, None), ("", None, None), (None, None, None), ("strong", None, None), ("9" * 10_000, None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: (r["n"], r["u"]) for r in df.select("i", stated_number(F.col("t")).alias("n"), stated_unit(F.col("t")).alias("u")).collect()}
    for i, (text, number, unit) in enumerate(cases[:-1]):
        assert (got[i][0] is None) == (number is None) and (number is None or abs(got[i][0] - number) < 1e-12) and got[i][1] == unit, text


def test_comments(spark):
    cases = [("third phase seen above 3 M; acid column: unit g L-1", "g/L"), ("Säurekonzentration in mmol L-1", "mM"), ("acid tabulated in mol/m³; ligand given in mM", "mol/m3"), ("ligand given in mM", None), ("acid was strong", None), (None, None), ("", None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    assert [r["u"] for r in df.select("i", noted_unit(F.col("t"), "acid|säure").alias("u")).orderBy("i").collect()] == [c[1] for c in cases]


def test_conversion(spark):
    df = spark.createDataFrame([(1.5, "M", None), (98.0, "g/L", 98.0), (98.0, "g/L", None), (0.0, "mM", None), (1.0, None, 1.0)], "v double, u string, m double")
    assert [r[0] for r in df.select(significant(micromolar(F.col("v"), F.col("u"), F.col("m")), 2)).collect()] == [1.5e6, 1e6, None, 0.0, None]


def test_viterbi_against_all_sequences():
    """Random scores with and without pinned records, cut into chains: the decoded sequence is the best of all."""
    rng = np.random.default_rng(0)
    for trial in range(30):
        n, s = 6, len(UNITS)
        score, first = rng.normal(size=(n, s)), rng.random(s)
        cost = rng.random((s, s)) * 2
        pinned = rng.random(n) < 0.3
        score[np.flatnonzero(pinned), rng.integers(0, s, int(pinned.sum()))] += 100.0
        with mock.patch.object(unit_hmm, "CHAIN", 2):
            got = _decode(score, first, cost, pinned)
        total = lambda q: sum(score[i, q[i]] - (cost[q[i - 1], q[i]] if i else first[q[i]]) for i in range(n))  # noqa: B023, E731
        assert abs(total(got) - max(map(total, itertools.product(range(s), repeat=n)))) < 1e-9, trial


def test_chains_do_not_change_the_sequence():
    rng = np.random.default_rng(1)
    n = 3000
    unit = np.where(np.arange(n) % 700 < 350, 0, 1)
    value = 10 ** (rng.normal(5.0, 0.5, n)) / np.array([1e6, 1e3])[unit]
    told = np.where(rng.random(n) < 0.2, unit, -1)
    none = np.full(n, -1)
    parts = [viterbi_units(value, np.full(n, 200.0), [none, told, none], 0)[0]]
    with mock.patch.object(unit_hmm, "CHAIN", 10**9):
        parts.append(viterbi_units(value, np.full(n, 200.0), [none, told, none], 0)[0])
    assert (parts[0] == parts[1]).all()
    right = np.where(np.isin(parts[0], (1, 2)), 1, parts[0]) == unit  # mM and mol/m3 are the same number
    assert right.mean() > 0.97 and (parts[0][told >= 0] == told[told >= 0]).all()


def test_stated_units_are_never_overruled_and_contradictions_are_told():
    value = np.full(200, 0.1)
    value[100] = 5000.0  # said to be molar, five decades off the level
    state, off = viterbi_units(value, np.full(200, np.nan), [np.zeros(200, int), np.full(200, 1), np.full(200, 3)], 0)
    assert (state == 0).all() and off.nonzero()[0].tolist() == [100]
    assert viterbi_units(np.zeros(0), np.zeros(0), [np.zeros(0, int)] * 3, 0)[0].shape == (0,)
    nothing = viterbi_units(np.full(3, np.nan), np.full(3, np.nan), [np.full(3, -1)] * 3, 1)[0]
    assert nothing.tolist() == [1, 1, 1]


def test_precedence_switches_and_edges(spark):
    schema = "record_id string, device string, field_name string, value double, molar_mass double, column_unit string, value_unit string, comment_unit string, file_unit string, unit string"
    rng = random.Random(1)
    rows = [(f"r{i}", "d", "f", 0.1, None, "M", None, None, "M", "x") for i in range(50)]
    rows += [("r50", "d", "f", 100.0, None, "M", "mM", "g/L", "M", "x"), ("r51", "d", "f", 100.0, 50.0, "M", None, "g/L", "M", "x"), ("r52", "d", "f", None, None, "M", None, None, None, "x")]
    rows += [(f"r{100 + i}", None, "f", 100.0 + i, None, "M", None, None, None, "x") for i in range(5)] + [("r100", None, "f", 100.0, None, "M", None, None, None, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, schema)
    out = decode_units(df).collect()
    got = {r["record_id"]: r["unit"] for r in out}
    assert len(out) == len(rows) and got["r0"] == "M" and got["r50"] == "mM" and got["r51"] == "g/L"
    assert decode_units(df.where("false")).count() == 0


def test_a_device_switches_without_being_told():
    level = np.full(40, 0.1)
    level[20:] *= 1000  # from here on in millimoles
    told = np.full(40, -1)
    told[:5] = 0
    state, _ = viterbi_units(level, np.full(40, np.nan), [told, np.full(40, -1), np.full(40, -1)], 0)
    assert set(state[:20]) == {0} and all(UNITS[s] in ("mM", "mol/m3") for s in state[20:])
