"""Units of recorded quantities by a hidden Markov model per device.

The hidden state of a record is the unit its number was written in. A record
emits what it says of its unit (at the value, in the comment, what the device is
known to use) and its number: log10(value in that unit) lies around a smooth
level of the device. Viterbi decodes the most likely sequence of units, so a
number without a stated unit gets one from how far it jumps off the level and
from how its device is used to write.

Shares of the units, switch rate, level and spread are learned per device from
the records that say their unit, and learned again from the decoded sequence
where some say nothing. What a record says outweighs level and transitions, and
each kind of saying all weaker kinds, so stated units are never overruled;
`contradicts` tells where the level speaks against the decoded unit instead.

The dynamic program runs over all records. A record whose own words leave only
one unit possible in every optimal sequence separates what lies before it from
what comes after; at such records a device is cut into chains of CHAIN or more
records, which is exact, and all chains of a task advance in lockstep.

A device is decoded in chunks of `chunk` consecutive record numbers, so one
device may hold any share of the rows without gathering in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.units import MICROGRAMS, MICROMOLES, UNITS

WEIGHTS = (3000.0, 300.0, 30.0)  # at the value, in the comment, of the device
LEAST = 1e-3  # no learned probability is smaller, so two switches and the level weigh less than any statement
FAR = 6.0  # the most that a number's distance from the level may weigh
WINDOW = 31  # records that the level is smoothed over
CHAIN = 64
DECADE = 1.0  # distance from the level, in log10, that contradicts a unit
_FACTOR = np.array([MICROMOLES.get(u, MICROGRAMS.get(u)) for u in UNITS])
_BY_MASS = np.array([u in MICROGRAMS for u in UNITS])


def _logs(value: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 of micromoles per litre of each value under each unit; NaN where it can't be told."""
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(value > 0, np.log10(value), np.nan)[:, None] + np.log10(_FACTOR)[None]
        return np.where(_BY_MASS[None], base - np.log10(mass)[:, None], base)


def _smooth(own: np.ndarray, fallback: np.ndarray) -> np.ndarray:
    """The level at each record: a centred mean over the records around it whose quantity is known."""
    ok = np.isfinite(own)
    if not ok.any():
        own, ok = fallback, np.isfinite(fallback)
        if not ok.any():
            return np.zeros(len(own))
    v, w = np.where(ok, own, 0.0), min(len(own), WINDOW)
    around = lambda x: np.convolve(x, np.ones(w))[w // 2 : w // 2 + len(x)]
    weight = around(ok.astype(float))
    return np.where(weight > 0, around(v) / np.maximum(weight, 1), v.sum() / ok.sum())


def learn(state: np.ndarray, logs: np.ndarray, default: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(costs of the first state, costs of the transitions, level, spread) from a sequence of states, -1 where unknown."""
    known = state >= 0
    seen = state[known]
    share = np.bincount(seen, minlength=len(UNITS)) + 0.5 * (np.arange(len(UNITS)) == default)
    share = np.maximum(share / share.sum(), LEAST)
    share /= share.sum()
    # Switches against those that records drawn from the shares alone would show.
    rate = (float((seen[1:] != seen[:-1]).sum()) + 0.5) / (max(len(seen) - 1, 0) * (1 - float((share * share).sum())) + 1)
    rate = min(1.0, max(LEAST, rate))
    cost = -np.log(np.maximum((1 - rate) * np.eye(len(UNITS)) + rate * share[None], LEAST))
    own = np.where(known, logs[np.arange(len(state)), np.maximum(state, 0)], np.nan)
    level = _smooth(own, logs[:, default])
    off = own[np.isfinite(own)] - level[np.isfinite(own)]
    return -np.log(share), cost, level, float(max(0.3, np.sqrt((off @ off + 1.0) / (len(off) + 1))))


def _decode(score: np.ndarray, first: np.ndarray, cost: np.ndarray, pinned: np.ndarray) -> np.ndarray:
    """The best sequence of states by Viterbi. pinned: records whose best score no sequence around them can outweigh."""
    n = len(score)
    at = np.flatnonzero(pinned)
    starts = np.concatenate([[0], at[np.unique(at // CHAIN, return_index=True)[1]] + 1])
    starts = np.unique(starts[starts < n])
    length = np.diff(np.append(starts, n))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # chains with more than t records
    before = score[np.maximum(starts - 1, 0)].argmax(1)
    best = score[starts] - np.where((starts == 0)[:, None], first[None], cost[before])
    back = np.zeros((n, score.shape[1]), np.int8)
    for t in range(1, int(length[0])):
        rows = starts[: alive[t]] + t
        step = best[: alive[t], :, None] - cost[None]
        back[rows] = step.argmax(1)
        best[: alive[t]] = step.max(1) + score[rows]
    state = np.zeros(n, np.int64)
    state[starts + length - 1] = best.argmax(1)
    for t in range(int(length[0]) - 1, 0, -1):
        rows = starts[: alive[t]] + t
        state[rows - 1] = back[rows, state[rows]]
    return state


def viterbi_units(value, mass, evidence, default: int) -> tuple[np.ndarray, np.ndarray]:
    """(decoded state, whether the level contradicts it) of each record of one device in order. evidence: arrays of unit indexes (-1 none), strongest first."""
    n, s = len(value), len(UNITS)
    said = np.zeros((n, s))
    for code, weight in zip(evidence, WEIGHTS, strict=True):
        hit = code >= 0
        said[np.flatnonzero(hit), code[hit]] += weight
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    ranked = np.sort(said, axis=1)
    pinned = ranked[:, -1] - ranked[:, -2] > FAR - 2 * np.log(LEAST)
    logs = _logs(np.asarray(value, float), np.asarray(mass, float))
    state = np.where(said.any(1), said.argmax(1), -1)
    for _ in range(1 if (state >= 0).all() else 3):
        first, cost, level, spread = learn(state, logs, default)
        fit = -np.minimum(((logs - level[:, None]) / spread) ** 2 / 2, FAR)
        score = said + np.where(np.isfinite(fit), fit, -FAR)
        score[:, default] += 1e-6  # ties go to the column's own unit
        state = _decode(score, first, cost, pinned)
    with np.errstate(invalid="ignore"):
        off = np.abs(logs - level[:, None])
    own = off[np.arange(n), state]
    nearest = np.where(np.isfinite(off), off, np.inf).min(1)
    return state, np.isfinite(own) & (own > DECADE) & (own > 2 * spread) & (nearest < own / 2)


def decode_units(df: DataFrame, keep: tuple[str, ...] = (), chunk: int = 200_000) -> DataFrame:
    """Adds `unit` and `contradicts` to records of (record_id, device, field_name, value, molar_mass, column_unit, value_unit, comment_unit, file_unit).

    Only record_id, field_name, value, molar_mass, column_unit and the columns of `keep` come out with it. `value` may be NULL: the record keeps its
    place but says nothing of the level. Units that are NULL or unknown are no
    evidence. Records without a device form one device. The order within a
    device is the number in record_id (its hash where there is none), ties by
    record_id; rows repeated under one id stay. An empty table stays empty.
    """
    code = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(u) for u in UNITS]), F.col(c)).cast("int") - 1, F.lit(-1))
    number = F.coalesce(F.regexp_extract("record_id", r"(\d{1,15})\D*$", 1).try_cast("long"), F.pmod(F.xxhash64("record_id"), F.lit(10**12)))
    slim = df.select(
        "record_id", "field_name", F.coalesce(F.col("device"), F.lit("")).alias("device"), number.alias("number"), F.col("value").cast("double").alias("value"), F.col("molar_mass").cast("double").alias("molar_mass"),
        *keep, code("column_unit").alias("c0"), code("value_unit").alias("c1"), code("comment_unit").alias("c2"), code("file_unit").alias("c3"),
    ).withColumn("part", F.floor(F.col("number") / chunk))

    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["number", "record_id"], kind="stable")
        state, contradicts = viterbi_units(rows["value"].to_numpy(float), rows["molar_mass"].to_numpy(float), [rows[c].to_numpy(int) for c in ("c1", "c2", "c3")], max(int(rows["c0"].iloc[0]), 0))
        return pd.DataFrame({"record_id": rows["record_id"], "field_name": rows["field_name"], "value": rows["value"], "molar_mass": rows["molar_mass"], **{c: rows[c] for c in keep}, "c0": rows["c0"], "state": state, "contradicts": contradicts})

    kept = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    out = slim.groupBy("device", "field_name", "part").applyInPandas(decode, f"record_id string, field_name string, value double, molar_mass double{kept}, c0 int, state int, contradicts boolean")
    named = lambda c: F.try_element_at(F.array(*[F.lit(u) for u in UNITS]), F.col(c) + 1)
    return out.select("record_id", "field_name", *keep, F.when(~F.isnan("value"), F.col("value")).alias("value"), F.when(~F.isnan("molar_mass"), F.col("molar_mass")).alias("molar_mass"), named("c0").alias("column_unit"), named("state").alias("unit"), "contradicts")
