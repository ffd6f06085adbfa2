"""Problem 4: splits that keep related records together.

Values tied by records (entities, labels, sources) are the nodes of a graph; its
connected components are found by label propagation with pointer jumping, all in
joins and aggregates. Components are then assigned to splits by a search over
moves and exchanges of whole components in parallel annealing chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.graph import connected_components
from quarrystone.sources.tables import cut


def tie_edges(df: DataFrame, *nodes: Column) -> DataFrame:
    """Distinct (a, b) node pairs of every row: its first node with each of its others (a row of one node ties it to itself).

    nodes are arrays of strings; NULL arrays and elements are left out.
    """
    blank = F.array().cast("array<string>")
    every = F.filter(F.concat(*[F.coalesce(n, blank) for n in nodes]), lambda x: x.isNotNull())
    rows = df.select(F.array_sort(F.array_distinct(every)).alias("n")).where(F.size("n") > 0).distinct()
    return rows.select(F.col("n")[0].alias("a"), F.explode("n").alias("b")).distinct()


__all__ = ["connected_components", "search_splits", "tie_edges"]


def _energy(sizes: np.ndarray, labels: np.ndarray, want: np.ndarray, total: float, mix: np.ndarray) -> float:
    """Relative deviation of the split sizes, and half that of the label shares."""
    size = np.abs(sizes / total - want).sum()
    share = np.abs(labels / total - want[:, None] * mix[None]).sum()
    return float(size + 0.5 * share)


def _anneal(chain: int, counts: np.ndarray, start: np.ndarray, want: np.ndarray, steps: int) -> tuple[float, np.ndarray]:
    """One annealing chain over the units' label counts; returns the best energy and assignment."""
    rng = np.random.default_rng(7919 * chain + 17)
    size = counts.sum(1)
    total, mix = max(size.sum(), 1.0), counts.sum(0) / max(size.sum(), 1.0)
    k, n = len(want), len(counts)
    place = start.copy()
    labels = np.stack([counts[place == s].sum(0) for s in range(k)])
    sizes = labels.sum(1)
    now = best = _energy(sizes, labels, want, total, mix)
    kept = place.copy()
    if n == 0 or chain < 0:
        return best, kept
    heat = max(now, 1e-6) / 4
    cool = (1e-4) ** (1 / max(steps, 1))
    odds = np.sqrt(size) / np.sqrt(size).sum() if size.sum() else np.full(n, 1 / n)
    picks = rng.choice(n, size=(steps, 2), p=odds)
    to = rng.integers(0, k, steps)
    coin, luck = rng.random(steps) < 0.5, rng.random(steps)
    for t in range(steps):
        i, j = picks[t]
        a = place[i]
        b = place[j] if coin[t] else to[t]
        if a == b:
            continue
        shift = counts[i] - (counts[j] if coin[t] else 0)
        trial = labels.copy()
        trial[a] -= shift
        trial[b] += shift
        moved = _energy(trial.sum(1), trial, want, total, mix)
        if moved <= now or luck[t] < np.exp((now - moved) / heat):
            place[i] = b
            if coin[t]:
                place[j] = a
            labels, now = trial, moved
            if now < best - 1e-12:
                best, kept = now, place.copy()
        heat *= cool
    return best, kept


def search_splits(sizes: DataFrame, proportions: dict[str, float], n_units: int = 2_000, chains: int = 8, steps: int = 20_000, max_labels: int = 64) -> DataFrame:
    """(component, split) for a (component, label, n) table of how many rows of each label a component has.

    Components holding more than 1/n_units of the rows are units of their own, at
    most n_units of them; all others are laid by hash into n_units bundles that
    move as one, so the search sees at most 2 * n_units units however many
    components there are, and no component is ever split. Labels beyond the
    max_labels most frequent are laid by hash into max_labels bins, each balanced
    like a label. Chains start from the hashed
    assignment; the best (energy, chain) wins. An empty table stays empty.
    """
    spark = sizes.sparkSession
    names = list(proportions)
    want = np.array([proportions[s] for s in names])
    want = want / want.sum()
    sizes = cut(sizes)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = [r[0] for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(max_labels).collect()]
    per = sizes.groupBy("component").agg(F.sum("n").alias("size"))
    hashed = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("component"), F.lit(n_units)).cast("string"))
    unit_of = per.select("component", F.when(F.col("size") > total / n_units, F.concat(F.lit("own "), F.col("component"))).otherwise(hashed).alias("unit"))
    named = [x for x in frequent if x is not None]
    place = F.array_position(F.array(*[F.lit(x) for x in named]).cast("array<string>"), F.col("label")) if named else F.lit(0)
    code = F.when(F.col("label").isNull(), 0).when(place > 0, place).otherwise(F.lit(len(named) + 1) + F.pmod(F.xxhash64("label"), F.lit(max_labels)))
    units = sizes.join(unit_of, "component").groupBy("unit", code.cast("int").alias("code")).agg(F.sum("n").alias("n")).collect()  # at most 2 * n_units * (2 * max_labels + 1) rows
    order = sorted({r["unit"] for r in units})
    at = {u: i for i, u in enumerate(order)}
    column = {c: j for j, c in enumerate(sorted({r["code"] for r in units}))}
    counts = np.zeros((len(order), len(column)))
    for r in units:
        counts[at[r["unit"]], column[r["code"]]] += r["n"]
    edges = np.cumsum(want)
    start = np.array([min(int(np.searchsorted(edges, _unit_hash(u), side="right")), len(want) - 1) for u in order], dtype=int)
    data = spark.sparkContext.broadcast((counts, start, want))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chain in frame["id"]:
                energy, place = _anneal(int(chain), *data.value, steps)
                yield pd.DataFrame({"energy": [energy], "chain": [int(chain)], "place": [place.tolist()]})

    if not order:
        return per.select("component", F.lit(None).cast("string").alias("split"))
    best = spark.range(chains, numPartitions=chains).mapInPandas(run, "energy double, chain int, place array<int>").orderBy("energy", "chain").first()
    chosen = spark.createDataFrame([(u, names[p]) for u, p in zip(order, best["place"], strict=True)], "unit string, split string")
    return unit_of.join(F.broadcast(chosen), "unit").select("component", "split")


def _unit_hash(unit: str) -> float:
    """A number in [0, 1) drawn from the unit's name."""
    import hashlib

    return int.from_bytes(hashlib.md5(unit.encode()).digest()[:6], "big") / 2**48
