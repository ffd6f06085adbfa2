"""Problem 9: filling containers of fixed capacity by linear grouping.

Items longer than a container give full containers and one rest. What is left
has at most capacity-1 different sizes, so the histogram of sizes, counted over
all items, says everything the plan needs; it is planned on the driver in
run-length form, at a cost that depends on the capacity and not on the number of
items:

1. sizes above a fraction of the capacity are large; in order of size they are
   cut into groups of equal cardinality, and every size counts as the greatest
   of its group;
2. configurations of these few sizes are chosen one after another, each the
   fullest one the remaining counts allow (a bounded knapsack), used as often as
   they allow;
3. the actual items of a group replace the rounded ones in order of size, which
   frees room;
4. small sizes, longest first, go where they fit best, and open containers only
   when nothing fits.

The plan is a list of runs "items r.. of size s lie k each in containers c..".
Items get their rank within their size by two-level counting, so a size shared
by a third of all items is ranked in many tasks, and look their container up.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.sources.tables import cut

Run = tuple[int, int, int, int, int]  # size, first rank, items, first container, items per container


def _groups(counts: dict[int, int], n_groups: int) -> list[list[tuple[int, int]]]:
    """The sizes, longest first, cut into groups of equally many items: lists of (size, items)."""
    total = sum(counts.values())
    if not total:
        return []
    share = -(-total // n_groups)
    out: list[list[tuple[int, int]]] = [[]]
    room = share
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            take = min(left, room)
            out[-1].append((size, take))
            left, room = left - take, room - take
            if not room:
                out.append([])
                room = share
    return [g for g in out if g]


def _fullest(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each size fill one container best: bounded knapsack, ties to fewer and longer items."""
    reach = [-1] * (capacity + 1)  # the last size used to reach a sum
    used: list[tuple[int, ...] | None] = [None] * (capacity + 1)
    used[0] = (0,) * len(sizes)
    for i, s in enumerate(sizes):
        for total in range(s, capacity + 1):
            before = used[total - s]
            if used[total] is None and before is not None and before[i] < counts[i]:
                used[total] = (*before[:i], before[i] + 1, *before[i + 1 :])
                reach[total] = i
    best = max(t for t in range(capacity + 1) if used[t] is not None)
    return list(used[best])


def plan_packing(histogram: dict[int, int], capacity: int, large: float = 0.125, n_groups: int = 24) -> tuple[list[Run], int]:
    """(runs, number of containers) for items of sizes 1..capacity."""
    runs: list[Run] = []
    n = 0  # containers so far
    next_rank: dict[int, int] = {}

    def take(size: int, items: int, first: int, per: int) -> None:
        rank = next_rank.get(size, 0)
        runs.append((size, rank, items, first, per))
        next_rank[size] = rank + items

    room: dict[int, list[tuple[int, int]]] = {}  # free room -> [(first container, containers)]
    if full := histogram.get(capacity, 0):
        take(capacity, full, 0, 1)
        n = full
    groups = _groups({s: c for s, c in histogram.items() if large * capacity < s < capacity and c}, n_groups)
    rounded, left = [g[0][0] for g in groups], [sum(c for _, c in g) for g in groups]
    while any(left):
        use = _fullest(rounded, left, capacity)
        times = min(left[i] // u for i, u in enumerate(use) if u)
        parts = [(n, times, capacity)]  # the containers of this configuration by free room
        for i, u in enumerate(use):
            for _ in range(u):
                fresh = []
                for first, k, free in parts:
                    while k:
                        size, have = groups[i][-1]  # shortest first: rounding never exceeds the group's greatest
                        m = min(k, have)
                        take(size, m, first, 1)
                        fresh.append((first, m, free - size))
                        first, k = first + m, k - m
                        groups[i][-1] = (size, have - m)
                        if have == m:
                            groups[i].pop()
                parts = fresh
            left[i] -= u * times
        n += times
        for first, k, free in parts:
            if free:
                room.setdefault(free, []).append((first, k))
    rooms = sorted(room)

    def put_back(free: int, first: int, k: int) -> None:
        if free and k:
            if free not in room:
                insort(rooms, free)
            room.setdefault(free, []).append((first, k))

    for size in sorted((s for s in histogram if 0 < s <= large * capacity), reverse=True):
        items = histogram[size]
        while items:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                k = -(-items // per)
                first, n, free = n, n + k, capacity
            else:
                free = rooms[at]
                first, k = room[free].pop()
                if not room[free]:
                    del room[free], rooms[at]
            per = free // size
            whole = min(k, items // per)
            if whole:
                take(size, whole * per, first, per)
                items -= whole * per
                put_back(free - per * size, first, whole)
            if whole < k and items:
                take(size, items, first + whole, items)
                put_back(free - items * size, first + whole, 1)
                whole, items = whole + 1, 0
            put_back(free, first + whole, k - whole)
    return runs, n


def pack(sized: DataFrame, item: str, size: str, capacity: int, per_task: int = 200_000) -> DataFrame:
    """(item, piece, size, container): every item of a (item, size) table in containers of `capacity`.

    An item is split only if it is longer than a container: into full pieces and
    one rest, numbered from 0. Items of size 0 or NULL need no room and are laid
    into existing containers by their hash (container 0 if there is none). Rows
    repeated under one id are items of their own. An empty table stays empty.
    """
    s = F.coalesce(F.col(size).cast("long"), F.lit(0))
    pieces = F.expr(f"sequence(0L, greatest(ceil(_s / {capacity}) - 1, 0L))")
    items = cut(sized.select(F.col(item).alias("item"), s.alias("_s")).select("item", "_s", F.explode(pieces).alias("piece")).select("item", "piece", F.least(F.col("_s") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size")))
    per_size = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    empty = per_size.pop(0, 0)
    runs, n = plan_packing(per_size, capacity)
    salts = max(1, -(-max(per_size.values(), default=1) // per_task))
    salted = items.withColumn("salt", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("item", "piece"), F.lit(salts)).cast("int")))
    sizes = salted.where("size > 0").groupBy("size", "salt").agg(F.count("*").alias("n"))  # at most capacity * salts rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("size", "salt", before.alias("before"))
    mine = Window.partitionBy("size", "salt").orderBy("item", "piece")
    ranked = salted.where("size > 0").withColumn("own", F.row_number().over(mine) - 1).join(offsets, ["size", "salt"]).select("item", "piece", "size", (F.col("own") + F.col("before")).alias("rank"))
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    shipped = sized.sparkSession.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table))

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        keys, plan = shipped.value
        at = np.searchsorted(keys, size.to_numpy(np.int64) << 40 | rank.to_numpy(np.int64), side="right") - 1
        return pd.Series(plan[at, 3] + (rank.to_numpy(np.int64) - plan[at, 1]) // plan[at, 4])

    placed = ranked.select("item", "piece", "size", container("size", "rank").alias("container"))
    if empty:
        placed = placed.unionByName(items.where("size = 0").select("item", "piece", "size", (F.pmod(F.xxhash64("item"), F.lit(n)) if n else F.lit(0).cast("long")).alias("container")))
    return placed


__all__ = ["pack", "plan_packing"]
