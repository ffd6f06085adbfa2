"""Applicability domains in the plane: convex hulls per group.

The hull of hulls is the hull: Arrow batches are reduced to the corners of each
group's points before any shuffle, salted parts of a group next, and only their
corners meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corners(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the hull of a list of points, counter-clockwise from the leftmost; monotone chains."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return chain(pts)[:-1] + chain(pts[::-1])[:-1]


def hulls(df: DataFrame, by: str, x: str, y: str, salts: int = 64) -> DataFrame:
    """(by, place, x, y): the corners of each group's hull, counter-clockwise. Points with a NULL or NaN coordinate take no part; copies count once."""
    kind = dict(df.dtypes)[by]
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(F.col(by).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, g in frame.groupby("k", dropna=False, sort=False):
                c = corners(list(zip(g["x"], g["y"], strict=True)))
                yield pd.DataFrame({"k": [None if pd.isna(k) else k] * len(c), "x": [p[0] for p in c], "y": [p[1] for p in c]})

    def salted(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        c = corners(list(zip(g["x"], g["y"], strict=True)))
        return pd.DataFrame({"k": [key[0]] * len(c), "x": [p[0] for p in c], "y": [p[1] for p in c]})

    def whole(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        c = corners(list(zip(g["x"], g["y"], strict=True)))
        return pd.DataFrame({by: [key[0]] * len(c), "place": np.arange(len(c), dtype=np.int32), "x": [p[0] for p in c], "y": [p[1] for p in c]})

    one = points.mapInPandas(batches, f"k {kind}, x double, y double").withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(salts)))
    two = one.groupBy("k", "salt").applyInPandas(salted, f"k {kind}, x double, y double")
    return two.groupBy("k").applyInPandas(whole, f"{by} {kind}, place int, x double, y double")
