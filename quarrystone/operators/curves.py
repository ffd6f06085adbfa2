"""Series, curves and windows of a design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.keys import quantised


def curve_members(df: DataFrame, series: str, row_id: str, axes: dict[str, Column], least: int = 3) -> DataFrame:
    """(curve_id, row_id, axis, axis_value, n_points): rows of a series that vary in one axis while all others are held.

    Each row is written once per axis under the quantised values of the other
    axes (unrecorded equals unrecorded); groups with `least` different values of
    the axis are curves. Rows without a series or without the axis take no part.
    """
    names = list(axes)
    held = {n: F.concat_ws("|", *[quantised(axes[o], 6) for o in names if o != n]) for n in names}
    rows = df.where(F.col(series).isNotNull()).select(F.col(series).alias("series"), F.col(row_id).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), axes[n].alias("axis_value"), held[n].alias("held")) for n in names])).alias("s")).select("series", "row_id", "s.*")
    rows = rows.where(F.col("axis_value").isNotNull())
    curves = rows.groupBy("series", "axis", "held").agg(F.count_distinct("axis_value").alias("n_points")).where(F.col("n_points") >= least)
    key = F.substring(F.sha1(F.concat_ws("|", "series", "axis", "held")), 1, 16)
    return rows.join(curves, ["series", "axis", "held"]).select(key.alias("curve_id"), "row_id", "series", "axis", "axis_value", "n_points")


def curve_stats(members: DataFrame, values: DataFrame, row_id: str, y: str) -> DataFrame:
    """Per curve: points, range of the axis, slope, R2, and whether the mean value per axis point never falls ('up'), never rises ('down') or neither."""
    pts = members.join(values.select(F.col(row_id).alias("row_id"), F.col(y).alias("y")), "row_id").where("y IS NOT NULL")
    lin = pts.groupBy("curve_id", "axis").agg(F.count("*").alias("n_rows"), F.regr_slope("y", "axis_value").alias("slope"), F.regr_r2("y", "axis_value").alias("r2"), F.min("axis_value").alias("low"), F.max("axis_value").alias("high"))
    mean = pts.groupBy("curve_id", "axis_value").agg(F.avg("y").alias("m"))
    step = mean.withColumn("d", F.col("m") - F.lag("m").over(Window.partitionBy("curve_id").orderBy("axis_value")))
    trend = step.groupBy("curve_id").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    label = F.when(F.col("least") >= -1e-9, "up").when(F.col("most") <= 1e-9, "down").otherwise("neither")
    return lin.join(trend, "curve_id", "left").withColumn("trend", F.when(F.col("least").isNotNull(), label)).drop("least", "most")


def primary_curve(members: DataFrame) -> DataFrame:
    """Each row's longest curve, ties to the smallest id."""
    size = F.count("*").over(Window.partitionBy("curve_id"))
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("size"), "curve_id"))
    return members.withColumn("size", size).withColumn("place", place).where("place = 1").drop("place")


def window_position(members: DataFrame) -> DataFrame:
    """Where each row stands in its curve: share of the range, rank among the different values, and the gaps to the neighbours (mirrored at the ends)."""
    d = members.select("curve_id", "axis_value").distinct()
    w = Window.partitionBy("curve_id").orderBy("axis_value")
    whole = Window.partitionBy("curve_id")
    below, above = F.col("axis_value") - F.lag("axis_value").over(w), F.lead("axis_value").over(w) - F.col("axis_value")
    low, high = F.min("axis_value").over(whole), F.max("axis_value").over(whole)
    pos = d.select("curve_id", "axis_value", F.row_number().over(w).alias("value_rank"), F.when(high > low, (F.col("axis_value") - low) / (high - low)).alias("position"), F.coalesce(below, above).alias("gap_below"), F.coalesce(above, below).alias("gap_above"))
    return members.select("curve_id", "row_id", "axis_value").join(pos, ["curve_id", "axis_value"])


def closure(members: DataFrame, sides: DataFrame, row_id: str, side: str) -> DataFrame:
    """Curves that touch more than one side of a partition."""
    j = members.join(sides.select(F.col(row_id).alias("row_id"), F.col(side).alias("side")), "row_id")
    return j.groupBy("curve_id").agg(F.count_distinct("side").alias("n_sides"), F.count("*").alias("n")).where("n_sides > 1")


def training_pairs(members: DataFrame) -> DataFrame:
    """(curve_id, kind, a, b): neighbouring points of every curve, and its two ends; points are the smallest row of each axis value."""
    pts = members.groupBy("curve_id", "axis_value").agg(F.min("row_id").alias("row_id"))
    w = Window.partitionBy("curve_id").orderBy("axis_value")
    near = pts.select("curve_id", F.lit("adjacent").alias("kind"), F.col("row_id").alias("a"), F.lead("row_id").over(w).alias("b")).where("b IS NOT NULL")
    ends = pts.groupBy("curve_id").agg(F.min_by("row_id", "axis_value").alias("a"), F.max_by("row_id", "axis_value").alias("b")).where("a <> b").select("curve_id", F.lit("endpoint").alias("kind"), "a", "b")
    return near.unionByName(ends)


def transitive_scores(pairs: DataFrame, cell: str, a: str, b: str, p: str) -> DataFrame:
    """Per cell of a complete pair table, the scores nearest to all pair predictions: the mean prediction of each item against all others (0 against itself)."""
    both = pairs.select(cell, F.col(a).alias("item"), F.col(p).alias("p")).union(pairs.select(cell, F.col(b), -F.col(p)))
    return both.groupBy(cell, "item").agg((F.sum("p") / (F.count("*") + 1)).alias("score"))


def series_kinds(members: DataFrame, rows: DataFrame, series: str, row_id: str) -> DataFrame:
    """Per series: its rows, its curves' axes, and its kind: 'single_point', '<axis>_sweep', 'grid' (several axes) or 'unusable'."""
    size = rows.where(F.col(series).isNotNull()).groupBy(F.col(series).alias("series")).agg(F.count_distinct(row_id).alias("n_rows"))
    axes = members.groupBy("series", "axis").agg(F.count_distinct("row_id").alias("n")).groupBy("series").agg(F.count("*").alias("n_axes"), F.max_by("axis", F.struct("n", "axis")).alias("axis"))
    kind = F.when(F.col("n_rows") == 1, "single_point").when(F.col("n_axes").isNull(), "unusable").when(F.col("n_axes") > 1, "grid").otherwise(F.concat("axis", F.lit("_sweep")))
    return size.join(axes, "series", "left").select("series", "n_rows", F.coalesce("n_axes", F.lit(0).cast("long")).alias("n_axes"), kind.alias("kind"))


def shape_against(members: DataFrame, values: DataFrame, row_id: str, truth: str, guess: str) -> DataFrame:
    """Per curve: slopes of truth and guess, how much of the true span the guess spans, and the mean error once both are centred."""
    pts = members.join(values.select(F.col(row_id).alias("row_id"), F.col(truth).alias("y"), F.col(guess).alias("p")), "row_id").where("y IS NOT NULL AND p IS NOT NULL")
    w = Window.partitionBy("curve_id")
    e = F.abs((F.col("y") - F.avg("y").over(w)) - (F.col("p") - F.avg("p").over(w)))
    span = lambda c: F.max(c) - F.min(c)
    return pts.withColumn("e", e).groupBy("curve_id", "axis").agg(F.regr_slope("y", "axis_value").alias("true_slope"), F.regr_slope("p", "axis_value").alias("guess_slope"), F.when(span("y") > 0, span("p") / span("y")).alias("span_recovery"), F.avg("e").alias("shape_mae"), F.count("*").alias("n"))


def decoys(members: DataFrame, drop_every: int, shift: float) -> DataFrame:
    """Perturbed copies of every curve: 'drop' without every n-th point in order, 'shift' with the axis moved, 'far' with one point beyond the end."""
    w = Window.partitionBy("curve_id").orderBy("axis_value", "row_id")
    ranked = members.withColumn("_r", F.row_number().over(w))
    cols = ["curve_id", "row_id", "axis_value"]
    drop = ranked.where(F.col("_r") % drop_every != 0).select(F.lit("drop").alias("variant"), *cols)
    moved = members.select(F.lit("shift").alias("variant"), "curve_id", "row_id", (F.col("axis_value") + shift).alias("axis_value"))
    far = members.groupBy("curve_id").agg((2 * F.max("axis_value") - F.min("axis_value")).alias("axis_value")).select(F.lit("far").alias("variant"), "curve_id", F.concat(F.lit("far:"), "curve_id").alias("row_id"), "axis_value")
    return drop.unionByName(moved).unionByName(far)


def candidates(template: DataFrame, keys: list[str], column: str, values: list[float]) -> DataFrame:
    """Synthetic points: every template row with each of the listed values of one column, a deterministic id and no target."""
    grid = template.select(*keys, F.explode(F.array(*[F.lit(v) for v in values])).alias(column))
    return grid.withColumn("candidate_id", F.substring(F.sha1(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.format_number(column, 6))), 1, 16))
