"""Ranking, top-k under ties, budgets and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lexicographic(df: DataFrame, keys: list[Column], by: list[str]) -> DataFrame:
    """df with `place` from 1 in a complete lexicographic order per group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def expected_top1(df: DataFrame, by: list[str], score: str, truth: str) -> DataFrame:
    """Per group: the mean truth of the items tied at the best score, the best and mean truth, and the regrets of choosing by score and at random."""
    w = Window.partitionBy(*by)
    x = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).withColumn("_best", F.max(score).over(w))
    chosen = F.avg(F.when(F.col(score) == F.col("_best"), F.col(truth)))
    return x.groupBy(*by).agg(chosen.alias("chosen"), F.max(truth).alias("best"), F.avg(truth).alias("mean"), (F.max(truth) - chosen).alias("regret"), (F.max(truth) - F.avg(truth)).alias("random_regret"))


def expected_topk(df: DataFrame, by: list[str], score: str, good: Column, k: int) -> DataFrame:
    """Per group: the expected number of good items among the k best by score, items tied across the border being drawn at random."""
    tied = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("_m"), F.sum(good.cast("int")).alias("_good"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("_m"), F.lit(k) - F.col("_before")))
    return tied.withColumn("_before", before).groupBy(*by).agg(F.sum(F.col("_good") * take / F.col("_m")).alias("expected_good"), F.sum(take).cast("long").alias("taken"))


def coverage_curve(df: DataFrame, by: list[str], confidence: str, tie: Column, error: Column, shares: list[float]) -> DataFrame:
    """Per group and share: the mean error of the most confident ceil(share * n) rows."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_e", error).withColumn("_r", F.row_number().over(w.orderBy(F.desc(confidence), tie))).withColumn("_n", F.count("*").over(w))
    x = x.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).where(F.col("_r") <= F.ceil(F.col("share") * F.col("_n")))
    return x.groupBy(*by, "share").agg(F.count("*").alias("n"), F.avg("_e").alias("mean_error"))


def round_robin(df: DataFrame, cluster: str, order: Column, row_id: str) -> DataFrame:
    """df with `turn`: one row of every cluster per pass, in `order` within it."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(cluster).orderBy(order, row_id)))


def budget_prefix(groups: DataFrame, by: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Whole groups in order until the budget; the last one in part. Adds `taken`."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("_b", before).where(F.col("_b") < budget).withColumn("taken", F.least(F.col(size), F.lit(budget) - F.col("_b")).cast("long")).drop("_b")


def largest_remainder(df: DataFrame, by: list[str], item: str, weight: str, seats: int) -> DataFrame:
    """Seats per item in proportion to weight: floors first, then one each by the greatest remainder, ties to the smaller item."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_q", F.lit(seats) * F.col(weight) / F.sum(weight).over(w)).withColumn("_f", F.floor("_q"))
    x = x.withColumn("_left", F.lit(seats) - F.sum("_f").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), item)))
    return x.withColumn("seats", (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("int")).cast("long")).drop("_q", "_f", "_left", "_r")


def cumulative_share(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """df with `share`: the part of the group's total in this row and all greater ones."""
    w = Window.partitionBy(*by)
    return df.withColumn("share", F.sum(value).over(w.orderBy(F.desc(value), tie).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(w))


def percent_rank_average(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with `pct`: the mean rank of ties over the group's size, and `decile` of the first-come rank."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2
    return df.withColumn("pct", rank / F.count("*").over(w))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The smallest value at which half of the group's weight is reached."""
    w = Window.partitionBy(*by)
    run = F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    x = df.withColumn("_run", run).withColumn("_all", F.sum(weight).over(w)).where(F.col("_run") >= 0.5 * F.col("_all"))
    return x.groupBy(*by).agg(F.min(value).alias("weighted_median"))
