"""Resampling and inference on sufficient statistics.

Rows are reduced once to one line per cluster (n, sum, ...); draws only touch
these lines. Random numbers come from MD5, so a draw depends on (seed, draw,
slot) and on nothing else.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.keys import draw, hash_order
from quarrystone.operators.folds import global_rank


def block_sums(df: DataFrame, block: str, value: Column) -> DataFrame:
    """(block, slot, n, s, s2): one line per block, numbered in hashed order."""
    per = df.where(value.isNotNull()).groupBy(F.col(block).alias("block")).agg(F.count("*").cast("double").alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("s2"))
    return global_rank(per, hash_order(F.col("block"))).withColumnRenamed("rank", "slot")


def bootstrap_means(blocks: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, mean): the ratio of sums over as many blocks, drawn with replacement, as there are."""
    g = blocks.agg(F.count("*")).scalar()
    slots = blocks.select("slot", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picks = slots.select("draw", F.floor(draw(F.lit(seed), F.col("draw"), F.col("slot")) * g).cast("long").alias("slot"))
    counts = picks.groupBy("draw", "slot").agg(F.count("*").alias("k"))
    return counts.join(blocks.select("slot", "n", "s"), "slot").groupBy("draw").agg((F.sum(F.col("k") * F.col("s")) / F.sum(F.col("k") * F.col("n"))).alias("mean"))


def bootstrap_interval(blocks: DataFrame, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """One row: the mean, its percentile interval, the bootstrap standard error, the two-sided share beyond 0 and the effect detectable with 80 % power."""
    a = (1 - level) / 2
    d = bootstrap_means(blocks, draws, seed)
    point = blocks.agg(F.sum("s") / F.sum("n")).scalar()
    p = 2 * F.least(F.avg((F.col("mean") <= 0).cast("double")), F.avg((F.col("mean") >= 0).cast("double")))
    power = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)
    return d.agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"), F.stddev_samp("mean").alias("se"), F.least(F.lit(1.0), p).alias("p")).select(point.alias("point"), "low", "high", "se", "p", (F.col("se") * power).alias("detectable"))


def jackknife(blocks: DataFrame) -> DataFrame:
    """(block, without, influence): the mean without each block and how far it moves."""
    s, n = blocks.agg(F.sum("s")).scalar(), blocks.agg(F.sum("n")).scalar()
    without = F.when(n > F.col("n"), (s - F.col("s")) / (n - F.col("n")))
    return blocks.select("block", without.alias("without"), (without - s / n).alias("influence"))


def bca_interval(blocks: DataFrame, draws: int, seed: int, level: float = 0.95) -> tuple[float, float]:
    """The bias-corrected and accelerated interval; a handful of aggregates come to the driver."""
    normal = NormalDist()
    point = blocks.agg(F.sum("s") / F.sum("n")).first()[0]
    d = bootstrap_means(blocks, draws, seed)
    share = d.agg(F.avg((F.col("mean") < point).cast("double"))).first()[0]
    jack = jackknife(blocks).agg(F.sum(F.pow(-F.col("influence"), 3)).alias("c"), F.sum(F.pow("influence", 2)).alias("q")).first()
    accel = jack["c"] / (6 * jack["q"] ** 1.5) if jack["q"] else 0.0
    z0 = normal.inv_cdf(min(max(share, 1 / (2 * draws)), 1 - 1 / (2 * draws)))

    def at(p: float) -> float:
        z = z0 + normal.inv_cdf(p)
        return normal.cdf(z0 + z / (1 - accel * z))

    a = (1 - level) / 2
    row = d.agg(F.percentile("mean", F.array(F.lit(at(a)), F.lit(at(1 - a))))).first()[0]
    return row[0], row[1]


def robust_errors(blocks: DataFrame) -> DataFrame:
    """One row: the mean and its cluster-robust standard errors CR0 and CR1, and the plain one."""
    s, n = blocks.agg(F.sum("s")).scalar(), blocks.agg(F.sum("n")).scalar()
    m = s / n
    g = F.count("*")
    score = F.sum(F.pow(F.col("s") - m * F.col("n"), 2))
    total = F.sum("n")
    return blocks.agg(F.first(m).alias("mean"), (F.sqrt(score) / total).alias("cr0"), (F.sqrt(score * g / (g - 1)) / total).alias("cr1"), F.sqrt((F.sum("s2") - F.sum("s") * F.sum("s") / total) / (total - 1) / total).alias("plain"), g.alias("n_blocks"))


def wild_cluster_p(blocks: DataFrame, reps: int, seed: int) -> DataFrame:
    """One row: the t statistic of the mean against 0 with cluster-robust errors, and its wild bootstrap p value with Rademacher signs under the null."""
    n = blocks.agg(F.sum("n")).scalar()
    signs = blocks.select("slot", "n", "s", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    flip = F.when(draw(F.lit(seed), F.col("rep"), F.col("slot")) < 0.5, -1.0).otherwise(1.0)
    stat = lambda s: F.sum(s) / F.sqrt(F.sum(F.pow(s, 2)) - 2 * F.sum(s) / n * F.sum(s * F.col("n")) + F.pow(F.sum(s) / n, 2) * F.sum(F.pow("n", 2)))
    null = signs.withColumn("w", flip * F.col("s")).groupBy("rep").agg(stat(F.col("w")).alias("t"))
    t = blocks.agg(stat(F.col("s"))).scalar()
    return null.agg(F.first(t).alias("t"), F.avg((F.abs("t") >= F.abs(t) - 1e-9).cast("double")).alias("p"))


def bayes_means(blocks: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, mean): exponential weights per (draw, block) instead of counts: the Bayesian bootstrap."""
    x = blocks.select("slot", "n", "s", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    w = -F.ln(1 - draw(F.lit(seed), F.col("draw"), F.col("slot")))
    return x.groupBy("draw").agg((F.sum(w * F.col("s")) / F.sum(w * F.col("n"))).alias("mean"))


def sign_flip_null(blocks: DataFrame, reps: int, seed: int) -> DataFrame:
    """One row: the mean of block means and its permutation p value under random signs."""
    x = blocks.select("slot", (F.col("s") / F.col("n")).alias("m"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    null = x.groupBy("rep").agg(F.avg(F.when(draw(F.lit(seed), F.col("rep"), F.col("slot")) < 0.5, -F.col("m")).otherwise(F.col("m"))).alias("m"))
    point = blocks.agg(F.avg(F.col("s") / F.col("n"))).scalar()
    return null.agg(F.first(point).alias("mean"), ((F.count_if(F.abs("m") >= F.abs(point) - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """df with `adjusted`: p * m / rank, made monotone from the largest p down."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_r", F.row_number().over(w.orderBy(p, tie))).withColumn("_m", F.count("*").over(w))
    back = w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(back))).drop("_r", "_m")


def pooled_sd(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """One row: the replicate standard deviation pooled over cells by degrees of freedom, and the cells with replicates."""
    per = df.where(F.col(value).isNotNull()).groupBy(*cell).agg(F.count("*").alias("n"), F.var_samp(value).alias("v")).where("n > 1")
    return per.agg(F.sqrt(F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("noise_sd"), F.count("*").alias("n_cells"), F.sum(F.col("n") - 1).alias("dof"))
