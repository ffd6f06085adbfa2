"""Hierarchical metrics: every unit one vote, decompositions, bands and weights.

All functions are grouped aggregates or windows over columns of the caller's
names; nothing is collected. Rows with a NULL truth or prediction are left out
of error metrics. Empty input gives an empty table, or one row of NULLs where a
total is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """df with the aggregates of each row's group beside it.

    Groups are aggregated with map-side combination and joined, one line each, so
    no group's rows meet in one task; NULL keys are a group.
    """
    line = df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(*aggregates)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    return df.join(line, on, "left").drop(*[f"_by{i}" for i in range(len(by))])


def nested_mean(df: DataFrame, value: Column, levels: list[str]) -> DataFrame:
    """The mean of means: within all levels, then over the last level, and so on down to one number, with the number of groups of each step."""
    cur = df.where(value.isNotNull()).groupBy(*levels).agg(F.avg(value).alias("m"))
    for k in range(len(levels) - 1, 0, -1):
        cur = cur.groupBy(*levels[:k]).agg(F.avg("m").alias("m"))
    return cur.agg(F.avg("m").alias("macro"), F.stddev_samp("m").alias("sd_top"), F.count("*").alias("n_top"))


def long_arms(df: DataFrame, keys: list[str], truth: str, arms: list[str]) -> DataFrame:
    """One row per input row and arm: keys, truth y, arm, prediction p."""
    return df.unpivot([*keys, truth], arms, "arm", "p").withColumnRenamed(truth, "y").where("y IS NOT NULL AND p IS NOT NULL")


def error_summary(long: DataFrame, by: list[str], least_rows: int = 8, least_sd: float = 0.1) -> DataFrame:
    """Per group: n, mae, rmse, bias, median absolute error and R2, which is NULL for fewer than least_rows rows or a truth with less spread."""
    e = F.col("p") - F.col("y")
    sst = F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / F.count("*")
    return long.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_ae"),
        F.when((F.count("*") >= least_rows) & (F.stddev_pop("y") >= least_sd), 1 - F.sum(e * e) / sst).alias("r2"),
    )


def with_reason(summary: DataFrame, least_rows: int) -> DataFrame:
    """The summary with why R2 is missing: 'too few rows', 'no spread' or NULL."""
    return summary.withColumn("reason", F.when(F.col("r2").isNull(), F.when(F.col("n") < least_rows, "too few rows").otherwise("no spread")))


def level_and_shape(long: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """Splits each unit's error into its level (the mean residual) and its shape (what is left): per group the unit means of both, and the shares of the squared error."""
    e = F.col("p") - F.col("y")
    per = long.groupBy(*by, unit).agg(F.count("*").alias("n"), F.avg(e).alias("b"), F.sum(e * e).alias("sse"))
    centred = beside(long, [*by, unit], F.avg(e).alias("_b")).groupBy(*by, unit).agg(F.avg(F.abs(e - F.col("_b"))).alias("shape"))
    return per.join(centred, [*by, unit]).groupBy(*by).agg(
        F.count("*").alias("n_units"), F.avg(F.abs("b")).alias("level_mae"), F.avg("shape").alias("shape_mae"), (F.sum(F.col("n") * F.col("b") * F.col("b")) / F.sum("sse")).alias("level_share")
    )


def rank_average(value: Column, partition: list[str]) -> Column:
    """Ranks from 1 with ties at their mean rank."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation per group; NULL where a side does not vary."""
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, rank_average(F.col(a), by).alias("ra"), rank_average(F.col(b), by).alias("rb"))
    safe = F.when((F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0), F.corr("ra", "rb"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), safe.alias("rho"))


def kendall(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau-b per group from tie counts of the joint values: pairs are formed between different value cells, never between rows."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    x, y = cells.alias("x"), cells.alias("y")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in by] + [(F.col("x.a") < F.col("y.a"))]
    s = x.join(y, on).groupBy(*[F.col(f"x.{k}").alias(k) for k in by]).agg(F.sum(F.col("x.n") * F.col("y.n") * F.signum(F.col("y.b") - F.col("x.b"))).alias("s"))
    pairs = lambda c: c * (c - 1) / 2
    tot = cells.groupBy(*by).agg(F.sum("n").alias("n"))
    ta = cells.groupBy(*by, "a").agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(pairs(F.col("m"))).alias("ta"))
    tb = cells.groupBy(*by, "b").agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(pairs(F.col("m"))).alias("tb"))
    out = tot.join(ta, by).join(tb, by).join(s, by, "left")
    den = F.sqrt((pairs(F.col("n")) - F.col("ta")) * (pairs(F.col("n")) - F.col("tb")))
    return out.select(*by, "n", F.when(den > 0, F.coalesce("s", F.lit(0.0)) / den).alias("tau_b"))


def banded(df: DataFrame, value: Column, edges: list[tuple[str, float | None, float | None]], aggregates: list[Column], by: list[str] | None = None) -> DataFrame:
    """Aggregates per band (low, high], bands without rows kept, and a first band 'all'. edges: (name, low, high), None is open."""
    spark, by = df.sparkSession, by or []
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["all", *[e[0] for e in edges]])], "band_order int, band string")
    label = F.lit(None).cast("string")
    for name, low, high in edges:
        inside = value.isNotNull() & (F.lit(True) if low is None else value > low) & (F.lit(True) if high is None else value <= high)
        label = F.when(inside, F.lit(name)).otherwise(label)
    marked = df.withColumn("band", F.explode(F.array(F.lit("all"), label))).where("band IS NOT NULL")
    stats = marked.groupBy("band", *by).agg(F.count("*").alias("n"), *aggregates)
    return names.join(stats, "band", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).drop("band_order")


def strata(df: DataFrame, value: Column, cuts: list[float], aggregates: list[Column]) -> DataFrame:
    """Aggregates over overlapping strata: 'all', and for each cut 'lt_<cut>' and 'ge_<cut>'."""
    labels = [F.lit("all")] + [F.when(value < c, F.lit(f"lt_{c:g}")).when(value >= c, F.lit(f"ge_{c:g}")) for c in cuts]
    return df.withColumn("stratum", F.explode(F.array(*labels))).where("stratum IS NOT NULL").groupBy("stratum").agg(F.count("*").alias("n"), *aggregates)


def balanced_weights(df: DataFrame, group: str, block: str | None = None, block_shares: dict[str, float] | None = None) -> DataFrame:
    """df with `weight`: every group the same total, the whole table's weights averaging 1; with block_shares, blocks scaled to those relative masses."""
    raw = beside(df, [group], F.count("*").alias("_n")).withColumn("_w", 1.0 / F.col("_n")).drop("_n")
    if block:
        share = F.lit(None).cast("double")
        for name, s in (block_shares or {}).items():
            share = F.when(F.col(block) == name, F.lit(s)).otherwise(share)
        raw = beside(raw, [block], F.sum("_w").alias("_mass")).withColumn("_w", F.coalesce(share, F.lit(1.0)) * F.col("_w") / F.col("_mass")).drop("_mass")
    total = raw.agg((F.sum("_w") / F.count("*")).alias("m"))
    return raw.withColumn("weight", F.col("_w") / total.scalar()).drop("_w")


def effective_sizes(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """One row: rows, clusters, Kish's effective number of clusters (sum n)^2 / sum n^2, the one-way ANOVA intraclass correlation and the effective clusters it leaves."""
    per = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    one = per.agg(
        F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between"),
    )
    msb, msw = F.col("between") / (F.col("g") - 1), F.col("within") / (F.col("n") - F.col("g"))
    n0 = (F.col("n") - F.col("n2") / F.col("n")) / (F.col("g") - 1)
    icc = F.greatest(F.lit(0.0), (msb - msw) / (msb + (n0 - 1) * msw))
    return one.where("g > 1 AND n > g").select(F.col("n").cast("long").alias("n_rows"), F.col("g").alias("n_clusters"), (F.col("n") * F.col("n") / F.col("n2")).alias("kish"), icc.alias("icc"), (F.col("n") / (1 + (n0 - 1) * icc)).alias("effective_rows"))


def leave_one_out_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """df with `loo_mean`: the mean of the other rows of the group, NULL where there is none."""
    n, s, x = F.col("_n"), F.col("_s"), F.col(value)
    return beside(df, [group], F.count(value).alias("_n"), F.sum(value).alias("_s")).withColumn("loo_mean", F.when(x.isNull() & (n > 0), s / n).otherwise(F.when(n > 1, (s - x) / (n - 1)))).drop("_n", "_s")


def peers_median(df: DataFrame, group: str, entity: str, value: str, limit: float) -> DataFrame:
    """Per (group, entity): its mean, the median of the other entities' means in the group, and whether they differ by at least `limit`.

    The median without one's own value lies at one of three ranks around the middle, so each group is one line with the values
    there, joined to its ranked entities: no group is an array and no pairs are formed.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(group, entity).agg(F.avg(value).alias("own"))
    ranked = per.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("own", entity)))
    counted = beside(ranked, [group], F.count("*").alias("_n"))
    half = F.floor((F.col("_n") - 1) / 2)
    at = [F.max(F.when(F.col("_r") == F.col("_half") + k, F.col("own"))).alias(f"_v{k}") for k in (0, 1, 2)]
    joined = beside(counted.withColumn("_half", half), [group], *at)
    # The p-th of the others is at rank p before one's own place and at p + 1 from there on.
    other = lambda p: F.when(F.col("_r") > F.col("_half") + p, F.col(f"_v{p}")).otherwise(F.col(f"_v{p + 1}"))
    mid = F.when((F.col("_n") - 1) % 2 == 1, other(1)).otherwise((other(0) + other(1)) / 2)
    return joined.withColumn("peers", F.when(F.col("_n") > 1, mid)).select(group, entity, "own", "peers", F.coalesce(F.abs(F.col("own") - F.col("peers")) >= limit, F.lit(False)).alias("outlying"))


def quadratic_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per group: least squares slope, intercept and R2, and for four or more different x the curvature and turning point of a parabola.

    The parabola comes from centred power sums (two passes of sums), solved in closed form.
    """
    rows = beside(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, F.avg(x).alias("_m")).withColumn("_x", F.col(x) - F.col("_m"))
    s = lambda e: F.sum(e)
    X, Y = F.col("_x"), F.col(y)
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct(x).alias("distinct_x"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"),
        s(X * X).alias("s2"), s(X * X * X).alias("s3"), s(X * X * X * X).alias("s4"), s(Y).alias("y0"), s(X * Y).alias("y1"), s(X * X * Y).alias("y2"), F.first("_m").alias("m"), F.min(x).alias("lo"), F.max(x).alias("hi"),
    )
    n, s2, s3, s4 = (F.col(c) for c in ("n", "s2", "s3", "s4"))
    det = n * s2 * s4 - n * s3 * s3 - s2 * s2 * s2
    curve = F.when((F.col("distinct_x") >= 4) & (F.abs(det) > 1e-9), (n * s2 * F.col("y2") - n * s3 * F.col("y1") - s2 * s2 * F.col("y0")) / det)
    linear = (F.col("y1") - F.col("curvature") * s3) / s2
    turn = F.when(F.abs("curvature") > 1e-12, F.col("m") - linear / (2 * F.col("curvature")))
    out = g.withColumn("curvature", curve).withColumn("turn", turn)
    return out.select(*by, "n", "distinct_x", "slope", "intercept", "r2", "curvature", F.when((F.col("turn") > F.col("lo")) & (F.col("turn") < F.col("hi")), F.col("turn")).alias("turning_point"))


def sampling_clusters(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """One row: clusters G, the within-cluster correlation rho by one-way analysis of variance, the variation Gamma of the clusters' shares in the variance of a mean, n + n (n - 1) rho, and the effective number G / (1 + Gamma)."""
    per = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    one = per.agg(
        F.sum("n").alias("N"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("ssb"),
    )
    one = one.select("g", (F.col("ssw") / F.greatest(F.col("N") - F.col("g"), F.lit(1))).alias("msw"), (F.col("ssb") / F.greatest(F.col("g") - 1, F.lit(1))).alias("msb"), ((F.col("N") - F.col("n2") / F.col("N")) / F.greatest(F.col("g") - 1, F.lit(1))).alias("n0"))
    between = F.greatest((F.col("msb") - F.col("msw")) / F.greatest(F.col("n0"), F.lit(1e-9)), F.lit(0.0))
    rho = one.select((between / F.greatest(between + F.col("msw"), F.lit(1e-12))).alias("rho"))
    share = F.col("n") + F.col("n") * (F.col("n") - 1) * F.col("rho")
    out = per.join(F.broadcast(rho)).agg(F.count("*").alias("n_clusters"), F.first("rho").alias("rho"), (F.var_pop(share) / F.pow(F.avg(share), 2)).alias("gamma"))  # rho is one row
    return out.where("n_clusters > 0").withColumn("effective_clusters", F.col("n_clusters") / (1 + F.col("gamma")))
