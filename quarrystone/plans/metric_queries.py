"""Hierarchical metrics over a panel of lineitem: unit = part, block = brand, seed = line number modulo 3, three deterministic arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import metrics as M
from quarrystone.sources.tables import table

ARMS = ["arm_price", "arm_flat", "arm_net"]
BANDS = [("tiny", None, 0.0), ("far", 0.0, 10.0), ("mid", 10.0, 30.0), ("near", 30.0, None)]


def panel(spark, d):
    line = table(spark, d, "lineitem", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = table(spark, d, "part", "p_partkey", "p_brand", "p_retailprice")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("unit"), F.col("p_brand").alias("block"), (F.col("l_linenumber") % 3).alias("seed"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("arm_price"), (F.col("l_quantity") * 1.4).alias("arm_flat"), (F.col("l_quantity") * 1.5 * (1 - F.col("l_discount"))).alias("arm_net"), F.col("l_tax").alias("tax"),
    )


_PANEL = """WITH panel AS (SELECT l_partkey AS unit, p_brand AS block, l_linenumber % 3 AS seed, l_quantity AS x, l_extendedprice / 1000 AS y,
  l_quantity * p_retailprice / 1000 AS arm_price, l_quantity * 1.4 AS arm_flat, l_quantity * 1.5 * (1 - l_discount) AS arm_net, l_tax AS tax
  FROM lineitem JOIN part ON l_partkey = p_partkey),
long AS (SELECT unit, block, seed, y, 'arm_price' AS arm, arm_price AS p FROM panel UNION ALL SELECT unit, block, seed, y, 'arm_flat', arm_flat FROM panel UNION ALL SELECT unit, block, seed, y, 'arm_net', arm_net FROM panel)
"""


def err():
    return F.abs(F.col("y") - F.col("arm_flat"))


def rounded(df, digits=4, nudge=0.0):
    """df with its floating columns rounded; a nudge far below the last digit moves exact ties to one side in every engine."""
    return df.select(*[F.round(F.col(c) + nudge if nudge else F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def macro_mae_units(spark, d):
    line = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice")
    unit = table(spark, d, "orders", "o_orderkey", "o_custkey")
    err = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000)
    per = line.join(unit, line.l_orderkey == unit.o_orderkey).groupBy("o_custkey").agg(F.avg(err).alias("mae"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg("mae"), 4).alias("macro_mae"), F.count("*").alias("n_units"), F.sum("n").alias("n_rows"))


def macro_three_level(spark, d):
    return rounded(M.nested_mean(panel(spark, d), err(), ["seed", "unit"]))


def macro_block_nested(spark, d):
    return rounded(M.nested_mean(panel(spark, d), err(), ["seed", "block", "unit"]))


def _long(spark, d, *keys):
    return M.long_arms(panel(spark, d), list(keys), "y", ARMS)


def arm_leaderboard(spark, d):
    return rounded(M.error_summary(_long(spark, d), ["arm"]))


def guarded_r2_by_unit(spark, d):
    return rounded(M.with_reason(M.error_summary(_long(spark, d, "unit").where("arm = 'arm_flat'"), ["unit"], 25, 5.0), 25), 4, 1e-9)


def level_shape_decomposition(spark, d):
    return rounded(M.level_and_shape(_long(spark, d, "unit"), "unit", ["arm"]))


def unit_rank_correlation(spark, d):
    return rounded(M.spearman(panel(spark, d), ["block"], "y", "arm_net"))


def unit_kendall(spark, d):
    return rounded(M.kendall(panel(spark, d), ["seed"], "x", "tax"))


def band_summary(spark, d):
    return rounded(M.banded(panel(spark, d), F.col("x"), BANDS, [F.avg(err()).alias("mae"), F.count_distinct("unit").alias("n_units")]))


def strata_summary(spark, d):
    return rounded(M.strata(panel(spark, d), F.col("x"), [10.0, 25.5], [F.avg(err()).alias("mae")]))


def direction_accuracy(spark, d):
    p = panel(spark, d)
    y, g = F.col("y") - 36, F.col("arm_flat") - 35
    hit = F.when(g == 0, 0.5).when(F.signum(g) == F.signum(y), 1.0).otherwise(0.0)
    return rounded(p.where(F.abs(y) >= 5).groupBy("block").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy")))


def worst_quartile(spark, d):
    from pyspark.sql import Window

    per = panel(spark, d).groupBy("block", "unit").agg(F.avg(err()).alias("mae"))
    w = Window.partitionBy("block")
    place = F.row_number().over(w.orderBy(F.desc("mae"), "unit"))
    return rounded(per.withColumn("r", place).withColumn("n", F.count("*").over(w)).where(F.col("r") <= F.ceil(0.25 * F.col("n"))).groupBy("block").agg(F.avg("mae").alias("worst_quartile"), F.count("*").alias("n_units")))


def quantile_table(spark, d):
    q = panel(spark, d).groupBy("seed").agg(F.percentile("y", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"))
    return rounded(q.select("seed", *[F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))]))


def group_balanced_weights(spark, d):
    w = M.balanced_weights(panel(spark, d), "unit", "block", {"Brand#11": 2.0})
    return rounded(w.groupBy("block").agg(F.sum("weight").alias("mass"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.count("*").alias("n")))


def equal_unit_mean(spark, d):
    w = M.balanced_weights(panel(spark, d), "unit")
    return rounded(w.groupBy("seed").agg((F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("weighted_mean"), F.avg("y").alias("plain_mean")))


def effective_sizes(spark, d):
    return rounded(M.effective_sizes(panel(spark, d), "unit", "y"))


def sampling_clusters(spark, d):
    return rounded(M.sampling_clusters(panel(spark, d), "block", "y"), 6)


def loo_group_mean(spark, d):
    x = M.leave_one_out_mean(panel(spark, d), "unit", "y")
    return rounded(x.groupBy("block").agg(F.avg("loo_mean").alias("loo_mean"), F.max(F.abs(F.col("loo_mean") - F.col("y"))).alias("largest_gap"), F.count("loo_mean").alias("n")))


def leave_self_out_median(spark, d):
    return rounded(M.peers_median(panel(spark, d), "block", "unit", "y", 15.0))


def quadratic_fits(spark, d):
    return rounded(M.quadratic_fit(panel(spark, d), ["block"], "x", "y"), 7)


def grid_probabilities(spark, d):
    p = panel(spark, d)
    grid = [F.round(F.avg((F.col("y") >= t).cast("double")), 6).alias(f"p_ge_{t}") for t in (10, 25, 50)]
    both = F.round(F.avg(((F.col("y") >= 25) & (F.col("tax") < 0.04)).cast("double")), 6).alias("p_both")
    return p.groupBy("block").agg(*grid, both)


def crosstab_matrix(spark, d):
    return panel(spark, d).groupBy("block").pivot("seed", [0, 1, 2]).count().na.fill(0).select("block", *[F.col(str(k)).alias(f"seed_{k}") for k in (0, 1, 2)])


def size_buckets(spark, d):
    per = panel(spark, d).groupBy("unit").agg(F.count("*").alias("n"))
    label = F.when(F.col("n") <= 1, "(0,1]").when(F.col("n") <= 20, "(1,20]").when(F.col("n") <= 30, "(20,30]").otherwise("(30,inf)")
    return per.groupBy(label.alias("bucket")).agg(F.count("*").alias("n_units"), F.sum("n").alias("n_rows"))


def coverage_table(spark, d):
    return rounded(panel(spark, d).groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.col("tax") > 0.05).alias("n_high_tax"), F.count_distinct("unit").alias("n_units"), F.min("y").alias("least"), F.max("y").alias("most"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd")))


def rollup_revenue(spark, d):
    return rounded(panel(spark, d).rollup("block", "seed").agg(F.sum("y").alias("total"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("level")), 7)


def cube_counts(spark, d):
    return table(spark, d, "dataset", "metal_symbol", "cond__diluent__kerosene").cube("metal_symbol", "cond__diluent__kerosene").agg(F.count("*").alias("n"))


def approximate_uniques(spark, d):
    return panel(spark, d).groupBy("block").agg(F.approx_count_distinct("unit").alias("about_units"), F.approx_percentile("y", 0.5).alias("about_median"))


def variance_components(spark, d):
    p = panel(spark, d).groupBy("unit").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    t = p.agg(F.sum("n").alias("N"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("v")).alias("ssw"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("ssb"))
    return rounded(t.select("g", (F.col("ssb") / (F.col("g") - 1)).alias("ms_between"), (F.col("ssw") / (F.col("N") - F.col("g"))).alias("ms_within"), F.sqrt(F.col("ssw") / (F.col("N") - F.col("g"))).alias("noise_sd")))


QUERIES = {
    f.__name__: f
    for f in (
        macro_mae_units, macro_three_level, macro_block_nested, arm_leaderboard, guarded_r2_by_unit, level_shape_decomposition, unit_rank_correlation, unit_kendall, band_summary, strata_summary, direction_accuracy, worst_quartile,
        quantile_table, group_balanced_weights, equal_unit_mean, effective_sizes, sampling_clusters, loo_group_mean, leave_self_out_median, quadratic_fits, grid_probabilities, crosstab_matrix, size_buckets, coverage_table, rollup_revenue, cube_counts,
        approximate_uniques, variance_components,
    )
}
_SUMMARY = "count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(p - y), 4) AS bias, round(median(abs(p - y)), 4) AS median_ae"
_NUDGED = _SUMMARY.replace(", 4)", " + 1e-9, 4)")
_RANKS = "SELECT block, rank() OVER (PARTITION BY block ORDER BY y) + (count(*) OVER (PARTITION BY block, y) - 1) / 2 AS ra, rank() OVER (PARTITION BY block ORDER BY arm_net) + (count(*) OVER (PARTITION BY block, arm_net) - 1) / 2 AS rb FROM panel"
SQL = {
    "macro_mae_units": """
SELECT round(avg(mae), 4) AS macro_mae, count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_rows
FROM (SELECT o_custkey, avg(abs(l_extendedprice - l_quantity * 1000)) AS mae, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
""",
    "macro_three_level": _PANEL + "SELECT round(avg(m), 4) AS macro, round(stddev_samp(m), 4) AS sd_top, count(*) AS n_top FROM (SELECT seed, avg(m) AS m FROM (SELECT seed, unit, avg(abs(y - arm_flat)) AS m FROM panel GROUP BY ALL) GROUP BY seed)",
    "macro_block_nested": _PANEL + "SELECT round(avg(m), 4) AS macro, round(stddev_samp(m), 4) AS sd_top, count(*) AS n_top FROM (SELECT seed, avg(m) AS m FROM (SELECT seed, block, avg(m) AS m FROM (SELECT seed, block, unit, avg(abs(y - arm_flat)) AS m FROM panel GROUP BY ALL) GROUP BY ALL) GROUP BY seed)",
    "arm_leaderboard": _PANEL + f"SELECT arm, {_SUMMARY}, round(1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 4) AS r2 FROM long GROUP BY arm",
    "guarded_r2_by_unit": _PANEL
    + f"SELECT *, CASE WHEN r2 IS NULL THEN CASE WHEN n < 25 THEN 'too few rows' ELSE 'no spread' END END AS reason FROM (SELECT unit, {_NUDGED}, CASE WHEN count(*) >= 25 AND stddev_pop(y) >= 5 THEN round(1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)) + 1e-9, 4) END AS r2 FROM long WHERE arm = 'arm_flat' GROUP BY unit)",
    "level_shape_decomposition": _PANEL
    + """, r AS (SELECT arm, unit, p - y AS e, avg(p - y) OVER (PARTITION BY arm, unit) AS b FROM long),
u AS (SELECT arm, unit, count(*) AS n, avg(e) AS b, sum(e * e) AS sse, avg(abs(e - b)) AS shape FROM r GROUP BY arm, unit)
SELECT arm, count(*) AS n_units, round(avg(abs(b)), 4) AS level_mae, round(avg(shape), 4) AS shape_mae, round(sum(n * b * b) / sum(sse), 4) AS level_share FROM u GROUP BY arm""",
    "unit_rank_correlation": _PANEL + f"SELECT block, count(*) AS n, round(corr(ra, rb), 4) AS rho FROM ({_RANKS}) GROUP BY block",
    "unit_kendall": _PANEL
    + """, c AS (SELECT seed, x AS a, tax AS b, count(*) AS n FROM panel GROUP BY ALL),
s AS (SELECT c1.seed, sum(c1.n * c2.n * sign(c2.b - c1.b)) AS s FROM c c1 JOIN c c2 ON c1.seed = c2.seed AND c1.a < c2.a GROUP BY 1),
t AS (SELECT seed, sum(n) AS n FROM c GROUP BY 1), ta AS (SELECT seed, sum(m * (m - 1) / 2) AS ta FROM (SELECT seed, a, sum(n) AS m FROM c GROUP BY ALL) GROUP BY 1),
tb AS (SELECT seed, sum(m * (m - 1) / 2) AS tb FROM (SELECT seed, b, sum(n) AS m FROM c GROUP BY ALL) GROUP BY 1)
SELECT seed, CAST(n AS BIGINT) AS n, round(s / sqrt((n * (n - 1) / 2 - ta) * (n * (n - 1) / 2 - tb)), 4) AS tau_b FROM t JOIN ta USING (seed) JOIN tb USING (seed) JOIN s USING (seed)""",
    "band_summary": _PANEL
    + """, b AS (SELECT * FROM (VALUES ('all'), ('tiny'), ('far'), ('mid'), ('near')) v(band)),
m AS (SELECT 'all' AS band, * FROM panel UNION ALL SELECT CASE WHEN x <= 0 THEN 'tiny' WHEN x <= 10 THEN 'far' WHEN x <= 30 THEN 'mid' ELSE 'near' END, * FROM panel)
SELECT b.band, count(unit) AS n, round(avg(abs(y - arm_flat)), 4) AS mae, CASE WHEN count(unit) > 0 THEN count(DISTINCT unit) END AS n_units FROM b LEFT JOIN m USING (band) GROUP BY b.band""",
    "strata_summary": _PANEL + "SELECT s AS stratum, count(*) AS n, round(avg(abs(y - arm_flat)), 4) AS mae FROM (SELECT *, unnest(['all', CASE WHEN x < 10 THEN 'lt_10' ELSE 'ge_10' END, CASE WHEN x < 25.5 THEN 'lt_25.5' ELSE 'ge_25.5' END]) AS s FROM panel) GROUP BY s",
    "direction_accuracy": _PANEL + "SELECT block, count(*) AS n, round(avg(CASE WHEN arm_flat - 35 = 0 THEN 0.5 WHEN sign(arm_flat - 35) = sign(y - 36) THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM panel WHERE abs(y - 36) >= 5 GROUP BY block",
    "worst_quartile": _PANEL + "SELECT block, round(avg(mae), 4) AS worst_quartile, count(*) AS n_units FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY mae DESC, unit) AS r, count(*) OVER (PARTITION BY block) AS n FROM (SELECT block, unit, avg(abs(y - arm_flat)) AS mae FROM panel GROUP BY ALL)) WHERE r <= ceil(0.25 * n) GROUP BY block",
    "quantile_table": _PANEL + "SELECT seed, " + ", ".join(f"round(quantile_cont(y, {q}), 4) AS {n}" for q, n in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"))) + " FROM panel GROUP BY seed",
    "group_balanced_weights": _PANEL
    + """, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY unit) AS w FROM panel), v AS (SELECT *, (CASE WHEN block = 'Brand#11' THEN 2.0 ELSE 1.0 END) * w / sum(w) OVER (PARTITION BY block) AS v FROM w)
SELECT block, round(sum(v / m), 4) AS mass, round(min(v / m), 4) AS least, round(max(v / m), 4) AS most, count(*) AS n FROM v, (SELECT avg(v) AS m FROM v) GROUP BY block""",
    "equal_unit_mean": _PANEL + "SELECT seed, round(sum(w * y) / sum(w), 4) AS weighted_mean, round(avg(y), 4) AS plain_mean FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY unit) AS w FROM panel) GROUP BY seed",
    "effective_sizes": _PANEL
    + """, u AS (SELECT unit, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM panel GROUP BY unit),
o AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS g, CAST(sum(n * n) AS DOUBLE) AS n2, sum(n * v) AS w, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b FROM u),
k AS (SELECT *, b / (g - 1) AS msb, w / (n - g) AS msw, (n - n2 / n) / (g - 1) AS n0 FROM o), i AS (SELECT *, greatest(0.0, (msb - msw) / (msb + (n0 - 1) * msw)) AS icc FROM k)
SELECT CAST(n AS BIGINT) AS n_rows, g AS n_clusters, round(n * n / n2, 4) AS kish, round(icc, 4) AS icc, round(n / (1 + (n0 - 1) * icc), 4) AS effective_rows FROM i""",
    "sampling_clusters": _PANEL
    + """, u AS (SELECT block, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m, var_pop(y) AS v FROM panel GROUP BY block),
o AS (SELECT sum(n) AS nn, count(*) AS g, sum(n * n) AS n2, sum(n * v) AS ssw, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS ssb FROM u), k AS (SELECT ssw / (nn - g) AS msw, ssb / (g - 1) AS msb, (nn - n2 / nn) / (g - 1) AS n0 FROM o),
r AS (SELECT greatest((msb - msw) / n0, 0.0) / (greatest((msb - msw) / n0, 0.0) + msw) AS rho FROM k), w AS (SELECT rho, n + n * (n - 1) * rho AS w FROM u, r)
SELECT count(*) AS n_clusters, round(any_value(rho), 6) AS rho, round(var_pop(w) / pow(avg(w), 2), 6) AS gamma, round(count(*) / (1 + var_pop(w) / pow(avg(w), 2)), 6) AS effective_clusters FROM w""",
    "loo_group_mean": _PANEL + "SELECT block, round(avg(l), 4) AS loo_mean, round(max(abs(l - y)), 4) AS largest_gap, count(l) AS n FROM (SELECT *, CASE WHEN count(*) OVER w > 1 THEN (sum(y) OVER w - y) / (count(*) OVER w - 1) END AS l FROM panel WINDOW w AS (PARTITION BY unit)) GROUP BY block",
    "leave_self_out_median": _PANEL
    + """, e AS (SELECT block, unit, avg(y) AS own FROM panel GROUP BY ALL)
SELECT a.block, a.unit, round(a.own, 4) AS own, round(median(b.own), 4) AS peers, coalesce(abs(a.own - median(b.own)) >= 15, false) AS outlying FROM e a LEFT JOIN e b ON a.block = b.block AND a.unit <> b.unit GROUP BY a.block, a.unit, a.own""",
    "quadratic_fits": _PANEL
    + """, c AS (SELECT block, y, x AS x0, x - avg(x) OVER (PARTITION BY block) AS x, avg(x) OVER (PARTITION BY block) AS m FROM panel),
g AS (SELECT block, count(*) AS n, count(DISTINCT x0) AS distinct_x, regr_slope(y, x0) AS slope, regr_intercept(y, x0) AS intercept, regr_r2(y, x0) AS r2, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS y0, sum(x*y) AS y1, sum(x*x*y) AS y2, first(m) AS m, min(x0) AS lo, max(x0) AS hi FROM c GROUP BY block),
q AS (SELECT *, (n*s2*y2 - n*s3*y1 - s2*s2*y0) / (n*s2*s4 - n*s3*s3 - s2*s2*s2) AS k FROM g), t AS (SELECT *, m - ((y1 - k*s3) / s2) / (2*k) AS turn FROM q)
SELECT block, n, distinct_x, round(slope, 7) AS slope, round(intercept, 7) AS intercept, round(r2, 7) AS r2, round(k, 7) AS curvature, CASE WHEN turn > lo AND turn < hi THEN round(turn, 7) END AS turning_point FROM t""",
    "grid_probabilities": _PANEL + "SELECT block, " + ", ".join(f"round(avg(CASE WHEN y >= {t} THEN 1.0 ELSE 0.0 END), 6) AS p_ge_{t}" for t in (10, 25, 50)) + ", round(avg(CASE WHEN y >= 25 AND tax < 0.04 THEN 1.0 ELSE 0.0 END), 6) AS p_both FROM panel GROUP BY block",
    "crosstab_matrix": _PANEL + "SELECT block, " + ", ".join(f"count(*) FILTER (WHERE seed = {k}) AS seed_{k}" for k in (0, 1, 2)) + " FROM panel GROUP BY block",
    "size_buckets": _PANEL + "SELECT CASE WHEN n <= 1 THEN '(0,1]' WHEN n <= 20 THEN '(1,20]' WHEN n <= 30 THEN '(20,30]' ELSE '(30,inf)' END AS bucket, count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT unit, count(*) AS n FROM panel GROUP BY unit) GROUP BY 1",
    "coverage_table": _PANEL + "SELECT block, count(*) AS n, count(*) FILTER (WHERE tax > 0.05) AS n_high_tax, count(DISTINCT unit) AS n_units, round(min(y), 4) AS least, round(max(y), 4) AS most, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS sd FROM panel GROUP BY block",
    "rollup_revenue": _PANEL + "SELECT block, seed, round(sum(y), 7) AS total, count(*) AS n, CAST(grouping(block) * 2 + grouping(seed) AS BIGINT) AS level FROM panel GROUP BY ROLLUP (block, seed)",
    "cube_counts": "SELECT metal_symbol, cond__diluent__kerosene, count(*) AS n FROM dataset GROUP BY CUBE (metal_symbol, cond__diluent__kerosene)",
    "variance_components": _PANEL
    + """, u AS (SELECT unit, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM panel GROUP BY unit), t AS (SELECT CAST(sum(n) AS DOUBLE) AS nn, count(*) AS g, sum(n * v) AS ssw, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS ssb FROM u)
SELECT g, round(ssb / (g - 1), 4) AS ms_between, round(ssw / (nn - g), 4) AS ms_within, round(sqrt(ssw / (nn - g)), 4) AS noise_sd FROM t""",
}
