"""Held-out metals, halves, thinning, pools, arms on fixed tests, series kinds, curve shapes, candidates, hulls, and small reshapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions.clean import is_blank, number_or_null, squeeze
from quarrystone.operators import curves as V
from quarrystone.operators import designs as G
from quarrystone.operators import hull as H
from quarrystone.operators import metrics as M
from quarrystone.plans.design_queries import _curves, _rows
from quarrystone.plans.metric_queries import panel, rounded
from quarrystone.sources.tables import table


def held_out_metals(spark, d):
    return G.eligible_holdouts(_rows(spark, d), "metal_symbol", "extractant", 100, 30)


def random_folds(spark, d):
    return G.random_folds(table(spark, d, "dataset", "row_id"), "row_id", 5, 3)


def confirmation_halves(spark, d):
    g = _rows(spark, d).groupBy("extractant").agg(F.count("*").alias("n"), F.min("chemotype").alias("chemotype"))
    return G.halves(g, "extractant", "n", "chemotype", "salt").select("extractant", "half")


def thinned_chemotypes(spark, d):
    return G.thinned(_rows(spark, d), "chemotype", 10, 23).groupBy("chemotype").agg(F.count("*").alias("n"))


def pool_split(spark, d):
    return G.pool_and_evaluation(_rows(spark, d).select("row_id", "extractant"), "extractant", "row_id", 19, 10).select("row_id", "part")


def fixed_test_arms(spark, d):
    core = _rows(spark, d).where("y IS NOT NULL").select("row_id", "fold")
    extra = table(spark, d, "corpus_records", "record_id").dropDuplicates().select(F.concat(F.lit("aux:"), "record_id").alias("row_id"))
    return G.fixed_test_arms(core, extra, "row_id", "fold", 5, 41).groupBy("arm", "held_fold", "role").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def balanced_bins(spark, d):
    """Chemotypes in five bins, heaviest first to the lightest: the unit table of a design is small and checked."""
    sizes = _rows(spark, d).where("chemotype IS NOT NULL").groupBy("chemotype").agg(F.count("*").alias("n")).limit(100_001).collect()
    if len(sizes) > 100_000:
        raise ValueError("more units than a design's table may have")
    bins = G.greedy_bins([(r["chemotype"], r["n"]) for r in sizes], 5)
    return spark.createDataFrame(sorted(bins.items()), "chemotype string, bin int")


def structure_matched_control(spark, d):
    """The publications whose removal matches the rows that the publication mask of fold 0 removes."""
    rows = _rows(spark, d)
    inside = rows.where("fold = 0").select("publication").distinct()
    need = rows.where("fold <> 0").join(inside, "publication", "left_semi").count()
    sizes = rows.where("fold <> 0 AND publication IS NOT NULL").join(inside, "publication", "left_anti").groupBy("publication").agg(F.count("*").alias("n")).limit(100_001).collect()
    if len(sizes) > 100_000:
        raise ValueError("more publications than a design's table may have")
    return spark.createDataFrame([(p, need) for p in G.closest_fit([(r["publication"], r["n"]) for r in sizes], need)], "publication string, needed long")


def series_kinds(spark, d):
    t, m = _curves(spark, d)
    return V.series_kinds(m, t, "series_id", "row_id").groupBy("kind").agg(F.count("*").alias("n_series"), F.sum("n_rows").alias("n_rows"))


def curve_shapes(spark, d):
    t, m = _curves(spark, d)
    values = t.withColumn("p", F.round(F.col("y") / 2) * 2)
    return rounded(V.shape_against(m, values, "row_id", "y", "p").groupBy("axis").agg(F.count("*").alias("n_curves"), F.percentile("shape_mae", F.lit(0.5)).alias("median_shape_mae"), F.avg("span_recovery").alias("span_recovery")), 6)


def curve_decoys(spark, d):
    return V.decoys(_curves(spark, d)[1], 3, 0.5).groupBy("variant").agg(F.count("*").alias("n"), F.round(F.sum("axis_value"), 3).alias("total"))


def candidate_points(spark, d):
    t = table(spark, d, "dataset", "extractant", "metal_symbol").distinct()
    return V.candidates(t, ["extractant", "metal_symbol"], "acid", [0.1, 1.0, 3.0]).groupBy("metal_symbol", "acid").agg(F.count_distinct("candidate_id").alias("n"))


def domain_hulls(spark, d):
    t = table(spark, d, "corpus_records", "metal", "acid_nominal_M", "ligand_M")
    return H.hulls(t, "metal", "acid_nominal_M", "ligand_M").groupBy("metal").agg(F.count("*").alias("n_corners"), F.round(F.max("x"), 6).alias("widest"), F.round(F.max("y"), 6).alias("highest"))


def row_centred(spark, d):
    t = table(spark, d, "dataset", "extractant", "condition_id", "metal_symbol", "log_D").where("log_D IS NOT NULL AND NOT isnan(log_D)")
    c = t.groupBy("extractant", "condition_id", "metal_symbol").agg(F.avg("log_D").alias("v"))
    return rounded(c.withColumn("centred", F.col("v") - F.avg("v").over(Window.partitionBy("extractant", "condition_id"))).groupBy("metal_symbol").agg(F.avg("centred").alias("mean"), F.count("*").alias("n")), 6)


def one_hot_classes(spark, d):
    t = table(spark, d, "corpus_records", "record_id", "metal").dropDuplicates(["record_id"])
    metals = ["La", "Nd", "Eu", "Lu"]
    return t.select("record_id", *[(F.col("metal") == m).cast("int").alias(f"is_{m.lower()}") for m in metals]).groupBy(*[f"is_{m.lower()}" for m in metals]).agg(F.count("*").alias("n"))


def constant_means(spark, d):
    t = table(spark, d, "dataset", "series_id", "cond__temperature_C", "metal_symbol").where("series_id IS NOT NULL")
    x = t.withColumn("t", number_or_null(F.col("cond__temperature_C")))
    return x.groupBy("series_id").agg(F.round(G.constant_mean("t"), 6).alias("temperature"), F.mode("metal_symbol", True).alias("usual_metal"))


def category_lists(spark, d):
    """For each record the sorted severities of its flags, joined to a text."""
    t = table(spark, d, "dataset_all_metals", "canonical_measurement_id", "flags").dropDuplicates(["canonical_measurement_id"])
    cat = F.broadcast(table(spark, d, "flag_catalog"))  # eleven rows
    e = t.select("canonical_measurement_id", F.explode("flags").alias("f")).select("canonical_measurement_id", F.lower(squeeze(F.col("f"))).alias("flag")).join(cat, "flag")
    return e.groupBy("canonical_measurement_id").agg(F.array_join(F.array_sort(F.collect_set("severity")), ";").alias("severities")).groupBy("severities").agg(F.count("*").alias("n"))


def calibration_bins(spark, d):
    p = panel(spark, d)
    b = F.least(F.floor(F.col("arm_flat") / 10), F.lit(6)).cast("int")
    return rounded(p.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("arm_flat").alias("said"), F.avg("y").alias("seen"), F.regr_slope("y", "arm_flat").alias("slope")), 6)


def namespaced_union(spark, d):
    a = table(spark, d, "dataset", "row_id", "log_D").select(F.concat(F.lit("core:"), "row_id").alias("id"), F.col("row_id").alias("original"), number_or_null(F.col("log_D")).alias("y"))
    b = table(spark, d, "corpus_records", "record_id", "log_d").select(F.concat(F.lit("aux:"), "record_id").alias("id"), F.col("record_id").alias("original"), number_or_null(F.col("log_d")).alias("y")).dropDuplicates(["id"])
    u = a.unionByName(b)
    return u.groupBy(F.substring_index("id", ":", 1).alias("side")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count("y").alias("n_targets"))


def provenance_ledger(spark, d):
    """Documents and the records they name: resolved, dangling and without a record."""
    doc = table(spark, d, "documents", "doc_id", "measurement_id")
    rec = table(spark, d, "dataset_all_metals", "canonical_measurement_id").distinct().withColumn("found", F.lit(True))
    j = doc.join(rec, F.col("measurement_id") == F.col("canonical_measurement_id"), "left")
    label = F.when(is_blank(F.col("measurement_id")), "none").when(F.col("found"), "resolved").otherwise("dangling")
    return j.groupBy(label.alias("state")).agg(F.count("*").alias("n"))


def seed_arm_summary(spark, d):
    long = M.long_arms(panel(spark, d), ["seed"], "y", ["arm_price", "arm_flat", "arm_net"])
    return rounded(M.error_summary(long, ["arm", "seed"]).select("arm", "seed", "n", "mae", "rmse", "bias"), 5)


QUERIES = {
    f.__name__: f
    for f in (
        held_out_metals, random_folds, confirmation_halves, thinned_chemotypes, pool_split, fixed_test_arms, balanced_bins, structure_matched_control, series_kinds, curve_shapes, curve_decoys, candidate_points, domain_hulls,
        row_centred, one_hot_classes, constant_means, category_lists, calibration_bins, namespaced_union, provenance_ledger, seed_arm_summary,
    )
}

from quarrystone.plans.curation_queries import _FLAGS  # noqa: E402
from quarrystone.plans.design_queries import _MEMBERS, _ROWS  # noqa: E402
from quarrystone.plans.metric_queries import _PANEL  # noqa: E402

SQL = {
    "held_out_metals": _ROWS + "SELECT metal_symbol, count(*) AS n_rows, count(DISTINCT extractant) AS n_systems FROM r WHERE metal_symbol IS NOT NULL GROUP BY 1 HAVING count(*) >= 100 AND count(DISTINCT extractant) >= 30",
    "random_folds": "SELECT row_id, CAST(CAST('0x' || substr(md5('3:' || row_id), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM dataset",
    "confirmation_halves": _ROWS + "SELECT extractant, CASE WHEN k % 4 IN (1, 0) THEN 'selection' ELSE 'confirmation' END AS half FROM (SELECT *, row_number() OVER (PARTITION BY chemotype ORDER BY n DESC, md5('salt' || extractant)) AS k FROM (SELECT extractant, count(*) AS n, min(chemotype) AS chemotype FROM r GROUP BY 1))",
    "thinned_chemotypes": _ROWS + "SELECT chemotype, count(*) AS n FROM r WHERE chemotype IN (SELECT chemotype FROM (SELECT DISTINCT chemotype FROM r WHERE chemotype IS NOT NULL) ORDER BY md5('23:' || chemotype), chemotype LIMIT 10) GROUP BY 1",
    "pool_split": "SELECT row_id, CASE WHEN k < greatest(2, n // 2) THEN 'evaluation' WHEN k < greatest(2, n // 2) + 10 THEN 'pool' ELSE 'unused' END AS part FROM (SELECT row_id, row_number() OVER (PARTITION BY extractant ORDER BY md5('19:' || row_id)) - 1 AS k, count(*) OVER (PARTITION BY extractant) AS n FROM dataset)",
    "fixed_test_arms": _ROWS
    + """, c AS (SELECT row_id, fold FROM r WHERE y IS NOT NULL), h AS (SELECT unnest([0, 1, 2, 3, 4])::INT AS held_fold), x AS (SELECT DISTINCT 'aux:' || record_id AS row_id FROM corpus_records), t AS (SELECT held_fold, row_id FROM c, h WHERE fold <> held_fold), m AS (SELECT held_fold, row_id FROM x, h),
k AS (SELECT held_fold, row_id FROM (SELECT *, row_number() OVER (PARTITION BY held_fold ORDER BY md5('41:' || held_fold || ':' || row_id)) - 1 AS k FROM t) WHERE k >= (SELECT count(*) FROM x)),
a AS (SELECT 'BASE' AS arm, * FROM t UNION ALL SELECT 'EXPANDED', * FROM t UNION ALL SELECT 'EXPANDED', * FROM m UNION ALL SELECT 'ROWMATCHED', * FROM k UNION ALL SELECT 'ROWMATCHED', * FROM m)
SELECT arm, held_fold, 'train' AS role, count(*) AS n, min(row_id) AS first_row FROM a GROUP BY ALL UNION ALL SELECT arm, fold, 'test', count(*), min(row_id) FROM c, (SELECT unnest(['BASE', 'EXPANDED', 'ROWMATCHED']) AS arm) GROUP BY ALL""",
    "series_kinds": _MEMBERS
    + """, s AS (SELECT series_id, count(DISTINCT row_id) AS n_rows FROM dataset WHERE series_id IS NOT NULL GROUP BY 1), a AS (SELECT d.series_id, m.axis, count(DISTINCT m.row_id) AS n FROM m JOIN dataset d USING (row_id) GROUP BY ALL), b AS (SELECT series_id, count(*) AS n_axes, arg_max(axis, (n, axis)) AS axis FROM a GROUP BY 1)
SELECT CASE WHEN n_rows = 1 THEN 'single_point' WHEN n_axes IS NULL THEN 'unusable' WHEN n_axes > 1 THEN 'grid' ELSE axis || '_sweep' END AS kind, count(*) AS n_series, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM s LEFT JOIN b USING (series_id) GROUP BY 1""",
    "curve_shapes": _MEMBERS
    + """, p AS (SELECT *, round(y / 2) * 2 AS p FROM m WHERE y IS NOT NULL), q AS (SELECT *, abs((y - avg(y) OVER w) - (p - avg(p) OVER w)) AS e FROM p WINDOW w AS (PARTITION BY curve_id)), g AS (SELECT curve_id, axis, avg(e) AS s, CASE WHEN max(y) > min(y) THEN (max(p) - min(p)) / (max(y) - min(y)) END AS r FROM q GROUP BY ALL)
SELECT axis, count(*) AS n_curves, round(median(s), 6) AS median_shape_mae, round(avg(r), 6) AS span_recovery FROM g GROUP BY axis""",
    "curve_decoys": _MEMBERS
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY axis_value, row_id) AS k FROM m), v AS (SELECT 'drop' AS variant, axis_value FROM k WHERE k % 3 <> 0 UNION ALL SELECT 'shift', axis_value + 0.5 FROM m UNION ALL SELECT 'far', 2 * max(axis_value) - min(axis_value) FROM m GROUP BY curve_id)
SELECT variant, count(*) AS n, round(sum(axis_value), 3) AS total FROM v GROUP BY 1""",
    "candidate_points": "SELECT metal_symbol, acid, count(*) AS n FROM (SELECT DISTINCT extractant, metal_symbol FROM dataset), (SELECT unnest([0.1::DOUBLE, 1.0, 3.0]) AS acid) GROUP BY ALL",
    "row_centred": "SELECT metal_symbol, round(avg(c), 6) + 0.0 AS mean, count(*) AS n FROM (SELECT metal_symbol, v - avg(v) OVER (PARTITION BY extractant, condition_id) AS c FROM (SELECT extractant, condition_id, metal_symbol, avg(log_D) AS v FROM dataset WHERE log_D IS NOT NULL AND NOT isnan(log_D) GROUP BY ALL)) GROUP BY 1",
    "one_hot_classes": "SELECT " + ", ".join(f"(metal = '{m}')::INT AS is_{m.lower()}" for m in ("La", "Nd", "Eu", "Lu")) + ", count(*) AS n FROM (SELECT DISTINCT record_id, metal FROM corpus_records) GROUP BY ALL",
    "constant_means": """WITH x AS (SELECT series_id, metal_symbol, CASE WHEN NOT isnan(cond__temperature_C) THEN cond__temperature_C END AS t FROM dataset WHERE series_id IS NOT NULL), m AS (SELECT series_id, metal_symbol, count(*) AS n FROM x GROUP BY ALL), u AS (SELECT series_id, first(metal_symbol ORDER BY n DESC, metal_symbol) AS usual_metal FROM m GROUP BY 1)
SELECT series_id, round(CASE WHEN count(DISTINCT t) <= 1 THEN avg(t) END, 6) AS temperature, any_value(usual_metal) AS usual_metal FROM x JOIN u USING (series_id) GROUP BY series_id""",
    "category_lists": f"SELECT severities, count(*) AS n FROM (SELECT i, array_to_string(list_sort(list(DISTINCT severity)), ';') AS severities FROM (SELECT DISTINCT canonical_measurement_id AS i, unnest({_FLAGS}) AS flag FROM dataset_all_metals) JOIN flag_catalog USING (flag) GROUP BY i) GROUP BY 1",
    "calibration_bins": _PANEL + "SELECT CAST(least(floor(arm_flat / 10), 6) AS INT) AS bin, count(*) AS n, round(avg(arm_flat), 6) AS said, round(avg(y), 6) AS seen, round(regr_slope(y, arm_flat), 6) AS slope FROM panel GROUP BY 1",
    "namespaced_union": "WITH u AS (SELECT 'core' AS side, 'core:' || row_id AS id, CASE WHEN NOT isnan(log_D) THEN log_D END AS y FROM dataset UNION ALL SELECT DISTINCT 'aux', 'aux:' || record_id, CASE WHEN NOT isnan(log_d) THEN log_d END FROM corpus_records) SELECT side, count(*) AS n, count(DISTINCT id) AS n_ids, count(y) AS n_targets FROM u GROUP BY 1",
    "provenance_ledger": "SELECT CASE WHEN measurement_id IS NULL THEN 'none' WHEN measurement_id IN (SELECT canonical_measurement_id FROM dataset_all_metals) THEN 'resolved' ELSE 'dangling' END AS state, count(*) AS n FROM documents GROUP BY 1",
    "seed_arm_summary": _PANEL + "SELECT arm, seed, count(*) AS n, round(avg(abs(p - y)), 5) AS mae, round(sqrt(avg((p - y) * (p - y))), 5) AS rmse, round(avg(p - y), 5) AS bias FROM long GROUP BY ALL",
}
