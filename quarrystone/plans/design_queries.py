"""Folds, masks, audits, curves, windows, rankings, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions.clean import doi_list, in_range, label_key, number_or_null, split_role, squeeze
from quarrystone.functions.keys import hash_order
from quarrystone.operators import cohort as C
from quarrystone.operators import curves as V
from quarrystone.operators import folds as P
from quarrystone.operators import ranking as R
from quarrystone.plans.metric_queries import rounded
from quarrystone.sources.tables import table

SELF = "10.99000/archive.self"


def _rows(spark, d):
    """dataset rows with the first publication they cite and their fold by extractant."""
    t = table(spark, d, "dataset", "row_id", "extractant", "chemotype", "metal_symbol", "doi", "series_id", "condition_id", "log_D")
    t = t.select("row_id", "extractant", label_key(F.col("chemotype")).alias("chemotype"), "metal_symbol", "series_id", "condition_id", number_or_null(F.col("log_D")).alias("y"), F.try_element_at(doi_list(F.col("doi"), (SELF,)), F.lit(1)).alias("publication"))
    return t.join(P.grouped_folds(t, "extractant", 5, 104729), "extractant")


def _rows_all(spark, d):
    """dataset rows with all publications they cite and their fold by extractant."""
    t = table(spark, d, "dataset", "row_id", "extractant", "chemotype", "doi", "series_id")
    t = t.select("row_id", "extractant", label_key(F.col("chemotype")).alias("chemotype"), "series_id", doi_list(F.col("doi"), (SELF,)).alias("publications"))
    return t.join(P.grouped_folds(t, "extractant", 5, 104729), "extractant")


def group_kfold(spark, d):
    return P.grouped_folds(table(spark, d, "dataset", "extractant"), "extractant", 5, 104729)


def inner_folds(spark, d):
    """Folds re-dealt by chemotype inside the training side of each outer fold."""
    out = None
    for k in range(5):
        train = _rows(spark, d).where(F.col("fold") != k)
        part = P.grouped_folds(train, "chemotype", 3, 104729 * 31 + k * 7919 + 17).withColumn("outer_fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def loo_remainder_folds(spark, d):
    return P.remainder_folds(_rows(spark, d), "publication", 40)


def publication_mask(spark, d):
    kept = P.publication_mask(_rows(spark, d).select("row_id", "fold", "publication"), "row_id", "fold", "publication", 5)
    return kept.groupBy("held_fold").agg(F.count("*").alias("n_train"), F.min("row_id").alias("first_row"))


def loo_remainder_folds_all(spark, d):
    """As loo_remainder_folds, a row under every publication it cites."""
    return P.remainder_folds(_rows_all(spark, d).select(F.explode_outer("publications").alias("publication")), "publication", 40)


def publication_mask_all(spark, d):
    """As publication_mask, by every publication a row cites."""
    kept = P.mask_of_all(_rows_all(spark, d).select("row_id", "fold", "publications"), "row_id", "fold", "publications", 5)
    return kept.groupBy("held_fold").agg(F.count("*").alias("n_train"), F.min("row_id").alias("first_row"))


def fold_leak_audit_all(spark, d):
    """As fold_leak_audit, by every publication a row cites."""
    rows = _rows_all(spark, d)
    return P.leak_audit(rows, "fold", ["extractant", "chemotype", "series_id"]).unionByName(P.leak_audit_of_all(rows, "row_id", "fold", "publications", "publication"))


def pool_survival_all(spark, d):
    """As pool_survival, by every publication a row cites."""
    rows = m = _rows_all(spark, d)
    for name, c in (("_c", "chemotype"), ("_s", "series_id")):
        m = m.join(rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.collect_set("fold").alias(name)), c, "left")
    m = m.join(P.sharing(rows, "row_id", "fold", "publications").groupBy("row_id").agg(F.collect_set("other_fold").alias("_p")), "row_id", "left")
    m = m.select(F.col("fold").alias("_own"), F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("fold"), "_c", "_s", "_p").where("_own <> fold")
    same = {n: F.coalesce(F.array_contains(f"_{n}", F.col("fold")), F.lit(False)) for n in "cps"}
    return m.groupBy("fold").agg(F.count("*").alias("n_pool"), F.count_if(same["c"]).alias("n_same_chemotype"), F.count_if(same["p"]).alias("n_same_publication"), F.count_if(same["s"]).alias("n_same_series"), F.count_if(~(same["c"] | same["p"] | same["s"])).alias("n_headline"))


def size_matched_control(spark, d):
    rows = _rows(spark, d).select("row_id", "fold")
    sizes = rows.groupBy("fold").agg(F.floor(F.count("*") / 4).alias("n_drop"))
    return P.size_matched(rows, sizes, ["fold"], "row_id", 7).select("fold", "row_id")


def hash_samples(spark, d):
    return P.hash_sample(_rows(spark, d).select("extractant", "row_id"), 3, 11, "row_id", ["extractant"])


def permutation_control(spark, d):
    rows = _rows(spark, d).where("y IS NOT NULL").select("row_id", "metal_symbol", "y")
    return P.permuted(rows, "row_id", "y", 5, ["metal_symbol"]).select("row_id", "metal_symbol", "y")


def fold_leak_audit(spark, d):
    return P.leak_audit(_rows(spark, d), "fold", ["extractant", "chemotype", "publication", "series_id"])


def pool_survival(spark, d):
    """Per fold: rows outside it that share no structure, chemotype, publication or series with it, by named policy."""
    from functools import reduce

    rows = _rows(spark, d).select("row_id", "extractant", "chemotype", "publication", "series_id", "fold")
    parts = []
    for k in range(5):
        m = P.relation_masks(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), {"same_chemotype": "chemotype", "same_publication": "publication", "same_series": "series_id"})
        headline = ~(F.col("same_chemotype") | F.col("same_publication") | F.col("same_series"))
        parts.append(m.agg(F.lit(k).alias("fold"), F.count("*").alias("n_pool"), F.count_if("same_chemotype").alias("n_same_chemotype"), F.count_if("same_publication").alias("n_same_publication"), F.count_if("same_series").alias("n_same_series"), F.count_if(headline).alias("n_headline")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def frame_fingerprint(spark, d):
    return P.fingerprint(table(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


def _axes():
    return {"acid": in_range(F.col("cond__acid_concentration_M"), 0.0, 50.0), "extractant": in_range(F.col("cond__extractant_concentration_M"), 0.0, 50.0), "temperature": in_range(F.col("cond__temperature_C"), -100.0, 400.0)}


def _curves(spark, d):
    t = table(spark, d, "dataset", "row_id", "series_id", "log_D", "cond__acid_concentration_M", "cond__extractant_concentration_M", "cond__temperature_C").withColumn("y", number_or_null(F.col("log_D")))
    return t, V.curve_members(t, "series_id", "row_id", _axes())


def curve_membership(spark, d):
    return _curves(spark, d)[1].groupBy("axis").agg(F.count_distinct("curve_id").alias("n_curves"), F.count_distinct("row_id").alias("n_rows"), F.max("n_points").alias("most_points"))


def curve_stats(spark, d):
    t, m = _curves(spark, d)
    return rounded(V.curve_stats(m, t, "row_id", "y").select("axis", "n_rows", "slope", "r2", "low", "high", "trend"), 8)


def primary_curves(spark, d):
    return V.primary_curve(_curves(spark, d)[1]).select("row_id", "axis", "size")


def curve_position(spark, d):
    return rounded(V.window_position(_curves(spark, d)[1]).drop("curve_id").groupBy("row_id", "axis_value").agg(F.max("value_rank").alias("value_rank"), F.max("position").alias("position"), F.max("gap_below").alias("gap_below"), F.max("gap_above").alias("gap_above")), 6)


def curve_closure(spark, d):
    t = table(spark, d, "dataset", "row_id", "split").select("row_id", split_role(F.col("split")).alias("side"))
    return V.closure(_curves(spark, d)[1], t, "row_id", "side").groupBy("n_sides").agg(F.count("*").alias("n_curves"), F.sum("n").alias("n_rows"))


def training_pairs(spark, d):
    return V.training_pairs(_curves(spark, d)[1]).groupBy("kind").agg(F.count("*").alias("n"), F.min("a").alias("least_a"), F.max("b").alias("greatest_b"))


def transitive_scores(spark, d):
    line = table(spark, d, "dataset", "extractant", "metal_symbol", "metal_z", "log_D").where("log_D IS NOT NULL AND NOT isnan(log_D)").groupBy("extractant", "metal_symbol", "metal_z").agg(F.avg("log_D").alias("v"))
    a, b = line.alias("a"), line.alias("b")
    pairs = a.join(b, (F.col("a.extractant") == F.col("b.extractant")) & (F.col("a.metal_z") < F.col("b.metal_z"))).select(F.col("a.extractant").alias("cell"), F.col("a.metal_symbol").alias("m1"), F.col("b.metal_symbol").alias("m2"), (F.col("a.v") - F.col("b.v")).alias("p"))
    return rounded(V.transitive_scores(pairs, "cell", "m1", "m2", "p"), 5)


def _scored(spark, d):
    t = table(spark, d, "dataset", "row_id", "extractant", "metal_symbol", "metal_z", "log_D").where("log_D IS NOT NULL AND NOT isnan(log_D)")
    return t.withColumn("score", F.round(F.col("log_D") / 2).cast("double") + (F.col("metal_z") % 3))


def lexicographic_rank(spark, d):
    return R.lexicographic(_scored(spark, d), [F.desc("score"), F.desc("log_D"), F.asc("row_id")], ["metal_symbol"]).select("row_id", "metal_symbol", "place")


def topk_ties(spark, d):
    return rounded(R.expected_topk(_scored(spark, d), ["metal_symbol"], "score", F.col("log_D") > 0.5, 20), 6)


def cross_unit_regret(spark, d):
    return rounded(R.expected_top1(_scored(spark, d), ["extractant"], "score", "log_D"), 6)


def coverage_curve(spark, d):
    return rounded(R.coverage_curve(_scored(spark, d), ["metal_symbol"], "score", hash_order(F.lit(3), F.col("row_id")), F.abs(F.col("log_D") - F.col("score")), [0.1, 0.25, 0.5, 1.0]), 6)


def round_robin_order(spark, d):
    return R.round_robin(_scored(spark, d), "extractant", F.desc("score"), "row_id").select("row_id", "extractant", "turn")


def budget_prefix(spark, d):
    g = _scored(spark, d).groupBy("metal_symbol", "extractant").agg(F.count("*").alias("n"), F.avg("score").alias("s"))
    return R.budget_prefix(g, ["metal_symbol"], [F.desc("n"), F.asc("extractant")], "n", 100).select("metal_symbol", "extractant", "n", "taken")


def seat_allocation(spark, d):
    g = _scored(spark, d).groupBy("metal_symbol", "extractant").agg(F.count("*").alias("n"))
    return R.largest_remainder(g, ["metal_symbol"], "extractant", "n", 25).select("metal_symbol", "extractant", "seats")


def cumulative_shares(spark, d):
    return rounded(R.cumulative_share(table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").withColumn("v", F.abs("s_acctbal")), ["s_nationkey"], "v", "s_suppkey").select("s_suppkey", "share"), 6)


def percent_ranks(spark, d):
    return rounded(R.percent_rank_average(_scored(spark, d), ["metal_symbol"], "score").select("row_id", "pct"), 6)


def weighted_medians(spark, d):
    return R.weighted_median(_scored(spark, d), ["extractant"], "log_D", "metal_z")


def lag_differences(spark, d):
    t = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.array_sort(F.collect_list("value").over(w.rowsBetween(-2, 2)))
    n = F.size(near)
    middle = (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2
    return rounded(t.select("event_id", (F.col("value") - F.lag("value").over(w)).alias("step"), F.when(n >= 3, middle).alias("rolling_median"), F.avg("value").over(Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-86400, 0)).alias("day_mean"), (F.row_number().over(w) - 1).alias("ordinal")), 6)


def standardised_by_unit(spark, d):
    t = _scored(spark, d)
    w = Window.partitionBy("extractant")
    sd = F.stddev_pop("log_D").over(w)
    return rounded(t.select("row_id", F.when(sd > 0, (F.col("log_D") - F.avg("log_D").over(w)) / sd).otherwise(0.0).alias("z"), F.count("*").over(w).alias("n"), F.dense_rank().over(w.orderBy("log_D")).alias("dense"), F.ntile(10).over(w.orderBy("log_D", "row_id")).alias("decile")), 5)


def set_operations(spark, d):
    a = table(spark, d, "dataset", "extractant").distinct()
    b = table(spark, d, "ligand_fingerprint", "extractant").where("extractant IS NOT NULL")
    c = table(spark, d, "d5_error_anatomy", "extractant").where("max_train_tanimoto > 0.9")
    named = lambda df, n: df.agg(F.lit(n).alias("operation"), F.count("*").alias("n"))
    return named(a.intersect(c), "intersect").union(named(b.exceptAll(a), "except_all")).union(named(a.union(c), "union_all")).union(named(a.union(c).distinct(), "union")).union(named(a.subtract(b), "subtract"))


def long_to_wide_and_back(spark, d):
    t = table(spark, d, "corpus_records", "record_id", "acid_nominal_M", "ligand_M", "temperature_C").dropDuplicates(["record_id"])
    return t.unpivot(["record_id"], ["acid_nominal_M", "ligand_M", "temperature_C"], "field", "value").where("value IS NOT NULL AND NOT isnan(value)").groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def exploded_flags(spark, d):
    t = table(spark, d, "dataset_all_metals", "canonical_measurement_id", "flags").dropDuplicates(["canonical_measurement_id"])
    cat = table(spark, d, "flag_catalog")
    return t.select("canonical_measurement_id", F.explode("flags").alias("f")).select("canonical_measurement_id", F.lower(squeeze(F.col("f"))).alias("flag")).distinct().join(cat, "flag", "left").groupBy("severity", "flag").agg(F.count("*").alias("n"))


def asof_events(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", "value").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return C.as_of_join(left, right, "user_id", "ts", ["value"]).select("event_id", F.round("value", 6).alias("value"))


def range_overlaps(spark, d):
    part = table(spark, d, "part", "p_brand", "p_partkey", "p_retailprice")
    bands = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m")).select("p_brand", (F.col("m") - 100).alias("lo"), (F.col("m") + 100).alias("hi"))
    return C.range_join(part, bands, "p_brand", "p_retailprice", "lo", "hi", 50.0).groupBy("p_brand").agg(F.count("*").alias("n"))


def null_safe_join(spark, d):
    a = table(spark, d, "leakage_publication_components", "publication", "reference_year")
    j = a.alias("a").join(a.alias("b"), F.col("a.reference_year").eqNullSafe(F.col("b.reference_year")) & (F.col("a.publication") < F.col("b.publication")))
    return j.groupBy("a.reference_year").agg(F.count("*").alias("n_pairs"))


QUERIES = {
    f.__name__: f
    for f in (
        loo_remainder_folds_all, publication_mask_all, fold_leak_audit_all, pool_survival_all,
        group_kfold, inner_folds, loo_remainder_folds, publication_mask, size_matched_control, hash_samples, permutation_control, fold_leak_audit, pool_survival, frame_fingerprint, curve_membership, curve_stats, primary_curves,
        curve_position, curve_closure, training_pairs, transitive_scores, lexicographic_rank, topk_ties, cross_unit_regret, coverage_curve, round_robin_order, budget_prefix, seat_allocation, cumulative_shares, percent_ranks,
        weighted_medians, lag_differences, standardised_by_unit, set_operations, long_to_wide_and_back, exploded_flags, asof_events, range_overlaps, null_safe_join,
    )
}

from quarrystone.plans.curation_queries import _DOIS, _FLAGS, _key_sql  # noqa: E402

_CHEM = "CASE WHEN chemotype IS NOT NULL AND lower(trim(chemotype)) NOT IN ('', '-', '- -', 'n/a', '?', 'none', 'nan') THEN regexp_replace(lower(chemotype), '[^a-z0-9]+', '', 'g') END"
_FOLDS = "SELECT extractant, CAST((row_number() OVER (ORDER BY md5('104729:' || extractant)) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT extractant FROM dataset)"
_ROWS = f"""WITH f AS ({_FOLDS}), r AS (SELECT row_id, extractant, {_CHEM} AS chemotype, metal_symbol, series_id, CASE WHEN NOT isnan(log_D) THEN log_D END AS y, list_sort({_DOIS})[1] AS publication, fold FROM dataset JOIN f USING (extractant))
"""
_ROWS_ALL = f"""WITH f AS ({_FOLDS}), r AS (SELECT row_id, extractant, {_CHEM} AS chemotype, series_id, {_DOIS} AS publications, fold FROM dataset JOIN f USING (extractant)), pub AS (SELECT row_id, fold, unnest(publications) AS publication FROM r),
sh AS (SELECT DISTINCT a.row_id, a.fold, b.fold AS other FROM pub a JOIN (SELECT DISTINCT fold, publication FROM pub) b USING (publication))
"""


def _clip(c, lo, hi):
    return f"CASE WHEN NOT isnan({c}) AND {c} BETWEEN {lo} AND {hi} THEN {c} END"


_AX = {"acid": _clip("cond__acid_concentration_M", 0, 50), "extractant": _clip("cond__extractant_concentration_M", 0, 50), "temperature": _clip("cond__temperature_C", -100, 400)}
_MEMBERS = "WITH base AS (SELECT row_id, series_id, CASE WHEN NOT isnan(log_D) THEN log_D END AS y, " + ", ".join(f"{v} AS {k}" for k, v in _AX.items()) + " FROM dataset WHERE series_id IS NOT NULL), st AS (" + " UNION ALL ".join(
    f"SELECT row_id, series_id, y, '{k}' AS axis, {k} AS axis_value, concat_ws('|', {', '.join(_key_sql(o, 6) for o in _AX if o != k)}) AS held FROM base" for k in _AX
) + """), cv AS (SELECT series_id, axis, held, count(DISTINCT axis_value) AS n_points FROM st WHERE axis_value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT axis_value) >= 3),
m AS (SELECT substr(sha1(concat_ws('|', series_id, axis, held)), 1, 16) AS curve_id, row_id, y, axis, axis_value, n_points FROM st JOIN cv USING (series_id, axis, held) WHERE axis_value IS NOT NULL)
"""
_SCORED = "WITH s AS (SELECT row_id, extractant, metal_symbol, metal_z, log_D, round(log_D / 2) + metal_z % 3 AS score FROM dataset WHERE NOT isnan(log_D))\n"
SQL = {
    "group_kfold": _FOLDS,
    "inner_folds": _ROWS + " UNION ALL ".join(f"SELECT chemotype, CAST((row_number() OVER (ORDER BY md5('{104729 * 31 + k * 7919 + 17}:' || coalesce(chemotype, 'NA'))) - 1) % 3 AS INT) AS fold, {k} AS outer_fold FROM (SELECT DISTINCT chemotype FROM r WHERE fold <> {k})" for k in range(5)),
    "loo_remainder_folds": _ROWS + "SELECT publication, count(*) AS n, CASE WHEN count(*) >= 40 THEN publication ELSE 'REMAINDER' END AS fold FROM r GROUP BY publication",
    "publication_mask": _ROWS + "SELECT h.held_fold, count(*) AS n_train, min(row_id) AS first_row FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS held_fold) h WHERE r.fold <> h.held_fold AND NOT EXISTS (SELECT 1 FROM r x WHERE x.fold = h.held_fold AND x.publication = r.publication) GROUP BY 1",
    "loo_remainder_folds_all": _ROWS_ALL + "SELECT publication, count(*) AS n, CASE WHEN count(*) >= 40 THEN publication ELSE 'REMAINDER' END AS fold FROM r LEFT JOIN pub USING (row_id) GROUP BY publication",
    "publication_mask_all": _ROWS_ALL + "SELECT h.held_fold, count(*) AS n_train, min(r.row_id) AS first_row FROM r CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS held_fold) h WHERE r.fold <> h.held_fold AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.row_id = r.row_id AND sh.other = h.held_fold) GROUP BY 1",
    "fold_leak_audit_all": _ROWS_ALL + "SELECT column_name, count(*) FILTER (WHERE folds > 1) AS n_leaking, CAST(coalesce(sum(n) FILTER (WHERE folds > 1), 0) AS BIGINT) AS n_rows FROM (SELECT column_name, v, count(DISTINCT fold) AS folds, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v, fold FROM r" for c in ("extractant", "chemotype", "series_id")) + ") WHERE v IS NOT NULL GROUP BY ALL) GROUP BY 1 UNION ALL SELECT 'publication', (SELECT count(*) FROM (SELECT publication FROM pub GROUP BY 1 HAVING count(DISTINCT fold) > 1)), (SELECT count(DISTINCT row_id) FROM sh WHERE other <> fold)",
    "pool_survival_all": _ROWS_ALL
    + """, m AS (SELECT h.k AS fold, EXISTS (SELECT 1 FROM r x WHERE x.fold = h.k AND x.chemotype = r.chemotype) AS c, EXISTS (SELECT 1 FROM sh WHERE sh.other = h.k AND sh.row_id = r.row_id) AS p, EXISTS (SELECT 1 FROM r x WHERE x.fold = h.k AND x.series_id = r.series_id) AS s
FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) h WHERE r.fold <> h.k)
SELECT fold, count(*) AS n_pool, count(*) FILTER (WHERE c) AS n_same_chemotype, count(*) FILTER (WHERE p) AS n_same_publication, count(*) FILTER (WHERE s) AS n_same_series, count(*) FILTER (WHERE NOT (c OR p OR s)) AS n_headline FROM m GROUP BY fold""",
    "size_matched_control": _ROWS + "SELECT fold, row_id FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5('7:' || fold || ':' || row_id)) - 1 AS k, floor(count(*) OVER (PARTITION BY fold) / 4) AS n_drop FROM r) WHERE k >= n_drop",
    "hash_samples": "SELECT extractant, row_id FROM (SELECT extractant, row_id, row_number() OVER (PARTITION BY extractant ORDER BY md5('11:' || row_id), row_id) AS k FROM dataset) WHERE k <= 3",
    "permutation_control": """WITH r AS (SELECT row_id, metal_symbol, log_D AS y FROM dataset WHERE NOT isnan(log_D)), a AS (SELECT *, row_number() OVER (PARTITION BY metal_symbol ORDER BY md5(row_id)) AS k FROM r),
b AS (SELECT metal_symbol, y, row_number() OVER (PARTITION BY metal_symbol ORDER BY md5('5:' || row_id)) AS k FROM r) SELECT a.row_id, a.metal_symbol, b.y FROM a JOIN b USING (metal_symbol, k)""",
    "fold_leak_audit": _ROWS + "SELECT column_name, count(*) FILTER (WHERE folds > 1) AS n_leaking, CAST(coalesce(sum(n) FILTER (WHERE folds > 1), 0) AS BIGINT) AS n_rows FROM (SELECT column_name, v, count(DISTINCT fold) AS folds, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v, fold FROM r" for c in ("extractant", "chemotype", "publication", "series_id")) + ") WHERE v IS NOT NULL GROUP BY ALL) GROUP BY 1",
    "pool_survival": _ROWS
    + """, m AS (SELECT h.k AS fold, EXISTS (SELECT 1 FROM r x WHERE x.fold = h.k AND x.chemotype = r.chemotype) AS c, EXISTS (SELECT 1 FROM r x WHERE x.fold = h.k AND x.publication = r.publication) AS p, EXISTS (SELECT 1 FROM r x WHERE x.fold = h.k AND x.series_id = r.series_id) AS s
FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) h WHERE r.fold <> h.k)
SELECT fold, count(*) AS n_pool, count(*) FILTER (WHERE c) AS n_same_chemotype, count(*) FILTER (WHERE p) AS n_same_publication, count(*) FILTER (WHERE s) AS n_same_series, count(*) FILTER (WHERE NOT (c OR p OR s)) AS n_headline FROM m GROUP BY fold""",
    "frame_fingerprint": "SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), coalesce(n_name, 'NA'), coalesce(CAST(n_nationkey AS VARCHAR), 'NA'), coalesce(CAST(n_regionkey AS VARCHAR), 'NA'))), 1, 12) AS HUGEINT)) AS VARCHAR) AS digest FROM nation",
    "curve_membership": _MEMBERS + "SELECT axis, count(DISTINCT curve_id) AS n_curves, count(DISTINCT row_id) AS n_rows, max(n_points) AS most_points FROM m GROUP BY axis",
    "curve_stats": _MEMBERS
    + """, p AS (SELECT curve_id, axis_value, avg(y) AS a FROM m WHERE y IS NOT NULL GROUP BY ALL), t AS (SELECT curve_id, min(g) AS lo, max(g) AS hi FROM (SELECT curve_id, a - lag(a) OVER (PARTITION BY curve_id ORDER BY axis_value) AS g FROM p) GROUP BY 1)
SELECT axis, count(*) AS n_rows, round(regr_slope(y, axis_value), 8) AS slope, round(regr_r2(y, axis_value), 8) AS r2, round(min(axis_value), 8) AS low, round(max(axis_value), 8) AS high, CASE WHEN any_value(lo) IS NULL THEN NULL WHEN any_value(lo) >= -1e-9 THEN 'up' WHEN any_value(hi) <= 1e-9 THEN 'down' ELSE 'neither' END AS trend
FROM m LEFT JOIN t USING (curve_id) WHERE y IS NOT NULL GROUP BY curve_id, axis""",
    "primary_curves": _MEMBERS + "SELECT row_id, axis, size FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY size DESC, curve_id) AS k FROM (SELECT *, count(*) OVER (PARTITION BY curve_id) AS size FROM m)) WHERE k = 1",
    "curve_position": _MEMBERS
    + """, v AS (SELECT DISTINCT curve_id, axis_value FROM m), w AS (SELECT curve_id, axis_value, CAST(row_number() OVER o AS INT) AS value_rank, CASE WHEN max(axis_value) OVER c > min(axis_value) OVER c THEN (axis_value - min(axis_value) OVER c) / (max(axis_value) OVER c - min(axis_value) OVER c) END AS position,
axis_value - lag(axis_value) OVER o AS below, lead(axis_value) OVER o - axis_value AS above FROM v WINDOW o AS (PARTITION BY curve_id ORDER BY axis_value), c AS (PARTITION BY curve_id))
SELECT row_id, round(axis_value, 6) AS axis_value, max(value_rank) AS value_rank, round(max(position), 6) AS position, round(max(coalesce(below, above)), 6) AS gap_below, round(max(coalesce(above, below)), 6) AS gap_above FROM m JOIN w USING (curve_id, axis_value) GROUP BY row_id, m.axis_value""",
    "curve_closure": _MEMBERS + ", s AS (SELECT row_id, CASE WHEN lower(trim(split)) LIKE 'train%' THEN 'train' WHEN lower(trim(split)) LIKE 'val%' THEN 'validation' WHEN lower(trim(split)) LIKE 'test%' THEN 'test' END AS side FROM dataset) SELECT n_sides, count(*) AS n_curves, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT curve_id, count(DISTINCT side) AS n_sides, count(*) AS n FROM m JOIN s USING (row_id) GROUP BY 1) WHERE n_sides > 1 GROUP BY 1",
    "training_pairs": _MEMBERS
    + """, p AS (SELECT curve_id, axis_value, min(row_id) AS row_id FROM m GROUP BY ALL), q AS (SELECT 'adjacent' AS kind, row_id AS a, lead(row_id) OVER (PARTITION BY curve_id ORDER BY axis_value) AS b FROM p UNION ALL SELECT 'endpoint', arg_min(row_id, axis_value), arg_max(row_id, axis_value) FROM p GROUP BY curve_id)
SELECT kind, count(*) AS n, min(a) AS least_a, max(b) AS greatest_b FROM q WHERE b IS NOT NULL AND a <> b GROUP BY kind""",
    "transitive_scores": """WITH c AS (SELECT extractant AS cell, metal_symbol AS m, metal_z AS z, avg(log_D) AS v FROM dataset WHERE NOT isnan(log_D) GROUP BY ALL), p AS (SELECT a.cell, a.m AS m1, b.m AS m2, a.v - b.v AS p FROM c a JOIN c b ON a.cell = b.cell AND a.z < b.z)
SELECT cell, item, round(sum(p) / (count(*) + 1), 5) AS score FROM (SELECT cell, m1 AS item, p FROM p UNION ALL SELECT cell, m2, -p FROM p) GROUP BY ALL""",
    "lexicographic_rank": _SCORED + "SELECT row_id, metal_symbol, CAST(row_number() OVER (PARTITION BY metal_symbol ORDER BY score DESC, log_D DESC, row_id) AS INT) AS place FROM s",
    "topk_ties": _SCORED + """, t AS (SELECT metal_symbol, score, count(*) AS m, count(*) FILTER (WHERE log_D > 0.5) AS g FROM s GROUP BY ALL), b AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY metal_symbol ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT metal_symbol, round(sum(g * greatest(0, least(m, 20 - before)) / m), 6) AS expected_good, CAST(sum(greatest(0, least(m, 20 - before))) AS BIGINT) AS taken FROM b GROUP BY 1""",
    "cross_unit_regret": _SCORED + "SELECT extractant, round(avg(log_D) FILTER (WHERE score = b), 6) AS chosen, max(log_D) AS best, round(avg(log_D), 6) AS mean, round(max(log_D) - avg(log_D) FILTER (WHERE score = b), 6) AS regret, round(max(log_D) - avg(log_D), 6) AS random_regret FROM (SELECT *, max(score) OVER (PARTITION BY extractant) AS b FROM s) GROUP BY 1",
    "coverage_curve": _SCORED + "SELECT metal_symbol, share, count(*) AS n, round(avg(abs(log_D - score)), 6) AS mean_error FROM (SELECT *, row_number() OVER (PARTITION BY metal_symbol ORDER BY score DESC, md5('3:' || row_id)) AS r, count(*) OVER (PARTITION BY metal_symbol) AS n FROM s), (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 1.0]) AS share) WHERE r <= ceil(share * n) GROUP BY ALL",
    "round_robin_order": _SCORED + "SELECT row_id, extractant, CAST(row_number() OVER (PARTITION BY extractant ORDER BY score DESC, row_id) AS INT) AS turn FROM s",
    "budget_prefix": _SCORED + "SELECT metal_symbol, extractant, n, CAST(least(n, 100 - b) AS BIGINT) AS taken FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY metal_symbol ORDER BY n DESC, extractant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT metal_symbol, extractant, count(*) AS n FROM s GROUP BY ALL)) WHERE b < 100",
    "seat_allocation": _SCORED + """, g AS (SELECT metal_symbol, extractant, 25 * n / sum(n) OVER (PARTITION BY metal_symbol) AS q FROM (SELECT metal_symbol, extractant, count(*) AS n FROM s GROUP BY ALL)), h AS (SELECT *, floor(q) AS f, 25 - sum(floor(q)) OVER (PARTITION BY metal_symbol) AS l, row_number() OVER (PARTITION BY metal_symbol ORDER BY round(q - floor(q), 9) DESC, extractant) AS r FROM g)
SELECT metal_symbol, extractant, CAST(f + CASE WHEN r <= l THEN 1 ELSE 0 END AS BIGINT) AS seats FROM h""",
    "cumulative_shares": "SELECT s_suppkey, round(sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal) DESC, s_suppkey ROWS UNBOUNDED PRECEDING) / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 6) AS share FROM supplier",
    "percent_ranks": _SCORED + "SELECT row_id, round((rank() OVER (PARTITION BY metal_symbol ORDER BY score) + (count(*) OVER (PARTITION BY metal_symbol, score) - 1) / 2) / count(*) OVER (PARTITION BY metal_symbol), 6) AS pct FROM s",
    "weighted_medians": _SCORED + "SELECT extractant, min(log_D) AS weighted_median FROM (SELECT extractant, log_D, sum(metal_z) OVER (PARTITION BY extractant ORDER BY log_D RANGE UNBOUNDED PRECEDING) AS r, sum(metal_z) OVER (PARTITION BY extractant) AS a FROM s) WHERE r >= 0.5 * a GROUP BY 1",
    "lag_differences": "SELECT event_id, round(value - lag(value) OVER w, 6) AS step, CASE WHEN count(value) OVER c >= 3 THEN round(median(value) OVER c, 6) END AS rolling_median, round(avg(value) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 6) AS day_mean, CAST(row_number() OVER w - 1 AS INT) AS ordinal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), c AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "standardised_by_unit": _SCORED + "SELECT row_id, round(CASE WHEN stddev_pop(log_D) OVER w > 0 THEN (log_D - avg(log_D) OVER w) / stddev_pop(log_D) OVER w ELSE 0.0 END, 5) AS z, count(*) OVER w AS n, CAST(dense_rank() OVER (PARTITION BY extractant ORDER BY log_D) AS INT) AS dense, CAST(ntile(10) OVER (PARTITION BY extractant ORDER BY log_D, row_id) AS INT) AS decile FROM s WINDOW w AS (PARTITION BY extractant)",
    "set_operations": """WITH a AS (SELECT DISTINCT extractant FROM dataset), b AS (SELECT extractant FROM ligand_fingerprint WHERE extractant IS NOT NULL), c AS (SELECT extractant FROM d5_error_anatomy WHERE max_train_tanimoto > 0.9)
SELECT 'intersect' AS operation, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM c) UNION ALL SELECT 'except_all', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM c)
UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM c) UNION ALL SELECT 'subtract', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "long_to_wide_and_back": "SELECT field, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT unnest(['acid_nominal_M', 'ligand_M', 'temperature_C']) AS field, unnest([acid_nominal_M, ligand_M, temperature_C]) AS v FROM (SELECT DISTINCT record_id, acid_nominal_M, ligand_M, temperature_C FROM corpus_records)) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1",
    "exploded_flags": f"SELECT severity, flag, count(*) AS n FROM (SELECT DISTINCT canonical_measurement_id, unnest({_FLAGS}) AS flag FROM dataset_all_metals) LEFT JOIN flag_catalog USING (flag) GROUP BY ALL",
    "asof_events": "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT event_id, round(value, 6) AS value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "range_overlaps": "WITH b AS (SELECT p_brand, avg(p_retailprice) - 100 AS lo, avg(p_retailprice) + 100 AS hi FROM part GROUP BY 1) SELECT p_brand, count(*) AS n FROM part JOIN b USING (p_brand) WHERE p_retailprice BETWEEN lo AND hi GROUP BY 1",
    "null_safe_join": "SELECT a.reference_year, count(*) AS n_pairs FROM leakage_publication_components a JOIN leakage_publication_components b ON a.reference_year IS NOT DISTINCT FROM b.reference_year AND a.publication < b.publication GROUP BY 1",
}
