"""Resampling, similarity, selection, audits and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions.clean import doi_list, in_range, label_key, number_or_null
from quarrystone.functions.keys import draw, hash_order
from quarrystone.operators import cohort as C
from quarrystone.operators import resample as B
from quarrystone.operators import selection as Q
from quarrystone.operators import similarity as S
from quarrystone.operators.graph import connected_components
from quarrystone.plans.metric_queries import panel, rounded
from quarrystone.sources.tables import cut, table

SELF = "10.99000/archive.self"


def _delta():
    """How much better the flat arm is than the net arm on a row."""
    return F.abs(F.col("y") - F.col("arm_net")) - F.abs(F.col("y") - F.col("arm_flat"))


def _blocks(spark, d):
    return B.block_sums(panel(spark, d), "block", _delta())


def cluster_bootstrap_ci(spark, d):
    return rounded(B.bootstrap_interval(_blocks(spark, d), 200, 13), 7)


def bootstrap_by_unit(spark, d):
    return rounded(B.bootstrap_interval(B.block_sums(panel(spark, d), "unit", _delta()), 100, 29), 7)


def jackknife_influence(spark, d):
    return rounded(B.jackknife(_blocks(spark, d)), 7)


def bca_interval(spark, d):
    low, high = B.bca_interval(_blocks(spark, d), 200, 13)
    return spark.createDataFrame([(float(low), float(high))], "low double, high double")


def cluster_robust_se(spark, d):
    return rounded(B.robust_errors(_blocks(spark, d)), 7)


def wild_cluster_p(spark, d):
    return rounded(B.wild_cluster_p(_blocks(spark, d), 199, 31), 6)


def bayes_bootstrap(spark, d):
    m = B.bayes_means(_blocks(spark, d), 200, 17)
    return rounded(m.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.avg((F.abs("mean") < 0.5).cast("double")).alias("p_rope")), 7)


def permutation_null(spark, d):
    return rounded(B.sign_flip_null(_blocks(spark, d), 199, 5), 7)


def bh_adjust(spark, d):
    p = panel(spark, d).groupBy("seed", "block").agg(F.round(F.abs(F.avg(_delta())) / 10 % 1, 6).alias("p"))
    return rounded(B.benjamini_hochberg(p, ["seed"], "p", "block"), 6)


def noise_floor(spark, d):
    t = table(spark, d, "dataset", "extractant", "condition_id", "metal_symbol", "log_D").withColumn("y", number_or_null(F.col("log_D")))
    return rounded(B.pooled_sd(t, ["extractant", "condition_id", "metal_symbol"], "y"), 6)


def seed_sign_agreement(spark, d):
    per = panel(spark, d).groupBy("seed").agg(F.avg(_delta()).alias("delta"))
    return rounded(per.agg(F.count("*").alias("n_seeds"), F.count_if(F.col("delta") > 0).alias("n_positive"), F.min("delta").alias("least"), F.max("delta").alias("most")), 6)


def nearest_neighbour_tanimoto(spark, d):
    """For every fiftieth structure: its most similar other structure and the band of that similarity."""
    v = _binary(spark, d)
    near = S.block_search(v, "structure_id", "fingerprint", F.col("structure_id") % 50 == 0, "tanimoto", 1)
    band = C.first_label([(F.col("similarity") <= 0.4, "far"), (F.col("similarity") <= 0.6, "mid")], "near")
    return near.select("query", "other", F.round("similarity", 6).alias("similarity"), band.alias("band"))


def _binary(spark, d):
    v = table(spark, d, "ligand_fingerprint", "structure_id", "extractant", "fingerprint")
    return v.where((F.size("fingerprint") == 256) & ~F.exists("fingerprint", lambda x: x.isNull() | F.isnan(x)) & F.exists("fingerprint", lambda x: x > 0))


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return S.block_search(e, "vec_id", "embedding", F.col("vec_id") % 50 == 0, "cosine", 5).select("query", "other", F.round("similarity", 5).alias("similarity"), "place")


def neighbour_labels(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    near = S.block_search(e, "vec_id", "embedding", F.col("vec_id") % 50 == 0, "cosine", 5)
    return S.label_links(near, e, "vec_id", "label").select("query", F.concat_ws(";", F.transform("labels", lambda x: x.cast("string"))).alias("labels"))


def similarity_clusters(spark, d):
    """Single-linkage clusters of all usable structures at similarity 0.7: each structure with its cluster."""
    v = _binary(spark, d)
    links = S.similarity_edges(v, "structure_id", "fingerprint", 0.7)
    both = links.union(v.select(F.col("structure_id").alias("a"), F.col("structure_id").alias("b")))
    return connected_components(both.select(F.col("a").cast("long"), F.col("b").cast("long"))).select(F.col("node").alias("structure_id"), F.col("component").alias("cluster"))


def source_components(spark, d):
    """Components of publications and structures tied by rows."""
    t = table(spark, d, "dataset", "extractant", "doi")
    e = t.select(F.concat(F.lit("e:"), "extractant").alias("a"), F.explode(doi_list(F.col("doi"), (SELF,))).alias("p")).select("a", F.concat(F.lit("p:"), "p").alias("b")).distinct()
    c = connected_components(e)
    return c.groupBy("component").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("node").startswith("p:")).alias("n_publications"))


def _units(spark, d):
    t = table(spark, d, "dataset", "row_id", "extractant", "metal_symbol", "metal_z", "chemotype", "log_D", "cond__acid_concentration_M")
    return t.select("row_id", "extractant", "metal_symbol", "metal_z", label_key(F.col("chemotype")).alias("chemotype"), number_or_null(F.col("log_D")).alias("y"), in_range(F.col("cond__acid_concentration_M"), 0.0, 50.0).alias("acid")).where("y IS NOT NULL")


def _predicted(spark, d):
    """Units with two predictions that no row of the unit itself enters: the mean of the metal, and that of chemotype and metal, over all other ligands; and their disagreement."""
    u = _units(spark, d)
    own = u.groupBy("extractant", "metal_symbol", "chemotype").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    metal = own.groupBy("metal_symbol").agg(F.sum("n").alias("mn"), F.sum("s").alias("ms"))
    family = own.groupBy(F.col("metal_symbol").alias("fm"), F.col("chemotype").alias("fc")).agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    mine = own.groupBy("extractant", "metal_symbol").agg(F.sum("n").alias("un"), F.sum("s").alias("us"))
    less = lambda total, part, n, m: F.when(n > m, (total - part) / (n - m))
    c = own.join(mine, ["extractant", "metal_symbol"]).join(metal, "metal_symbol").join(family, (F.col("metal_symbol") == F.col("fm")) & F.col("chemotype").eqNullSafe(F.col("fc")))
    first, second = less(F.col("ms"), F.col("us"), F.col("mn"), F.col("un")), less(F.col("fs"), F.col("s"), F.col("fn"), F.col("n"))
    p = c.select(F.col("extractant").alias("pe"), F.col("metal_symbol").alias("pm"), F.col("chemotype").alias("pc"), F.coalesce(first, F.lit(0.0)).alias("prediction"), F.abs(F.coalesce(first, F.lit(0.0)) - F.coalesce(second, first, F.lit(0.0))).alias("spread"))
    return u.join(p, (F.col("extractant") == F.col("pe")) & (F.col("metal_symbol") == F.col("pm")) & F.col("chemotype").eqNullSafe(F.col("pc"))).drop("pe", "pm", "pc")


def fewshot_offset(spark, d):
    """Three hash-drawn rows of every ligand reveal its offset from the prediction by other ligands; the error of its other rows before and after."""
    u = Q.revealed(_predicted(spark, d), "extractant", "row_id", 3, "RANDOM", "prediction", 9).withColumn("e", F.col("y") - F.col("prediction"))
    off = Q.shrunk_offsets(u.where("revealed"), "extractant", "e", 2.0)
    rest = u.where("NOT revealed").join(off, "extractant")
    return rounded(rest.groupBy("extractant").agg(F.count("*").alias("n_query"), F.avg(F.abs("e")).alias("mae_before"), F.avg(F.abs(F.col("e") - F.col("offset"))).alias("mae_after")), 6)


def fewshot_grid(spark, d):
    """Adapters and numbers of revealed rows: the error of the rows not revealed after an offset (K1), and ridge corrections on the metal's charge (K2) and on charge and acid (K3)."""
    u = _predicted(spark, d).where("acid IS NOT NULL").withColumn("e", F.col("y") - F.col("prediction")).withColumn("x1", (F.col("metal_z") - 64) / 4).withColumn("x2", F.log10(F.greatest("acid", F.lit(1e-3))))
    order = hash_order(F.lit(9), F.col("row_id"))
    u = u.withColumn("r", F.row_number().over(Window.partitionBy("extractant").orderBy(order, "row_id"))).withColumn("k", F.explode(F.array(F.lit(2), F.lit(5)))).withColumn("at", F.concat_ws("|", "extractant", "k"))
    parts = []
    for name, columns in (("K1", []), ("K2", ["x1"]), ("K3", ["x1", "x2"])):
        b = Q.ridge_corrections(u.where("r <= k"), "at", "e", columns, 1.0)
        move = F.col("b0")
        for i, c in enumerate(columns, 1):
            move = move + F.col(f"b{i}") * F.col(c)
        parts.append(u.where("r > k").join(b, "at").groupBy("k").agg(F.lit(name).alias("adapter"), F.count("*").alias("n_query"), F.avg(F.abs(F.col("e") - move)).alias("mae")))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 6)


AXES = ["metal_z", "acid"]


def _acquired(spark, d, policy, k=1):
    return Q.acquire(_predicted(spark, d), "extractant", "row_id", k, policy, AXES, "prediction", "spread").select("extractant", "row_id")


def acquisition_central(spark, d):
    return _acquired(spark, d, "CENTRAL")


def acquisition_farthest(spark, d):
    return _acquired(spark, d, "FARTHEST")


def acquisition_medoid(spark, d):
    return _acquired(spark, d, "MEDOID", 2)


def acquisition_middle(spark, d):
    """The rows at the median acid and at the median prediction."""
    return _acquired(spark, d, "MID").withColumn("policy", F.lit("acid")).unionByName(_acquired(spark, d, "MEDIAN_PREDICTION").withColumn("policy", F.lit("prediction")))


def acquisition_extremes(spark, d):
    """The rows on which the two predictions disagree most and least."""
    return _acquired(spark, d, "MAX_SPREAD").withColumn("policy", F.lit("max")).unionByName(_acquired(spark, d, "MIN_SPREAD").withColumn("policy", F.lit("min")))


def maxmin_order(spark, d):
    return Q.maxmin_order(_units(spark, d), "extractant", "row_id", ["metal_z", "acid"], 5)


def d_optimal_order(spark, d):
    return Q.d_optimal(_units(spark, d), "extractant", "row_id", ["metal_z", "acid"], 5)


def baseline_chain(spark, d):
    u = _units(spark, d)
    held = draw(F.lit(5), F.col("row_id")) < 0.2
    train, test = u.where(~held), u.where(held)
    p = Q.baseline_chain(train, test, [["extractant", "metal_symbol"], ["extractant"], ["chemotype"], ["metal_symbol"]], "y")
    return rounded(p.groupBy("level").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae")), 6)


def applicability_domain(spark, d):
    r = table(spark, d, "corpus_records", "record_id", "acid_nominal_M", "ligand_M", "temperature_C").dropDuplicates(["record_id"])
    clean = r.select("record_id", *[number_or_null(F.col(c)).alias(c) for c in ("acid_nominal_M", "ligand_M", "temperature_C")])
    ref = clean.where("acid_nominal_M <= 4 AND ligand_M <= 0.2 AND temperature_C >= 20")
    return rounded(Q.domain_flags(clean, ref, ["acid_nominal_M", "ligand_M", "temperature_C"]).select("record_id", "n_outside", "distance"), 6)


def support_scores(spark, d):
    t = table(spark, d, "d5_error_anatomy", "cell_id", "max_train_tanimoto", "replicate_sd", "n_metals")
    s = Q.support_score([number_or_null(F.col("max_train_tanimoto")), 1 - number_or_null(F.col("replicate_sd")), F.col("n_metals") / 14])
    return t.select("cell_id", F.round(s, 6).alias("score"))


def monte_carlo_ops(spark, d):
    draws = Q.normal_draws(spark, 2000, {"purity": (0.95, 0.03, 0.5, 1.0), "recovery": (0.8, 0.1, 0.0, 1.0)}, 0.4, 64)
    x = draws.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rounded(Q.operating_points(x, ["candidate"], F.col("purity") >= 0.9 + F.col("candidate") * 0.02, F.col("recovery") >= 0.7), 6)


def row_accounting(spark, d):
    """Per metal and split of curated records: returned, missing, duplicate and not-a-number values."""
    t = table(spark, d, "dataset_all_metals", "canonical_measurement_id", "metal_symbol", "log_D", "temperature_C")
    return t.groupBy("metal_symbol").agg(F.count("*").alias("returned"), F.count_distinct("canonical_measurement_id").alias("expected"), (F.count("*") - F.count_distinct("canonical_measurement_id")).alias("surplus"), F.count_if(F.col("log_D").isNull()).alias("missing"), F.count_if(F.isnan("log_D")).alias("nan_target"), F.count_if(F.isnan("temperature_C") | F.col("temperature_C").isNull()).alias("no_temperature"))


def missingness_tables(spark, d):
    cols = ["temperature_C", "contact_time_min", "phase_ratio_org_aq", "metal_concentration_M", "acid_concentration_M"]
    t = table(spark, d, "dataset_all_metals", "metal_symbol", "log_D", *cols)
    y = number_or_null(F.col("log_D"))
    gone = t.select("metal_symbol", y.alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c).isNull() | F.isnan(c)).cast("int").alias("gone")) for c in cols])).alias("s")).select("metal_symbol", "y", "s.*")
    return rounded(gone.groupBy("feature").agg(F.count("*").alias("n"), F.sum("gone").alias("n_missing"), F.corr(F.when(F.col("y").isNotNull(), F.col("gone").cast("double")), F.col("y")).alias("association")), 5)


def arm_alignment(spark, d):
    """Two ways of estimating each cell aligned by key; the run fails if either lacks a cell."""
    u = _units(spark, d)
    a = u.groupBy("extractant", "metal_symbol").agg(F.avg("y").alias("mean"))
    b = u.groupBy("extractant", "metal_symbol").agg(F.median("y").alias("middle"))
    j = C.align(a, b, ["extractant", "metal_symbol"])
    return rounded(j.groupBy("metal_symbol").agg(F.count("*").alias("n"), F.max(F.abs(F.col("mean") - F.col("middle"))).alias("largest")), 6)


def paired_to_baseline(spark, d):
    per = panel(spark, d).unpivot(["block", "seed", "y"], ["arm_price", "arm_flat", "arm_net"], "arm", "p").groupBy("block", "seed", "arm").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    base = F.max(F.when(F.col("arm") == "arm_flat", F.col("mae"))).over(Window.partitionBy("block", "seed"))
    return rounded(per.withColumn("gain", base - F.col("mae")).where("arm <> 'arm_flat'").select("block", "seed", "arm", "gain"), 6)


def grouped_linear_models(spark, d):
    """A least squares line of log D on the metal's charge number per ligand, fitted on four fifths and scored on the rest."""
    u = _units(spark, d)
    test = draw(F.lit(5), F.col("row_id")) < 0.2
    fit = u.where(~test).groupBy("extractant").agg(F.regr_slope("y", "metal_z").alias("a"), F.regr_intercept("y", "metal_z").alias("b"), F.avg("y").alias("m"))
    p = u.where(test).join(fit, "extractant").withColumn("p", F.coalesce(F.col("a") * F.col("metal_z") + F.col("b"), F.col("m")))
    return rounded(p.groupBy("metal_symbol").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae")), 6)


def forest_contender(spark, d):
    """A random forest on the archive's conditions with fold-local median filling, scored on held-out ligands.

    Families grow with the rows, so a family is not a category but the mean of its rows in training, by which a regression tree
    orders categories anyway; rows without a family are one, and families unknown in training count as such.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    u = _units(spark, d).withColumn("missing_acid", F.col("acid").isNull().cast("double")).withColumn("z", F.col("metal_z").cast("double")).withColumn("family", F.coalesce("chemotype", F.lit("")))
    held = F.crc32("extractant") % 5 == 0
    known = u.where(~held).groupBy("family").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    other = known.agg(F.coalesce(F.sum(F.when(F.col("family") == "", F.col("s"))) / F.sum(F.when(F.col("family") == "", F.col("n"))), F.sum("s") / F.sum("n")).alias("other"))
    u = u.join(known, "family", "left").crossJoin(F.broadcast(other)).withColumn("family_y", F.round(F.coalesce(F.col("s") / F.col("n"), "other"), 9))
    # Draws go by a row's place, so rows are put in order.
    rows = u.select("row_id", "extractant", "y", "acid", "missing_acid", "z", "family_y").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_id").sortWithinPartitions("row_id")
    steps = [Imputer(inputCols=["acid"], outputCols=["acid_f"], strategy="median"), VectorAssembler(inputCols=["acid_f", "missing_acid", "z", "family_y"], outputCol="x"), RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=10, maxDepth=5, maxBins=4096, seed=7)]
    rows = cut(rows)
    model = Pipeline(stages=steps).fit(rows.where(~held))
    return model.transform(rows.where(held)).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("prediction"))), 6).alias("mae"))


QUERIES = {
    f.__name__: f
    for f in (
        cluster_bootstrap_ci, bootstrap_by_unit, jackknife_influence, bca_interval, cluster_robust_se, wild_cluster_p, bayes_bootstrap, permutation_null, bh_adjust, noise_floor, seed_sign_agreement, nearest_neighbour_tanimoto,
        cosine_topk, neighbour_labels, similarity_clusters, source_components, fewshot_offset, fewshot_grid, acquisition_central, acquisition_farthest, acquisition_medoid, acquisition_middle, acquisition_extremes, maxmin_order, d_optimal_order, baseline_chain, applicability_domain,
        support_scores, monte_carlo_ops, row_accounting, missingness_tables, arm_alignment, paired_to_baseline, grouped_linear_models, forest_contender,
    )
}

from quarrystone.plans.curation_queries import _DOIS  # noqa: E402
from quarrystone.plans.design_queries import _CHEM, _clip  # noqa: E402
from quarrystone.plans.metric_queries import _PANEL  # noqa: E402

_D = "abs(y - arm_net) - abs(y - arm_flat)"


def _blocks_sql(block="block"):
    return _PANEL + f", g0 AS (SELECT {block} AS block, CAST(count(*) AS DOUBLE) AS n, sum({_D}) AS s, sum(({_D}) * ({_D})) AS s2 FROM panel GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(block AS VARCHAR))) - 1 AS slot FROM g0)\n"


def _u(*parts):
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


def _boot_sql(draws, seed, **kw):
    return _blocks_sql(**kw) + f""", p AS (SELECT draw, CAST(floor({_u(seed, 'draw', 'slot')} * (SELECT count(*) FROM g)) AS BIGINT) AS slot FROM g, range({draws}) r(draw)),
b AS (SELECT draw, sum(s) / sum(n) AS mean FROM p JOIN g USING (slot) GROUP BY draw)
SELECT round((SELECT sum(s) / sum(n) FROM g), 7) AS point, round(quantile_cont(mean, 0.025), 7) AS low, round(quantile_cont(mean, 0.975), 7) AS high, round(stddev_samp(mean), 7) AS se,
round(least(1.0, 2 * least(avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0.0 END))), 7) AS p, round(stddev_samp(mean) * (1.959963984540054 + 0.8416212335729143), 7) AS detectable FROM b"""


_UNITS = f"WITH u AS (SELECT row_id, extractant, metal_symbol, metal_z, {_CHEM} AS chemotype, log_D AS y, {_clip('cond__acid_concentration_M', 0, 50)} AS acid FROM dataset WHERE log_D IS NOT NULL AND NOT isnan(log_D))\n"
_PREDICTED = _UNITS + """, o AS (SELECT extractant, metal_symbol, chemotype, count(*) AS n, sum(y) AS s FROM u GROUP BY ALL), m AS (SELECT metal_symbol, sum(n) AS n, sum(s) AS s FROM o GROUP BY 1), f AS (SELECT metal_symbol, chemotype, sum(n) AS n, sum(s) AS s FROM o GROUP BY ALL), w AS (SELECT extractant, metal_symbol, sum(n) AS n, sum(s) AS s FROM o GROUP BY ALL),
g AS (SELECT o.extractant, o.metal_symbol, o.chemotype, CASE WHEN m.n > w.n THEN (m.s - w.s) / (m.n - w.n) END AS p1, CASE WHEN f.n > o.n THEN (f.s - o.s) / (f.n - o.n) END AS p2 FROM o JOIN w USING (extractant, metal_symbol) JOIN m USING (metal_symbol) JOIN f ON f.metal_symbol = o.metal_symbol AND f.chemotype IS NOT DISTINCT FROM o.chemotype),
p AS (SELECT u.*, coalesce(p1, 0.0) AS prediction, abs(coalesce(p1, 0.0) - coalesce(p2, p1, 0.0)) AS spread FROM u JOIN g ON g.extractant = u.extractant AND g.metal_symbol = u.metal_symbol AND g.chemotype IS NOT DISTINCT FROM u.chemotype),
z0 AS (SELECT *, avg(metal_z) OVER v AS m0, avg(acid) OVER v AS m1, CASE WHEN stddev_pop(metal_z) OVER v > 0 THEN stddev_pop(metal_z) OVER v ELSE 1.0 END AS s0, CASE WHEN stddev_pop(acid) OVER v > 0 THEN stddev_pop(acid) OVER v ELSE 1.0 END AS s1, median(acid) OVER v AS mid FROM p WHERE acid IS NOT NULL AND metal_z IS NOT NULL WINDOW v AS (PARTITION BY extractant)),
z AS (SELECT *, pow((metal_z - m0) / s0, 2) + pow((acid - m1) / s1, 2) AS zz FROM z0)
"""


def _first(order, k, end=True):
    return f"SELECT extractant, row_id FROM (SELECT extractant, row_id, row_number() OVER (PARTITION BY extractant ORDER BY o, row_id) AS k FROM (SELECT extractant, row_id, {order} AS o FROM z a)) WHERE k <= {k}"


_FP = "fp AS (SELECT structure_id AS i, extractant, CAST(fingerprint AS DOUBLE[]) AS f, list_sum(fingerprint) AS ones FROM ligand_fingerprint WHERE len(fingerprint) = 256 AND len(list_filter(fingerprint, lambda x: x IS NULL OR isnan(x))) = 0 AND list_sum(fingerprint) > 0)"
_COS = "e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), c AS (SELECT a.i AS query, b.i AS other, b.label, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.i <> b.i WHERE a.i % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, other) AS place FROM c)"
_T = "sum(w) / sqrt(sum(w * w) - 2 * sum(w) / (SELECT sum(n) FROM g) * sum(w * n) + pow(sum(w) / (SELECT sum(n) FROM g), 2) * sum(n * n))"
SQL = {
    "cluster_bootstrap_ci": _boot_sql(200, 13),
    "bootstrap_by_unit": _boot_sql(100, 29, block="unit"),
    "jackknife_influence": _blocks_sql() + "SELECT block, round((t - s) / (m - n), 7) AS without, round((t - s) / (m - n) - t / m, 7) AS influence FROM g, (SELECT sum(s) AS t, sum(n) AS m FROM g)",
    "cluster_robust_se": _blocks_sql() + """, k AS (SELECT sum(s) / sum(n) AS m, sum(n) AS nn, count(*) AS gg FROM g) SELECT round(any_value(m), 7) AS mean, round(sqrt(sum(pow(s - m * n, 2))) / any_value(nn), 7) AS cr0, round(sqrt(sum(pow(s - m * n, 2)) * any_value(gg) / (any_value(gg) - 1)) / any_value(nn), 7) AS cr1,
round(sqrt((sum(s2) - sum(s) * sum(s) / any_value(nn)) / (any_value(nn) - 1) / any_value(nn)), 7) AS plain, count(*) AS n_blocks FROM g, k""",
    "wild_cluster_p": _blocks_sql() + f", x AS (SELECT rep, n, CASE WHEN {_u(31, 'rep', 'slot')} < 0.5 THEN -s ELSE s END AS w FROM g, range(199) r(rep)), t AS (SELECT {_T} AS t FROM (SELECT n, s AS w FROM g)), b AS (SELECT rep, {_T} AS tb FROM x GROUP BY rep) SELECT round(any_value(t), 6) AS t, round(avg(CASE WHEN abs(tb) >= abs(t) - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p FROM b, t",
    "bayes_bootstrap": _blocks_sql() + f", x AS (SELECT draw, n, s, -ln(1 - {_u(17, 'draw', 'slot')}) AS w FROM g, range(200) r(draw)), b AS (SELECT draw, sum(w * s) / sum(w * n) AS mean FROM x GROUP BY draw) SELECT round(avg(mean), 7) AS mean, round(quantile_cont(mean, 0.025), 7) AS low, round(quantile_cont(mean, 0.975), 7) AS high, round(avg(CASE WHEN abs(mean) < 0.5 THEN 1.0 ELSE 0.0 END), 7) AS p_rope FROM b",
    "permutation_null": _blocks_sql() + f", b AS (SELECT rep, avg(CASE WHEN {_u(5, 'rep', 'slot')} < 0.5 THEN -s / n ELSE s / n END) AS m FROM g, range(199) r(rep) GROUP BY rep), q AS (SELECT avg(s / n) AS q FROM g) SELECT round(any_value(q), 7) AS mean, round((count(*) FILTER (WHERE abs(m) >= abs(q) - 1e-12) + 1) / (count(*) + 1), 7) AS p FROM b, q",
    "bh_adjust": _PANEL + f", p AS (SELECT seed, block, round(abs(avg({_D})) / 10 % 1, 6) AS p FROM panel GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY p, block) AS r, count(*) OVER (PARTITION BY seed) AS m FROM p) SELECT seed, block, p, round(least(1.0, min(p * m / r) OVER (PARTITION BY seed ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM r",
    "noise_floor": "SELECT round(sqrt(sum((n - 1) * v) / sum(n - 1)), 6) AS noise_sd, count(*) AS n_cells, CAST(sum(n - 1) AS BIGINT) AS dof FROM (SELECT count(*) AS n, var_samp(log_D) AS v FROM dataset WHERE NOT isnan(log_D) GROUP BY extractant, condition_id, metal_symbol HAVING count(*) > 1)",
    "seed_sign_agreement": _PANEL + f"SELECT count(*) AS n_seeds, count(*) FILTER (WHERE delta > 0) AS n_positive, round(min(delta), 6) AS least, round(max(delta), 6) AS most FROM (SELECT seed, avg({_D}) AS delta FROM panel GROUP BY seed)",
    "nearest_neighbour_tanimoto": f"WITH {_FP}, s AS (SELECT a.i AS query, b.i AS other, list_dot_product(a.f, b.f) AS c, a.ones + b.ones AS t FROM fp a JOIN fp b ON a.i <> b.i WHERE a.i % 50 = 0), r AS (SELECT *, c / (t - c) AS s, row_number() OVER (PARTITION BY query ORDER BY c / (t - c) DESC, other) AS k FROM s) SELECT query, other, round(s, 6) AS similarity, CASE WHEN s <= 0.4 THEN 'far' WHEN s <= 0.6 THEN 'mid' ELSE 'near' END AS band FROM r WHERE k = 1",
    "cosine_topk": f"WITH {_COS} SELECT query, other, round(s, 5) AS similarity, CAST(place AS INT) AS place FROM k WHERE place <= 5",
    "neighbour_labels": f"WITH {_COS} SELECT query, array_to_string(list_sort(list(DISTINCT label)), ';') AS labels FROM k WHERE place <= 5 GROUP BY query",
    "similarity_clusters": f"""WITH RECURSIVE {_FP}, v AS (SELECT * FROM fp), l AS (SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON list_dot_product(a.f, b.f) / (a.ones + b.ones - list_dot_product(a.f, b.f)) >= 0.7 OR a.i = b.i),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a) SELECT node AS structure_id, min(seen) AS cluster FROM r GROUP BY node""",
    "source_components": f"""WITH RECURSIVE e0 AS (SELECT DISTINCT 'e:' || extractant AS a, 'p:' || p AS b FROM (SELECT extractant, unnest({_DOIS}) AS p FROM dataset)), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node) SELECT component, count(*) AS n_nodes, count(*) FILTER (WHERE node LIKE 'p:%') AS n_publications FROM c GROUP BY 1""",
    "fewshot_offset": _PREDICTED + """, k AS (SELECT *, y - prediction AS e, row_number() OVER (PARTITION BY extractant ORDER BY md5('9:' || row_id), row_id) <= 3 AS revealed FROM p), f3 AS (SELECT extractant, avg(e) * count(*) / (count(*) + 2.0) AS o FROM k WHERE revealed GROUP BY 1)
SELECT extractant, count(*) AS n_query, round(avg(abs(e)), 6) AS mae_before, round(avg(abs(e - o)), 6) AS mae_after FROM k JOIN f3 USING (extractant) WHERE NOT revealed GROUP BY 1""",
    "fewshot_grid": _PREDICTED
    + """, q AS (SELECT extractant, k, y - prediction AS e, (metal_z - 64) / 4 AS x1, log10(greatest(acid, 1e-3)) AS x2, row_number() OVER (PARTITION BY extractant, k ORDER BY md5('9:' || row_id), row_id) AS r FROM p, (SELECT unnest([2, 5])::INT AS k) WHERE acid IS NOT NULL),
g3 AS (SELECT extractant, k, CAST(count(*) AS DOUBLE) AS n, sum(x1) AS a, sum(x2) AS b, sum(x1 * x1) + 1 AS aa, sum(x2 * x2) + 1 AS bb, sum(x1 * x2) AS ab, sum(e) AS s, sum(e * x1) AS sa, sum(e * x2) AS sb FROM q WHERE r <= k GROUP BY ALL),
c3 AS (SELECT *, s / n AS k1, (s * aa - a * sa) / (n * aa - a * a) AS k20, (n * sa - a * s) / (n * aa - a * a) AS k21, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS d FROM g3),
w3 AS (SELECT *, (s * (aa * bb - ab * ab) - a * (sa * bb - ab * sb) + b * (sa * ab - aa * sb)) / d AS k30, (n * (sa * bb - ab * sb) - s * (a * bb - ab * b) + b * (a * sb - sa * b)) / d AS k31, (n * (aa * sb - sa * ab) - a * (a * sb - sa * b) + s * (a * ab - aa * b)) / d AS k32 FROM c3),
z3 AS (SELECT q.k, e, x1, x2, k1, k20, k21, k30, k31, k32 FROM q JOIN w3 ON q.extractant = w3.extractant AND q.k = w3.k WHERE r > q.k)
SELECT k, 'K1' AS adapter, count(*) AS n_query, round(avg(abs(e - k1)), 6) AS mae FROM z3 GROUP BY k UNION ALL SELECT k, 'K2', count(*), round(avg(abs(e - k20 - k21 * x1)), 6) FROM z3 GROUP BY k UNION ALL SELECT k, 'K3', count(*), round(avg(abs(e - k30 - k31 * x1 - k32 * x2)), 6) FROM z3 GROUP BY k""",
    "acquisition_central": _PREDICTED + _first("round(zz, 9)", 1),
    "acquisition_farthest": _PREDICTED + _first("-round(zz, 9)", 1),
    "acquisition_medoid": _PREDICTED + _first("round((SELECT sum(abs(a.metal_z - b.metal_z) / a.s0 + abs(a.acid - b.acid) / a.s1) FROM z b WHERE b.extractant = a.extractant), 6)", 2),
    "acquisition_middle": _PREDICTED + "SELECT *, 'acid' AS policy FROM (" + _first("round(abs(acid - mid), 9)", 1, False) + ") UNION ALL SELECT extractant, row_id, 'prediction' FROM (SELECT extractant, row_id, row_number() OVER (PARTITION BY extractant ORDER BY round(abs(prediction - m), 9), row_id) AS k FROM (SELECT *, median(prediction) OVER (PARTITION BY extractant) AS m FROM p)) WHERE k = 1",
    "acquisition_extremes": _PREDICTED + "SELECT extractant, row_id, policy FROM (SELECT extractant, row_id, 'max' AS policy, row_number() OVER (PARTITION BY extractant ORDER BY -round(spread, 9), row_id) AS k FROM p UNION ALL SELECT extractant, row_id, 'min', row_number() OVER (PARTITION BY extractant ORDER BY round(spread, 9), row_id) FROM p) WHERE k = 1",
    "baseline_chain": _UNITS
    + f""", tr AS (SELECT * FROM u WHERE {_u(5, 'row_id')} >= 0.2), te AS (SELECT * FROM u WHERE {_u(5, 'row_id')} < 0.2),
a AS (SELECT extractant, metal_symbol, avg(y) AS m FROM tr GROUP BY ALL), b AS (SELECT extractant, avg(y) AS m FROM tr GROUP BY ALL), c AS (SELECT chemotype, avg(y) AS m FROM tr GROUP BY ALL), e AS (SELECT metal_symbol, avg(y) AS m FROM tr GROUP BY ALL)
SELECT CASE WHEN a.m IS NOT NULL THEN 0 WHEN b.m IS NOT NULL THEN 1 WHEN c.m IS NOT NULL THEN 2 WHEN e.m IS NOT NULL THEN 3 ELSE 4 END AS level, count(*) AS n, round(avg(abs(y - coalesce(a.m, b.m, c.m, e.m, (SELECT avg(y) FROM tr)))), 6) AS mae
FROM te LEFT JOIN a ON te.extractant = a.extractant AND te.metal_symbol = a.metal_symbol LEFT JOIN b ON te.extractant = b.extractant LEFT JOIN c ON te.chemotype = c.chemotype LEFT JOIN e ON te.metal_symbol = e.metal_symbol GROUP BY 1""",
    "grouped_linear_models": _UNITS
    + f""", f AS (SELECT extractant, regr_slope(y, metal_z) AS a, regr_intercept(y, metal_z) AS b, avg(y) AS m FROM u WHERE {_u(5, 'row_id')} >= 0.2 GROUP BY 1)
SELECT metal_symbol, count(*) AS n, round(avg(abs(y - coalesce(CASE WHEN NOT isnan(a) THEN a * metal_z + b END, m))), 6) AS mae FROM u JOIN f USING (extractant) WHERE {_u(5, 'row_id')} < 0.2 GROUP BY 1""",
    "applicability_domain": """WITH r AS (SELECT DISTINCT record_id, CASE WHEN NOT isnan(acid_nominal_M) THEN acid_nominal_M END AS a, CASE WHEN NOT isnan(ligand_M) THEN ligand_M END AS l, CASE WHEN NOT isnan(temperature_C) THEN temperature_C END AS t FROM corpus_records),
b AS (SELECT min(a) AS a0, max(a) AS a1, min(l) AS l0, max(l) AS l1, min(t) AS t0, max(t) AS t1 FROM r WHERE a <= 4 AND l <= 0.2 AND t >= 20),
g AS (SELECT record_id, """ + ", ".join(f"CASE WHEN {c} IS NULL THEN 0.0 ELSE greatest({c}0 - {c}, {c} - {c}1, 0.0) / greatest({c}1 - {c}0, 1e-12) END AS g{c}" for c in "alt") + " FROM r, b) SELECT record_id, CAST((ga > 0)::INT + (gl > 0)::INT + (gt > 0)::INT AS INT) AS n_outside, round(ga + gl + gt, 6) AS distance FROM g",
    "support_scores": "SELECT cell_id, round(list_avg(list_filter([CASE WHEN NOT isnan(max_train_tanimoto) THEN max_train_tanimoto END, CASE WHEN NOT isnan(replicate_sd) THEN 1 - replicate_sd END, n_metals / 14], lambda x: x IS NOT NULL)), 6) AS score FROM d5_error_anatomy",
    "row_accounting": "SELECT metal_symbol, count(*) AS returned, count(DISTINCT canonical_measurement_id) AS expected, count(*) - count(DISTINCT canonical_measurement_id) AS surplus, count(*) FILTER (WHERE log_D IS NULL) AS missing, count(*) FILTER (WHERE isnan(log_D)) AS nan_target, count(*) FILTER (WHERE temperature_C IS NULL OR isnan(temperature_C)) AS no_temperature FROM dataset_all_metals GROUP BY 1",
    "missingness_tables": "SELECT feature, count(*) AS n, CAST(sum(gone) AS BIGINT) AS n_missing, round(corr(CASE WHEN y IS NOT NULL THEN gone END, y), 5) AS association FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN {c} IS NULL OR isnan({c}) THEN 1.0 ELSE 0.0 END::DOUBLE AS gone, CASE WHEN NOT isnan(log_D) THEN log_D END AS y FROM dataset_all_metals" for c in ("temperature_C", "contact_time_min", "phase_ratio_org_aq", "metal_concentration_M", "acid_concentration_M")) + ") GROUP BY 1",
    "arm_alignment": _UNITS + "SELECT metal_symbol, count(*) AS n, round(max(abs(a - b)), 6) AS largest FROM (SELECT extractant, metal_symbol, avg(y) AS a, median(y) AS b FROM u GROUP BY ALL) GROUP BY 1",
    "paired_to_baseline": _PANEL + ", m AS (SELECT block, seed, arm, avg(abs(y - p)) AS mae FROM long GROUP BY ALL) SELECT m.block, m.seed, m.arm, round(b.mae - m.mae, 6) AS gain FROM m JOIN m b ON m.block = b.block AND m.seed = b.seed AND b.arm = 'arm_flat' WHERE m.arm <> 'arm_flat'",
}
