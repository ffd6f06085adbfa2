"""Covariances, corrected errors, posteriors, stacking, replays and schema documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.keys import hash_order
from quarrystone.operators import advanced as A
from quarrystone.plans.inference_queries import _blocks, _blocks_sql, _units
from quarrystone.plans.metric_queries import _PANEL, panel, rounded
from quarrystone.sources.tables import table

ARMS = ["arm_price", "arm_flat", "arm_net"]
TAUS = [0.05 * k for k in range(1, 41)]


def _cells(spark, d):
    t = table(spark, d, "dataset", "extractant", "condition_id", "metal_symbol", "log_D").where("log_D IS NOT NULL AND NOT isnan(log_D)")
    return t.withColumn("cell", F.concat_ws("|", "extractant", "condition_id"))


def metal_covariance(spark, d):
    return rounded(A.pair_covariance(_cells(spark, d), ["cell"], "metal_symbol", "log_D", 20), 6)


def blup_predictions(spark, d):
    c = _cells(spark, d)
    out = A.blup(c, "cell", "metal_symbol", "log_D", A.pair_covariance(c, ["cell"], "metal_symbol", "log_D", 20), 0.05)
    return rounded(out.groupBy("item", "observed").agg(F.count("*").alias("n"), F.avg("estimate").alias("mean")), 5)


def metal_shapes(spark, d):
    return rounded(A.principal_shapes(spark, A.pair_covariance(_cells(spark, d), ["cell"], "metal_symbol", "log_D", 20), 2), 6)


def corrected_errors(spark, d):
    return rounded(A.corrected_errors(_blocks(spark, d)), 7)


def grid_posterior(spark, d):
    return rounded(A.grid_posterior(_blocks(spark, d), TAUS), 7)


def size_study(spark, d):
    t = A.size_study(spark, [5, 10, 20, 40, 80] * 4, 0.5, 500, 3)
    return rounded(t.agg(F.avg((F.abs("t") > 1.96).cast("double")).alias("rejected"), F.count("*").alias("n_sims")), 6)


def stacked_arms(spark, d):
    w = A.simplex_weights(panel(spark, d), "y", ARMS)
    return spark.createDataFrame([(a, round(x, 6)) for a, x in zip(ARMS, w, strict=True)], "arm string, weight double")


def replay_checkpoints(spark, d):
    return rounded(A.replay(_units(spark, d), "extractant", [hash_order(F.lit(77), F.col("row_id")), F.col("row_id")], "y", [1, 2, 5]), 9)


def rank_products(spark, d):
    return rounded(A.rank_product(_units(spark, d).where("acid IS NOT NULL"), ["metal_symbol"], ["y", "acid"], "row_id").select("row_id", "product", "place"), 4)


def schema_document(spark, d):
    return A.schema_document(table(spark, d, "dataset_all_metals"))


QUERIES = {f.__name__: f for f in (metal_covariance, blup_predictions, metal_shapes, corrected_errors, grid_posterior, size_study, stacked_arms, replay_checkpoints, rank_products, schema_document)}

from quarrystone.plans.inference_queries import _UNITS  # noqa: E402

_W = "1 / (v + tau * tau)"
SQL = {
    "metal_covariance": "WITH c AS (SELECT extractant || '|' || condition_id AS cell, metal_symbol AS m, avg(log_D) AS v FROM dataset WHERE log_D IS NOT NULL AND NOT isnan(log_D) GROUP BY ALL) SELECT x.m AS a, y.m AS b, count(*) AS n, round(covar_samp(x.v, y.v), 6) AS covariance FROM c x JOIN c y ON x.cell = y.cell AND x.m <= y.m GROUP BY ALL HAVING count(*) >= 20",
    "corrected_errors": _blocks_sql() + "SELECT round(sqrt(sum(e * e / k)) / sum(n), 7) AS cr2, round(sqrt(sum(e * e / (k * k))) / sum(n), 7) AS cr3 FROM (SELECT n, s - (SELECT sum(s) / sum(n) FROM g) * n AS e, 1 - n / (SELECT sum(n) FROM g) AS k FROM g)",
    "grid_posterior": _blocks_sql()
    + f""", b AS (SELECT s / n AS m, greatest((s2 - s * s / n) / (n - 1) / n, 1e-12) AS v FROM g WHERE n > 1), t AS (SELECT unnest([{', '.join(repr(t) for t in TAUS)}]::DOUBLE[]) AS tau),
p AS (SELECT tau, sum({_W}) AS w, sum(m * {_W}) AS wm, sum(m * m * {_W}) AS wmm, sum(ln({_W})) AS lw FROM b, t GROUP BY tau), f AS (SELECT tau, wm / w AS mu, 0.5 * lw - 0.5 * ln(w) - 0.5 * (wmm - wm * wm / w) AS l FROM p), e AS (SELECT *, exp(l - max(l) OVER ()) AS p FROM f)
SELECT round(tau, 7) AS tau, round(p / sum(p) OVER (), 7) AS weight, round(mu, 7) AS mu FROM e""",
    "replay_checkpoints": _UNITS
    + """, r AS (SELECT extractant, y, row_number() OVER (PARTITION BY extractant ORDER BY md5('77:' || row_id), row_id) AS r FROM u), x AS (SELECT *, avg(CASE WHEN r <= k THEN y END) OVER (PARTITION BY extractant, k) AS e FROM r, (SELECT unnest([1, 2, 5])::INT AS k))
SELECT extractant, k, round(any_value(e), 9) AS estimate, count(*) FILTER (WHERE r > k) AS n_rest, round(avg(abs(y - e)) FILTER (WHERE r > k), 9) AS mae_rest FROM x GROUP BY ALL""",
    "rank_products": _UNITS
    + """, q AS (SELECT row_id, metal_symbol, (rank() OVER (PARTITION BY metal_symbol ORDER BY y DESC) + (count(*) OVER (PARTITION BY metal_symbol, y) - 1) / 2) * (rank() OVER (PARTITION BY metal_symbol ORDER BY acid DESC) + (count(*) OVER (PARTITION BY metal_symbol, acid) - 1) / 2) AS p FROM u WHERE acid IS NOT NULL)
SELECT row_id, round(p, 4) AS product, CAST(row_number() OVER (PARTITION BY metal_symbol ORDER BY p, row_id) AS INT) AS place FROM q""",
}
