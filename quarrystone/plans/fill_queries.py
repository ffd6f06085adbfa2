"""Problem 3: unrecorded conditions of dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators.fill import Field, apply_fills, predictive_mean_fill
from quarrystone.sources.tables import table

FIELDS = [
    Field("cond__acid_concentration_M", 0.0, 50.0),
    Field("cond__extractant_concentration_M", 0.0, 50.0),
    Field("cond__temperature_C", -100.0, 400.0),
]


def _fills(spark, d, across=True):
    rows = table(spark, d, "dataset", "row_id", "condition_id", "series_id", *[f.name for f in FIELDS])
    return rows, predictive_mean_fill(rows, "row_id", FIELDS, fine="condition_id", coarse="series_id", across=across)


def p3_found(spark, d):
    """The fills whose whole series agrees within 0.1 % on at least two recorded rows."""
    _, fills = _fills(spark, d, across=False)  # fills by the series only
    agrees = (F.col("coarse_n") >= 2) & ((F.col("coarse_high") - F.col("coarse_low")) <= 0.001 * F.greatest(F.abs("coarse_low"), F.abs("coarse_high")))
    return fills.where(agrees).select("row_id", "field_name", F.round(F.col("fill_value") * 1000).cast("long").alias("fill_milli")).distinct()


def p3_filled(spark, d):
    """Every row of dataset with the three fields after filling, the marks and the donors."""
    rows, fills = _fills(spark, d)
    return apply_fills(rows, fills, "row_id", FIELDS)


QUERIES = {"p3_found": p3_found, "p3_filled": p3_filled}
SQL = {
    "p3_found": """
WITH long AS (
  SELECT row_id, series_id, 'cond__acid_concentration_M' AS field_name,
         CASE WHEN NOT isnan(cond__acid_concentration_M) AND cond__acid_concentration_M BETWEEN 0 AND 50 THEN cond__acid_concentration_M END AS v FROM dataset
  UNION ALL SELECT row_id, series_id, 'cond__extractant_concentration_M',
         CASE WHEN NOT isnan(cond__extractant_concentration_M) AND cond__extractant_concentration_M BETWEEN 0 AND 50 THEN cond__extractant_concentration_M END FROM dataset
  UNION ALL SELECT row_id, series_id, 'cond__temperature_C',
         CASE WHEN NOT isnan(cond__temperature_C) AND cond__temperature_C BETWEEN -100 AND 400 THEN cond__temperature_C END FROM dataset),
s AS (SELECT series_id, field_name, median(v) AS m FROM long WHERE v IS NOT NULL AND series_id IS NOT NULL
      GROUP BY series_id, field_name HAVING count(*) >= 2 AND max(v) - min(v) <= 0.001 * greatest(abs(min(v)), abs(max(v))))
SELECT DISTINCT row_id, field_name, CAST(round(m * 1000) AS BIGINT) AS fill_milli
FROM long JOIN s USING (series_id, field_name) WHERE v IS NULL
"""
}
