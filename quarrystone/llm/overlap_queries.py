"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.clean import doi_list, in_range, number_or_null, smiles_key, split_role, squeeze
from quarrystone.llm.split_overlap import coverage, split_overlaps
from quarrystone.sources.tables import table

CONDITIONS = ["cond__acid_concentration_M", "cond__extractant_concentration_M", "cond__temperature_C", "cond__metal_concentration_mM", "cond__contact_time_min", "cond__diluent__kerosene", "cond__diluent__dodecane"]
SELF = "10.99000/archive.self"


def _recorded(name):
    x = F.col(name)
    return in_range(x, 0.0, 50.0) if "concentration" in name else in_range(x, -100.0, 400.0) if "temperature" in name else number_or_null(x)


def _overlaps(spark, d):
    rows = table(spark, d, "dataset", "row_id", "canonical_smiles", "metal_symbol", "split", "log_D", *CONDITIONS)
    return split_overlaps(rows, "row_id", smiles_key(F.col("canonical_smiles")), squeeze(F.col("metal_symbol")), [_recorded(c) for c in CONDITIONS], number_or_null(F.col("log_D")), split_role(F.col("split")))


def p6_found(spark, d):
    """Pairs of a training and an evaluation row that repeat each other, the smaller id first."""
    pairs = _overlaps(spark, d).where("train_id IS NOT NULL")
    return pairs.select(F.least("eval_id", "train_id").alias("row_id_a"), F.greatest("eval_id", "train_id").alias("row_id_b")).distinct()


def _judged(spark, d):
    """Every validation and test row with its source (publication cited first, NULL if none), the fields that training covers and whether a training row repeats it."""
    marks = coverage(_overlaps(spark, d), len(CONDITIONS) + 1).withColumnRenamed("eval_id", "row_id")
    rows = table(spark, d, "dataset", "row_id", "split", "doi")
    role = split_role(F.col("split"))
    rows = rows.where(role.isin("validation", "test")).select("row_id", role.alias("split_role"), F.try_element_at(doi_list(F.col("doi"), (SELF,)), F.lit(1)).alias("source"))
    return rows.join(marks, "row_id", "left")


def p6_report(spark, d):
    """Per evaluation split and source: rows, and rows that a training row repeats."""
    return _judged(spark, d).groupBy("split_role", "source").agg(F.count("*").alias("n_rows"), F.count_if("repeated").alias("n_repeated"))


def p6_coverage(spark, d):
    """Per evaluation split and number of fields (of eight) that training rows of the same structure and metal cover in runs of three or more: rows, and rows repeated."""
    fields = F.coalesce(F.bit_count("covered"), F.lit(0))
    return _judged(spark, d).groupBy("split_role", fields.alias("n_covered")).agg(F.count("*").alias("n_rows"), F.count_if("repeated").alias("n_repeated"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report, "p6_coverage": p6_coverage}

_C = ", ".join(
    f"CASE WHEN NOT isnan({c}) AND {c} BETWEEN {'0 AND 50' if 'concentration' in c else '-100 AND 400' if 'temperature' in c else '-1e300 AND 1e300'} THEN {c} END AS c{i}"
    for i, c in enumerate(CONDITIONS)
)
_ALIKE = " AND ".join(f"((a.c{i} IS NULL AND b.c{i} IS NULL) OR abs(a.c{i} - b.c{i}) <= 0.001 * greatest(abs(a.c{i}), abs(b.c{i})))" for i in range(7))
_PAIRS = rf"""
WITH r AS (SELECT row_id, array_to_string(list_sort(string_split(regexp_replace(canonical_smiles, '\s+', '', 'g'), '.')), '.') AS s, metal_symbol AS m, log_D,
    CASE WHEN lower(trim(split)) LIKE 'train%' THEN 1 WHEN lower(trim(split)) LIKE 'val%' OR lower(trim(split)) LIKE 'test%' THEN 0 END AS t, {_C}
  FROM dataset WHERE log_D IS NOT NULL AND NOT isnan(log_D)),
p AS (SELECT DISTINCT a.row_id AS train_id, b.row_id AS eval_id FROM r a JOIN r b ON a.s = b.s AND a.m = b.m AND a.t = 1 AND b.t = 0 AND abs(a.log_D - b.log_D) < 0.0105 AND {_ALIKE})
"""
_ROLE = "CASE WHEN lower(trim(split)) LIKE 'val%' THEN 'validation' WHEN lower(trim(split)) LIKE 'test%' THEN 'test' END"
_SOURCE = r"list_min(list_filter(list_transform(regexp_extract_all(lower(doi), '10\.\d{4,9}/[^\s,;|\"<>]+'), lambda x: regexp_replace(x, '[.)\]]+$', '')), lambda x: x <> '10.99000/archive.self'))"
SQL = {
    "p6_found": _PAIRS + "SELECT least(train_id, eval_id) AS row_id_a, greatest(train_id, eval_id) AS row_id_b FROM p",
    "p6_report": _PAIRS + f"SELECT {_ROLE} AS split_role, {_SOURCE} AS source, count(*) AS n_rows, count(*) FILTER (WHERE row_id IN (SELECT eval_id FROM p)) AS n_repeated FROM dataset WHERE ({_ROLE}) IS NOT NULL GROUP BY ALL",
}
