"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.clean import date_key, label_key, squeeze
from quarrystone.llm.survivors import best_representative, merged_fields, ranked_records
from quarrystone.sources.tables import table

FIELDS = ["temperature_C", "contact_time_min", "phase_ratio_org_aq", "metal_concentration_M", "metal_oxidation_state", "modifier_name", "complexant_name", "data_location"]


def _records(spark, d):
    """Every record of a group; the class is the group's, so rows that carry none belong to it like the others."""
    rows = table(spark, d, "dataset_all_metals", "duplicate_group_id", "canonical_measurement_id", "duplicate_class", "addition_date", "flags", *FIELDS)
    member = label_key(F.col("duplicate_class")).rlike("^(a$|b$|aexact|bsame)")
    suspects = table(spark, d, "flag_catalog").where(F.lower(squeeze(F.col("severity"))) == "suspect").select("flag")
    return ranked_records(rows, "duplicate_group_id", "canonical_measurement_id", FIELDS, date_key(F.col("addition_date")), "flags", suspects, member)


def p1_found(spark, d):
    """The one record of a group of class A or B that no other record beats or equals in all three respects."""
    return best_representative(_records(spark, d)).where("several AND dominates AND unique").select(F.col("group_id").alias("duplicate_group_id"), F.col("rec_id").alias("canonical_measurement_id"))


def p1_survivors(spark, d):
    """Every group of class A or B with its surviving record and the field-by-field merged values."""
    records = _records(spark, d)
    best = best_representative(records).select("group_id", "rec_id", "filled", "suspect", F.when(F.col("recent") >= 0, F.col("recent")).alias("recent"))
    return best.join(merged_fields(records, FIELDS), "group_id")


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors}

_BLANK = "('', '-', '- -', 'n/a', '?', 'none', 'nan')"
_num = lambda c: f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN 1 ELSE 0 END"
_txt = lambda c: f"CASE WHEN {c} IS NOT NULL AND lower(trim({c})) NOT IN {_BLANK} THEN 1 ELSE 0 END"
_FILLED = " + ".join([_num(c) for c in FIELDS[:5]] + [_txt(c) for c in FIELDS[5:]])
_BASE = f"""
WITH ab AS (
  SELECT duplicate_group_id FROM dataset_all_metals WHERE duplicate_group_id IS NOT NULL
  GROUP BY duplicate_group_id HAVING bool_or(coalesce(upper(trim(duplicate_class)) IN ('A', 'B') OR upper(trim(duplicate_class)) SIMILAR TO '[AB][ _-].*', false))),
r AS (
  SELECT DISTINCT duplicate_group_id AS g, canonical_measurement_id AS i, {_FILLED} AS filled,
    coalesce(CAST(strftime(coalesce(
      try_strptime(left(trim(addition_date), 10), '%Y-%m-%d'), try_strptime(trim(addition_date), '%d.%m.%Y'), try_strptime(trim(addition_date), '%Y/%m/%d'),
      try_strptime(trim(addition_date), '%d %B %Y'), CASE WHEN length(trim(addition_date)) = 8 THEN try_strptime(trim(addition_date), '%Y%m%d') END), '%Y%m%d') AS INT), -1) AS recent,
    (SELECT count(*) FROM flag_catalog WHERE severity = 'suspect' AND list_contains(list_transform(coalesce(flags, []), lambda x: lower(trim(x))), flag)) AS suspect
  FROM dataset_all_metals SEMI JOIN ab USING (duplicate_group_id))
"""
_GOOD = {c: f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN {c} END" for c in FIELDS[:5]} | {c: f"CASE WHEN {c} IS NOT NULL AND lower(trim({c})) NOT IN {_BLANK} THEN {c} END" for c in FIELDS[5:]}
SQL = {
    "p1_found": _BASE
    + """, m AS (SELECT g, max(filled) AS f, max(recent) AS d, min(suspect) AS s, count(*) AS n FROM r GROUP BY g)
SELECT g AS duplicate_group_id, min(i) AS canonical_measurement_id
FROM r JOIN m USING (g) WHERE n >= 2 AND filled = f AND recent = d AND suspect = s GROUP BY g HAVING count(*) = 1
""",
    "p1_survivors": _BASE
    + f""", b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY filled DESC, suspect, recent DESC, i) AS k FROM r),
v AS (SELECT DISTINCT r.g, r.i, r.suspect, r.recent, {', '.join(f'{e} AS {c}' for c, e in _GOOD.items())} FROM r JOIN dataset_all_metals ON canonical_measurement_id = r.i),
m AS (SELECT g, {', '.join(f'arg_min({c}, (suspect, -recent, i)) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in FIELDS)} FROM v GROUP BY g)
SELECT g AS group_id, b.i AS rec_id, CAST(b.filled AS INT) AS filled, CAST(b.suspect AS INT) AS suspect, CASE WHEN b.recent >= 0 THEN b.recent END AS recent, {', '.join(f'm.{c}' for c in FIELDS)} FROM b JOIN m USING (g) WHERE k = 1
""",
}
