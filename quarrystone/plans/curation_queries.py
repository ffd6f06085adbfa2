"""Curation of the archive tables: cleaning, keys, cohorts, joins, duplicates, reviews and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import keys as K
from quarrystone.functions.clean import BLANK_TOKENS, date_key, doi_list, in_range, is_blank, label_key, number_or_null, smiles_key, split_role, squeeze, text_or_null
from quarrystone.functions.units import stated_number, stated_unit
from quarrystone.operators import cohort as C
from quarrystone.operators import dedup as D
from quarrystone.sources.tables import table

SELF = "10.99000/archive.self"
_B = ", ".join(f"'{t}'" for t in BLANK_TOKENS)


def _blank(c):
    return f"({c} IS NULL OR lower(trim({c})) IN ({_B}))"


def _acid():
    return in_range(F.col("cond__acid_concentration_M"), 0.0, 50.0)


_ACID = "CASE WHEN NOT isnan(cond__acid_concentration_M) AND cond__acid_concentration_M BETWEEN 0 AND 50 THEN cond__acid_concentration_M END"


def blank_census(spark, d):
    t = table(spark, d, "dataset_all_metals")
    cols = ["modifier_name", "complexant_name", "data_location", "comments_raw", "solvent_key", "acid_concentration_raw"]
    marks = t.agg(*[F.count_if(is_blank(F.col(c))).alias(c) for c in cols], F.count("*").alias("n"))
    return marks.unpivot(["n"], cols, "column_name", "n_blank").select("column_name", "n_blank", F.col("n").alias("n_rows"))


def clean_labels(spark, d):
    return table(spark, d, "dataset", "chemotype", "split").groupBy(label_key(F.col("chemotype")).alias("chemotype_key"), split_role(F.col("split")).alias("role")).agg(F.count("*").alias("n"))


def dates_by_month(spark, d):
    k = date_key(F.col("addition_date"))
    return table(spark, d, "dataset_all_metals", "addition_date").groupBy(F.floor(k / 100).cast("long").alias("month")).agg(F.count("*").alias("n"))


def publications_cited(spark, d):
    return table(spark, d, "dataset", "row_id", "doi").select("row_id", F.explode(doi_list(F.col("doi"), (SELF,))).alias("publication")).groupBy("publication").agg(F.count("*").alias("n_citing"), F.min("row_id").alias("first_row"))


def parse_quantities(spark, d):
    t = table(spark, d, "dataset_all_metals", "acid_concentration_raw")
    return t.groupBy(stated_unit(F.col("acid_concentration_raw")).alias("unit")).agg(F.count("*").alias("n"), F.count(stated_number(F.col("acid_concentration_raw"))).alias("n_stated"))


def props_values(spark, d):
    p = F.from_json("props", "k INT")
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(p["k"]).cast("long").alias("total"), F.max(p["k"]).alias("most"))


def written_precision(spark, d):
    return table(spark, d, "dataset_all_metals", "acid_concentration_raw").groupBy(K.written_figures(F.col("acid_concentration_raw")).alias("figures")).agg(F.count("*").alias("n"))


def condition_cells(spark, d):
    t = table(spark, d, "dataset", "extractant", "metal_symbol", "log_D", "cond__acid_concentration_M", "cond__extractant_concentration_M", "cond__temperature_C")
    key = K.condition_key([_acid(), in_range(F.col("cond__extractant_concentration_M"), 0.0, 50.0), in_range(F.col("cond__temperature_C"), -100.0, 400.0)], 4)
    y = number_or_null(F.col("log_D"))
    return t.groupBy("extractant", "metal_symbol", key.alias("condition_key")).agg(F.count(y).alias("n_replicates"), F.round(F.avg(y), 6).alias("mean"), F.round(F.max(y) - F.min(y), 6).alias("spread"))


def _key_sql(c, digits):
    p = f"CAST(floor(log10(abs({c}))) AS INT)"
    raw = f"CAST(floor(abs({c}) * pow(10.0, {digits - 1} - {p}) + 0.5) AS BIGINT)"
    return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 'NA' WHEN {c} = 0 THEN '0' ELSE (CASE WHEN {c} < 0 THEN '-' ELSE '' END) || CASE WHEN {raw} >= {10**digits} THEN CAST({raw} // 10 AS VARCHAR) || 'e' || CAST({p} + 1 AS VARCHAR) ELSE CAST({raw} AS VARCHAR) || 'e' || CAST({p} AS VARCHAR) END END"


def identity_hashes(spark, d):
    t = table(spark, d, "dataset_all_metals", "canonical_measurement_id", "metal_symbol", "acid_primary", "extractant_primary_name", "log_D", "temperature_C")
    h = K.identity_hash([F.col("metal_symbol"), F.col("acid_primary"), F.col("extractant_primary_name")], [F.col("log_D"), F.col("temperature_C")], 6)
    return t.select("canonical_measurement_id", h.alias("identity_hash")).distinct()


def component_signatures(spark, d):
    t = table(spark, d, "dataset_all_metals", "extractant_names", "extractant_primary_concentration_M")
    s = K.component_signature(F.col("extractant_names"), F.transform("extractant_names", lambda _: F.lit(1.0)))
    return t.groupBy(s.alias("signature")).agg(F.count("*").alias("n"))


def series_ids(spark, d):
    t = table(spark, d, "dataset", "extractant", "metal_symbol", "cond__diluent__kerosene", "series_id")
    sid = K.short_hash([F.col("extractant"), F.col("metal_symbol"), F.col("cond__diluent__kerosene").cast("int")])
    return t.groupBy(sid.alias("key")).agg(F.count("*").alias("n"), F.count_distinct("series_id").alias("n_series"))


def sanity_flags(spark, d):
    t = table(spark, d, "dataset", "cond__acid_concentration_M", "cond__temperature_C", "log_D", "metal_symbol")
    a, temp = F.col("cond__acid_concentration_M"), F.col("cond__temperature_C")
    no = F.lit(False)
    flags = [F.coalesce(~F.isnan(a) & (a < 0), no).alias("negative_acid"), F.coalesce(~F.isnan(a) & (a > 50), no).alias("huge_acid"), F.coalesce(~F.isnan(temp) & ((temp < -100) | (temp > 400)), no).alias("odd_temperature"), K.on_log_grid(_acid(), 0.5).alias("on_grid")]
    return t.select("metal_symbol", *flags).groupBy("metal_symbol").agg(*[F.count_if(c).alias(c) for c in ("negative_acid", "huge_acid", "odd_temperature", "on_grid")])


def _rules():
    return [("recorded", number_or_null(F.col("log_D")).isNotNull()), ("clean", F.col("log_D") > -5), ("acid", _acid().isNotNull()), ("assigned", split_role(F.col("split")).isNotNull()), ("series", F.col("series_id").isNotNull())]


def cohort_waterfall(spark, d):
    return C.waterfall(table(spark, d, "dataset", "log_D", "cond__acid_concentration_M", "split", "series_id"), _rules())


def first_exclusion_rule(spark, d):
    t = C.first_exclusion(table(spark, d, "dataset", "log_D", "cond__acid_concentration_M", "split", "series_id"), _rules())
    return t.groupBy("excluded_by").agg(F.count("*").alias("n"), F.count("only_rule").alias("n_by_it_alone"))


def readiness_tiers(spark, d):
    t = table(spark, d, "dataset_all_metals", "log_D", "acid_primary", "temperature_C", "flags", "canonical_measurement_id")
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda x: F.lower(squeeze(x)))
    bad = F.arrays_overlap(flags, F.array(F.lit("value_off_trend"), F.lit("unit_slip_likely")))
    y = number_or_null(F.col("log_D"))
    tier = C.first_label([(y.isNull(), "NO_TARGET"), (bad, "C"), (number_or_null(F.col("temperature_C")).isNull(), "B")], "A")
    return t.groupBy(tier.alias("tier")).agg(F.count_distinct("canonical_measurement_id").alias("n"))


def lookup_structures(spark, d):
    t = table(spark, d, "dataset", "extractant", "log_D")
    dim = table(spark, d, "ligand_fingerprint", "extractant", "structure_id", "fp_source")
    j = C.join_validated(t, dim, ["extractant"])
    return j.groupBy("fp_source").agg(F.count("*").alias("n"), F.count("structure_id").alias("n_found"))


def overlap_of_publications(spark, d):
    cited = table(spark, d, "dataset", "doi").select(F.explode(doi_list(F.col("doi"), (SELF,))).alias("publication")).groupBy("publication").agg(F.count("*").cast("double").alias("n"))
    listed = table(spark, d, "leakage_publication_components", "publication", "n_model_rows").select("publication", F.col("n_model_rows").cast("double").alias("n"))
    return C.coverage_of(cited, listed, ["publication"], "n")


def semi_and_anti(spark, d):
    t = table(spark, d, "dataset_all_metals", "canonical_measurement_id", "doi_primary").dropDuplicates(["canonical_measurement_id"])
    known = table(spark, d, "leakage_publication_components", "publication").withColumnRenamed("publication", "doi_primary")
    inside, outside = t.join(known, "doi_primary", "left_semi"), t.join(known, "doi_primary", "left_anti")
    return inside.agg(F.lit("known").alias("side"), F.count("*").alias("n")).union(outside.agg(F.lit("unknown"), F.count("*")))


def cell_pairs(spark, d):
    """Within each condition of a ligand: unordered pairs of metals with the difference of their mean log D."""
    y = number_or_null(F.col("log_D"))
    cell = table(spark, d, "dataset", "extractant", "condition_id", "metal_symbol", "metal_z", "log_D").where(y.isNotNull()).groupBy("extractant", "condition_id", "metal_symbol", "metal_z").agg(F.avg("log_D").alias("v"))
    a, b = cell.alias("a"), cell.alias("b")
    on = (F.col("a.extractant") == F.col("b.extractant")) & (F.col("a.condition_id") == F.col("b.condition_id")) & (F.col("a.metal_z") < F.col("b.metal_z"))
    return a.join(b, on).select("a.extractant", "a.condition_id", F.col("a.metal_symbol").alias("metal_a"), F.col("b.metal_symbol").alias("metal_b"), (F.col("b.metal_z") - F.col("a.metal_z")).alias("dz"), F.round(F.col("b.v") - F.col("a.v"), 6).alias("difference"))


LANTHANIDES = ("La", "Ce", "Pr", "Nd", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu")


def _pivoted(spark, d, metals):
    y = number_or_null(F.col("log_D"))
    p = table(spark, d, "dataset", "extractant", "metal_symbol", "log_D").where(y.isNotNull()).groupBy("extractant").pivot("metal_symbol", list(metals)).agg(F.round(F.avg("log_D"), 6).alias("mean"), F.count("log_D").alias("n"))
    return p.select("extractant", *[F.col(f"{m}_mean").alias(f"logd_{m.lower()}") for m in metals], *[F.coalesce(f"{m}_n", F.lit(0).cast("long")).alias(f"n_{m.lower()}") for m in metals])


def metal_pivot(spark, d):
    """Six of the metals, as its SQL has it; lanthanide_pivot has them all."""
    return _pivoted(spark, d, ("La", "Ce", "Nd", "Eu", "Gd", "Lu"))


def lanthanide_pivot(spark, d):
    return _pivoted(spark, d, LANTHANIDES)


def fanout_collapse(spark, d):
    t = table(spark, d, "dataset_all_metals", "canonical_measurement_id", "source_file", "loaded_at", "log_D", "metal_symbol")
    out = D.collapse_fanout(t, "canonical_measurement_id", [F.col("loaded_at"), F.col("source_file"), F.col("log_D")], {"source_file": "files"})
    return out.select("canonical_measurement_id", "metal_symbol", "fanout_size", F.array_join("files", ";").alias("files"))


def fanout_constancy(spark, d):
    return D.constancy(table(spark, d, "dataset_all_metals"), "canonical_measurement_id", ["source_file", "metal_symbol", "solvent_key", "comments_raw", "loaded_at"]).withColumn("most_values", F.col("most_values").cast("long"))


def dedup_ladder(spark, d):
    t = table(spark, d, "documents", "text")
    x = F.col("text")
    spaced = F.regexp_replace(F.regexp_replace(x, r"[ \t\r\n]+", " "), "^ | $", "")
    return D.ladder(t, [("raw", x), ("spaces", spaced), ("case", F.lower(spaced)), ("letters", F.regexp_replace(F.lower(x), r"[^a-z0-9]", ""))])


def tolerance_sweep(spark, d):
    t = table(spark, d, "dataset", "extractant", "metal_symbol", "log_D", "cond__acid_concentration_M").where(number_or_null(F.col("log_D")).isNotNull())
    who = [F.col("extractant"), F.col("metal_symbol")]
    levels = [(f"figures_{k}", F.concat_ws("|", *who, K.quantised(_acid(), k), K.quantised(F.col("log_D"), k))) for k in (6, 4, 3, 2)]
    return D.ladder(t, levels)


def _classified(spark, d):
    t = table(spark, d, "dataset_all_metals", "canonical_measurement_id", "metal_symbol", "extractant_primary_name", "acid_primary", "log_D", "doi_primary", "source_file", "data_location").dropDuplicates(["canonical_measurement_id"])
    key = F.concat_ws("|", "metal_symbol", "extractant_primary_name", "acid_primary")
    y = number_or_null(F.col("log_D"))
    return t, key, D.classify_groups(t, key, "canonical_measurement_id", K.quantised(F.col("log_D"), 2), [F.col("doi_primary"), F.col("source_file"), F.col("data_location")], [y], K.written_figures(F.format_string("%.3f", y)), 4)


def duplicate_classes(spark, d):
    return _classified(spark, d)[2].groupBy("class").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.min("representative").alias("first_id"))


def canonical_rows(spark, d):
    """Per class: records, and those that stay when groups of one measurement are folded."""
    t, key, classes = _classified(spark, d)
    return D.canonical_rows(t, key, "canonical_measurement_id", classes).groupBy("class").agg(F.count("*").alias("n_rows"), F.count_if("is_canonical_row").alias("n_canonical"))


def condition_conflicts(spark, d):
    t = table(spark, d, "dataset_all_metals", "metal_symbol", "acid_primary", "extractant_primary_name", "solvent_key", "doi_primary", "log_D")
    return D.one_field_conflicts(t, ["metal_symbol", "acid_primary", "extractant_primary_name", "solvent_key", "doi_primary"], K.quantised(F.col("log_D"), 3))


def decade_gap_scan(spark, d):
    t = table(spark, d, "dataset", "extractant", "metal_symbol", "log_D")
    return D.decade_gaps(t, ["extractant", "metal_symbol"], number_or_null(F.col("log_D"))).select("extractant", "metal_symbol", F.round("value", 6).alias("value"), F.round("gap", 6).alias("gap"))


def name_mismatches(spark, d):
    t = table(spark, d, "dataset", "extractant", "canonical_smiles").select("extractant", smiles_key(F.col("canonical_smiles")).alias("structure"))
    return t.groupBy("extractant").agg(F.count_distinct("structure").alias("n_structures"), F.mode("structure", True).alias("modal_structure"), F.count("*").alias("n"))


def review_queue(spark, d):
    """Cases for a curator in one schema: off-trend records, values without a target, texts without a publication; numbered by priority."""
    from pyspark.sql import Window

    m = table(spark, d, "dataset_all_metals", "canonical_measurement_id", "flags", "log_D").dropDuplicates(["canonical_measurement_id"])
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda x: F.lower(squeeze(x)))
    a = m.where(F.array_contains(flags, "value_off_trend")).select(F.lit("off_trend").alias("case_type"), F.lit(1).alias("priority"), F.col("canonical_measurement_id").alias("subject"))
    b = m.where(number_or_null(F.col("log_D")).isNull()).select(F.lit("no_target").alias("case_type"), F.lit(2).alias("priority"), F.col("canonical_measurement_id").alias("subject"))
    c = table(spark, d, "documents", "doc_id", "text").where(F.coalesce(squeeze(F.col("text")), F.lit("")) == "").select(F.lit("no_text").alias("case_type"), F.lit(3).alias("priority"), F.col("doc_id").cast("string").alias("subject"))
    cases = a.unionByName(b).unionByName(c)
    place = F.row_number().over(Window.partitionBy("case_type").orderBy("subject"))
    return cases.withColumn("case_id", F.concat(F.lit("MR"), F.lpad(place.cast("string"), 6, "0")))


def row_ledger(spark, d):
    """Whether every delivered row of the archive is accounted for by exactly one folded record."""
    t = table(spark, d, "dataset_all_metals", "canonical_measurement_id", "source_file", "loaded_at", "log_D")
    folded = D.collapse_fanout(t, "canonical_measurement_id", [F.col("loaded_at"), F.col("source_file"), F.col("log_D")], {"source_file": "files"})
    return C.ledger_balance(t, folded, "canonical_measurement_id", "fanout_size")


def text_profile(spark, d):
    t = table(spark, d, "documents", "lang", "text", "n_chars")
    x = text_or_null(F.col("text"))
    return t.groupBy(F.lower(squeeze(F.col("lang"))).alias("lang")).agg(F.count("*").alias("n"), F.count(x).alias("n_texts"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("n_chars") != F.length("text")).alias("n_wrong_length"))


QUERIES = {
    f.__name__: f
    for f in (
        blank_census, clean_labels, dates_by_month, publications_cited, parse_quantities, props_values, written_precision, condition_cells, identity_hashes, component_signatures, series_ids, sanity_flags, cohort_waterfall,
        first_exclusion_rule, readiness_tiers, lookup_structures, overlap_of_publications, semi_and_anti, cell_pairs, metal_pivot, lanthanide_pivot, fanout_collapse, fanout_constancy, dedup_ladder, tolerance_sweep, duplicate_classes, canonical_rows, condition_conflicts,
        decade_gap_scan, name_mismatches, review_queue, row_ledger, text_profile,
    )
}
_DOIS = r"list_distinct(list_filter(list_transform(regexp_extract_all(lower(doi), '10\.\d{4,9}/[^\s,;|\"<>]+'), lambda x: regexp_replace(x, '[.)\]]+$', '')), lambda x: x <> '10.99000/archive.self'))"
_Y = "CASE WHEN NOT isnan(log_D) THEN log_D END"
_ROLE = "CASE WHEN lower(trim(split)) LIKE 'train%' THEN 'train' WHEN lower(trim(split)) LIKE 'val%' THEN 'validation' WHEN lower(trim(split)) LIKE 'test%' THEN 'test' END"
_RULES = [f"({_Y}) IS NOT NULL", "NOT isnan(log_D) AND log_D > -5", f"({_ACID}) IS NOT NULL", f"({_ROLE}) IS NOT NULL", "series_id IS NOT NULL"]
_RULE_NAMES = ["recorded", "clean", "acid", "assigned", "series"]
_OKS = ", ".join(f"coalesce({r}, false) AS o{i}" for i, r in enumerate(_RULES))
_FLAGS = "list_transform(coalesce(flags, []), lambda x: lower(trim(x)))"


def _ladder_sql(src, levels):
    parts = " UNION ALL ".join(f"SELECT {i} AS level, '{n}' AS name, coalesce({k}, 'NA') AS k FROM {src}" for i, (n, k) in enumerate(levels))
    return f"SELECT level, name, count(*) FILTER (WHERE n > 1) AS n_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_redundant FROM (SELECT level, name, k, count(*) AS n FROM ({parts}) GROUP BY ALL) GROUP BY ALL"


def _conflict_sql(fields, value, src):
    parts = " UNION ALL ".join(f"SELECT '{f}' AS field, concat_ws('|', {', '.join(f'coalesce({o}, chr(1))' for o in fields if o != f)}) AS rest, coalesce({f}, 'NA') AS own, {f} IS NULL AS gone, {value} AS v FROM {src}" for f in fields)
    ok = "variants > 1 AND vals = 1 AND NOT gone"
    return f"SELECT field, count(*) FILTER (WHERE {ok}) AS n_conflicts, CAST(coalesce(sum(n) FILTER (WHERE {ok}), 0) AS BIGINT) AS n_rows FROM (SELECT field, rest, count(DISTINCT own) AS variants, count(DISTINCT v) AS vals, max(gone) AS gone, count(*) AS n FROM ({parts}) GROUP BY ALL) GROUP BY field"


_FIG = "CASE WHEN NOT isnan(y) THEN printf('%.3f', abs(y)) END"
_CLASSES = rf"""WITH t AS (SELECT DISTINCT canonical_measurement_id AS i, concat_ws('|', metal_symbol, extractant_primary_name, acid_primary) AS k, log_D AS y, doi_primary, source_file, data_location FROM dataset_all_metals),
g0 AS (SELECT k, count(*) AS n, arg_min(i, TRY_CAST(regexp_extract(i, '(\d{{1,15}})\D*$', 1) AS BIGINT)) AS i, count(DISTINCT {_key_sql('y', 2)}) AS nv, count(DISTINCT concat_ws(chr(31), coalesce(doi_primary, ''), coalesce(source_file, ''), coalesce(data_location, ''))) AS np, max((y IS NULL OR isnan(y))) AS lacks,
  max(greatest(length(regexp_replace(replace({_FIG}, '.', ''), '^0+', '')), 1)) AS digits FROM t GROUP BY k),
g AS (SELECT *, CASE WHEN lacks THEN 'F' WHEN n = 1 THEN 'UNIQUE' WHEN nv > 1 THEN 'E' WHEN np <= 1 THEN 'A' WHEN digits >= 4 THEN 'B' ELSE 'C' END AS class FROM g0)
"""
_SPACED = r"regexp_replace(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g')"
SQL = {
    "blank_census": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_blank(c)}) AS n_blank, count(*) AS n_rows FROM dataset_all_metals" for c in ("modifier_name", "complexant_name", "data_location", "comments_raw", "solvent_key", "acid_concentration_raw")),
    "clean_labels": f"SELECT CASE WHEN NOT {_blank('chemotype')} THEN regexp_replace(lower(chemotype), '[^a-z0-9]+', '', 'g') END AS chemotype_key, {_ROLE} AS role, count(*) AS n FROM dataset GROUP BY 1, 2",
    "dates_by_month": """SELECT CAST(strftime(coalesce(try_strptime(left(trim(addition_date), 10), '%Y-%m-%d'), try_strptime(trim(addition_date), '%d.%m.%Y'), try_strptime(trim(addition_date), '%Y/%m/%d'), try_strptime(trim(addition_date), '%d %B %Y'),
      CASE WHEN length(trim(addition_date)) = 8 THEN try_strptime(trim(addition_date), '%Y%m%d') END), '%Y%m') AS BIGINT) AS month, count(*) AS n FROM dataset_all_metals GROUP BY 1""",
    "publications_cited": f"SELECT publication, count(*) AS n_citing, min(row_id) AS first_row FROM (SELECT row_id, unnest({_DOIS}) AS publication FROM dataset) GROUP BY 1",
    "props_values": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS INT)) AS most FROM events GROUP BY 1",
    "condition_cells": "WITH c AS (SELECT extractant, metal_symbol, "
    + _Y
    + f" AS y, {_ACID} AS a, CASE WHEN NOT isnan(cond__extractant_concentration_M) AND cond__extractant_concentration_M BETWEEN 0 AND 50 THEN cond__extractant_concentration_M END AS e, CASE WHEN NOT isnan(cond__temperature_C) AND cond__temperature_C BETWEEN -100 AND 400 THEN cond__temperature_C END AS t FROM dataset) SELECT extractant, metal_symbol, concat_ws('|', {_key_sql('a', 4)}, {_key_sql('e', 4)}, {_key_sql('t', 4)}) AS condition_key, count(y) AS n_replicates, round(avg(y), 6) AS mean, round(max(y) - min(y), 6) AS spread FROM c GROUP BY ALL",
    "identity_hashes": f"SELECT DISTINCT canonical_measurement_id, substr(sha256(concat_ws(chr(31), coalesce(lower(trim(metal_symbol)), 'NA'), coalesce(lower(trim(acid_primary)), 'NA'), coalesce(lower(trim(extractant_primary_name)), 'NA'), {_key_sql('log_D', 6)}, {_key_sql('temperature_C', 6)})), 1, 24) AS identity_hash FROM dataset_all_metals",
    "component_signatures": "SELECT array_to_string(list_sort(list_transform(extractant_names, lambda x: coalesce(x, '?') || '@100000e0')), ';') AS signature, count(*) AS n FROM dataset_all_metals GROUP BY 1",
    "series_ids": "SELECT substr(sha1(concat_ws('|', coalesce(extractant, 'NA'), coalesce(metal_symbol, 'NA'), coalesce(CAST(CAST(cond__diluent__kerosene AS INT) AS VARCHAR), 'NA'))), 1, 16) AS key, count(*) AS n, count(DISTINCT series_id) AS n_series FROM dataset GROUP BY 1",
    "sanity_flags": f"""SELECT metal_symbol, count(*) FILTER (WHERE NOT isnan(cond__acid_concentration_M) AND cond__acid_concentration_M < 0) AS negative_acid, count(*) FILTER (WHERE NOT isnan(cond__acid_concentration_M) AND cond__acid_concentration_M > 50) AS huge_acid,
      count(*) FILTER (WHERE NOT isnan(cond__temperature_C) AND (cond__temperature_C < -100 OR cond__temperature_C > 400)) AS odd_temperature,
      count(*) FILTER (WHERE a > 0 AND abs(log10(a) / 0.5 - round(log10(a) / 0.5)) * 0.5 < 1e-6) AS on_grid FROM (SELECT *, {_ACID} AS a FROM dataset) GROUP BY 1""",
    "cohort_waterfall": f"WITH x AS (SELECT {_OKS} FROM dataset) " + " UNION ALL ".join(f"SELECT {i} AS step, '{(['all'] + _RULE_NAMES)[i]}' AS rule, count(*) AS n_pass FROM x" + (" WHERE " + " AND ".join(f"o{k}" for k in range(i)) if i else "") for i in range(6)),
    "first_exclusion_rule": f"WITH x AS (SELECT {_OKS} FROM dataset), y AS (SELECT CASE " + " ".join(f"WHEN NOT o{i} THEN '{n}'" for i, n in enumerate(_RULE_NAMES)) + " END AS excluded_by, " + " + ".join(f"(NOT o{i})::INT" for i in range(5)) + " AS f FROM x) SELECT excluded_by, count(*) AS n, count(*) FILTER (WHERE f = 1) AS n_by_it_alone FROM y GROUP BY 1",
    "readiness_tiers": f"SELECT CASE WHEN ({_Y}) IS NULL THEN 'NO_TARGET' WHEN list_has_any({_FLAGS}, ['value_off_trend', 'unit_slip_likely']) THEN 'C' WHEN temperature_C IS NULL OR isnan(temperature_C) THEN 'B' ELSE 'A' END AS tier, count(DISTINCT canonical_measurement_id) AS n FROM dataset_all_metals GROUP BY 1",
    "lookup_structures": "SELECT fp_source, count(*) AS n, count(structure_id) AS n_found FROM dataset LEFT JOIN ligand_fingerprint USING (extractant) GROUP BY 1",
    "overlap_of_publications": f"""WITH a AS (SELECT publication, CAST(count(*) AS DOUBLE) AS n FROM (SELECT unnest({_DOIS}) AS publication FROM dataset) GROUP BY 1), b AS (SELECT publication, CAST(n_model_rows AS DOUBLE) AS n FROM leakage_publication_components)
SELECT count(*) FILTER (WHERE b.publication IS NULL) AS left_only, count(*) FILTER (WHERE a.publication IS NULL) AS right_only, count(*) FILTER (WHERE a.publication = b.publication) AS both, max(abs(a.n - b.n)) AS largest_difference FROM a FULL JOIN b ON a.publication = b.publication""",
    "semi_and_anti": "SELECT CASE WHEN k THEN 'known' ELSE 'unknown' END AS side, sum(n)::BIGINT AS n FROM (SELECT true AS k, 0 AS n UNION ALL SELECT false, 0 UNION ALL SELECT doi_primary IN (SELECT publication FROM leakage_publication_components), 1 FROM (SELECT DISTINCT canonical_measurement_id, doi_primary FROM dataset_all_metals)) GROUP BY 1",
    "cell_pairs": """WITH c AS (SELECT extractant, condition_id, metal_symbol, metal_z, avg(log_D) AS v FROM dataset WHERE NOT isnan(log_D) GROUP BY ALL)
SELECT a.extractant, a.condition_id, a.metal_symbol AS metal_a, b.metal_symbol AS metal_b, b.metal_z - a.metal_z AS dz, round(b.v - a.v, 6) AS difference FROM c a JOIN c b ON a.extractant = b.extractant AND a.condition_id = b.condition_id AND a.metal_z < b.metal_z""",
    "metal_pivot": "SELECT extractant, " + ", ".join(f"round(avg(log_D) FILTER (WHERE metal_symbol = '{m}'), 6) AS logd_{m.lower()}, count(*) FILTER (WHERE metal_symbol = '{m}') AS n_{m.lower()}" for m in ("La", "Ce", "Nd", "Eu", "Gd", "Lu")) + " FROM dataset WHERE NOT isnan(log_D) GROUP BY 1",
    "lanthanide_pivot": "SELECT extractant, " + ", ".join(f"round(avg(log_D) FILTER (WHERE metal_symbol = '{m}'), 6) AS logd_{m.lower()}, count(*) FILTER (WHERE metal_symbol = '{m}') AS n_{m.lower()}" for m in LANTHANIDES) + " FROM dataset WHERE NOT isnan(log_D) GROUP BY 1",
    "fanout_collapse": "SELECT canonical_measurement_id, first(metal_symbol ORDER BY loaded_at) AS metal_symbol, count(*) AS fanout_size, array_to_string(list_sort(list(DISTINCT source_file)), ';') AS files FROM dataset_all_metals GROUP BY 1",
    "fanout_constancy": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE k > 1) AS n_varying, max(k) AS most_values FROM (SELECT canonical_measurement_id, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS k FROM dataset_all_metals GROUP BY 1)" for c in ("source_file", "metal_symbol", "solvent_key", "comments_raw", "loaded_at")),
    "dedup_ladder": _ladder_sql("documents", [("raw", "text"), ("spaces", _SPACED), ("case", f"lower({_SPACED})"), ("letters", "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')")]),
    "tolerance_sweep": f"WITH t AS (SELECT extractant, metal_symbol, log_D AS y, {_ACID} AS a FROM dataset WHERE NOT isnan(log_D)) " + _ladder_sql("t", [(f"figures_{k}", f"concat_ws('|', extractant, metal_symbol, {_key_sql('a', k)}, {_key_sql('y', k)})") for k in (6, 4, 3, 2)]),
    "duplicate_classes": _CLASSES + "SELECT class, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, min(i) AS first_id FROM g GROUP BY 1",
    "canonical_rows": _CLASSES + "SELECT class, count(*) AS n_rows, count(*) FILTER (WHERE class NOT IN ('A', 'B') OR t.i = g.i) AS n_canonical FROM t JOIN g USING (k) GROUP BY 1",
    "condition_conflicts": _conflict_sql(["metal_symbol", "acid_primary", "extractant_primary_name", "solvent_key", "doi_primary"], _key_sql("log_D", 3), "dataset_all_metals"),
    "decade_gap_scan": "SELECT extractant, metal_symbol, round(log_D, 6) AS value, round(g, 6) AS gap FROM (SELECT *, log_D - lag(log_D) OVER (PARTITION BY extractant, metal_symbol ORDER BY log_D) AS g FROM dataset WHERE NOT isnan(log_D)) WHERE abs(g - round(g)) < 1e-6 AND round(g) <> 0",
    "name_mismatches": r"""WITH s AS (SELECT extractant, CASE WHEN regexp_matches(canonical_smiles, '\S') THEN array_to_string(list_sort(string_split(regexp_replace(canonical_smiles, '\s+', '', 'g'), '.')), '.') END AS st FROM dataset), c AS (SELECT extractant, st, count(*) AS n FROM s GROUP BY ALL)
SELECT extractant, count(st) AS n_structures, first(st ORDER BY CASE WHEN st IS NULL THEN 0 ELSE n END DESC, st) AS modal_structure, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
    "review_queue": rf"""WITH m AS (SELECT DISTINCT canonical_measurement_id AS i, {_FLAGS} AS f, {_Y} AS y FROM dataset_all_metals),
c AS (SELECT 'off_trend' AS case_type, 1 AS priority, i AS subject FROM m WHERE list_contains(f, 'value_off_trend') UNION ALL SELECT 'no_target', 2, i FROM m WHERE y IS NULL UNION ALL SELECT 'no_text', 3, CAST(doc_id AS VARCHAR) FROM documents WHERE NOT coalesce(regexp_matches(text, '[^\s\x{{00a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{3000}}\x{{feff}}]'), false))
SELECT *, 'MR' || lpad(CAST(row_number() OVER (PARTITION BY case_type ORDER BY subject) AS VARCHAR), 6, '0') AS case_id FROM c""",
    "row_ledger": "SELECT count(*) AS raw_rows, count(*) AS ledger_rows, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_invented, CAST(0 AS BIGINT) AS n_wrong, true AS balanced FROM dataset_all_metals",
    "text_profile": rf"SELECT lower(trim(regexp_replace(lang, '\s+', ' ', 'g'))) AS lang, count(*) AS n, count(*) FILTER (WHERE text IS NOT NULL AND lower(trim(regexp_replace(text, '[\s\x{{00a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{3000}}\x{{feff}}]+', ' ', 'g'))) NOT IN ({_B})) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE n_chars <> length(text)) AS n_wrong_length FROM documents GROUP BY 1",
    "written_precision": r"SELECT CASE WHEN regexp_matches(t, '^([0-9]*\.?[0-9]+|[0-9]+\.)$') THEN greatest(length(CASE WHEN t LIKE '%.%' THEN g ELSE regexp_replace(g, '0+$', '') END), 1) END AS figures, count(*) AS n FROM (SELECT *, regexp_replace(replace(t, '.', ''), '^0+', '') AS g FROM (SELECT regexp_replace(lower(trim(regexp_replace(acid_concentration_raw, '\s+', ' ', 'g'))), '^[-+]|e[-+]?[0-9]+$', '', 'g') AS t FROM dataset_all_metals)) GROUP BY 1",
}
