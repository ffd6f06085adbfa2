"""Problem 7: quantities recorded in different units."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.clean import number_or_null
from quarrystone.functions.units import MICROGRAMS, MICROMOLES, SPELLINGS, micromolar, noted_unit, significant, stated_number, stated_unit
from quarrystone.operators.unit_hmm import decode_units
from quarrystone.sources.tables import table

# What a comment's note must mention to speak of the acid, of the extractant or of the metal.
ACID, LIGAND, METAL = r"acid|säure|\bhx\b", r"extract|ligand|extraktionsmittel", r"metal"


def _records(spark, d):
    """One row per record and field: the number, and each piece of evidence for its unit."""
    known = table(spark, d, "source_units").select(F.col("source_file").alias("device"), "field_name", F.col("unit").alias("file_unit")).dropDuplicates(["device", "field_name"])
    masses = table(spark, d, "species_mass").select("kind", F.col("species").alias("of"), F.col("molar_mass")).dropDuplicates(["kind", "of"])
    ligands = table(spark, d, "ligand_catalog").select(F.col("name").alias("of"), "molar_mass").dropDuplicates(["of"])

    def part(df, record, field, column_unit, raw, comment, subject, of, mass):
        stated = stated_number(F.col(raw))
        recorded = number_or_null(F.col(field))
        rows = df.select(
            F.col(record).alias("record_id"), F.lit(field).alias("field_name"), F.col("source_file").alias("device"), F.coalesce(recorded, stated).alias("value"), recorded.isNull().alias("unrecorded"),
            F.lit(column_unit).alias("column_unit"), stated_unit(F.col(raw)).alias("value_unit"), noted_unit(F.col(comment), subject).alias("comment_unit"), F.col(of).alias("of"),
        )
        return rows.where(F.col("value").isNotNull()).join(mass, "of", "left").join(known, ["device", "field_name"], "left")

    curated = table(spark, d, "dataset_all_metals")
    process = table(spark, d, "corpus_records")
    species = lambda kind: masses.where(F.col("kind") == kind).drop("kind")
    return (
        part(curated, "canonical_measurement_id", "acid_concentration_M", "M", "acid_concentration_raw", "comments_raw", ACID, "acid_primary", species("acid"))
        .unionByName(part(curated, "canonical_measurement_id", "extractant_primary_concentration_M", "M", "extractant_concentration_raw", "comments_raw", LIGAND, "extractant_primary_name", ligands))
        .unionByName(part(process, "record_id", "metal_initial_mM", "mM", "metal_initial_text", "comments", METAL, "metal", species("metal")))
    )


def _decoded(spark, d):
    return decode_units(_records(spark, d), keep=("unrecorded",))


def _same(a, b):
    """Whether two units give a quantity the same number."""
    scale = lambda u: F.coalesce(*[F.when(u == k, F.lit(v)) for k, v in MICROMOLES.items()])
    return F.coalesce(a == b, F.lit(False)) | F.coalesce(scale(a) == scale(b), F.lit(False))


def p7_found(spark, d):
    """Numbers that are not in their column's unit, and stated quantities whose number is missing."""
    out = _decoded(spark, d).where(F.col("unrecorded") | ~_same(F.col("unit"), F.col("column_unit")))
    um = significant(micromolar(F.col("value"), F.col("unit"), F.col("molar_mass")), 2)
    return out.select("record_id", "field_name", F.round(um).cast("long").alias("value_um")).where(F.col("value_um").isNotNull()).distinct()


def p7_units(spark, d):
    """How many records of each field were written in each unit."""
    return _decoded(spark, d).groupBy("field_name", "unit").agg(F.count_distinct("record_id").alias("n_records"))


def p7_recovered(spark, d):
    """How well the model finds units that it is not told: comment and file unit are hidden on a tenth of the records (drawn by hash) that state none at the value.

    All records are decoded; per field the hidden records, those whose unit comes out right, and the same for records whose unit is not their file's.
    """
    records = _records(spark, d)
    hide = F.col("value_unit").isNull() & (F.crc32("record_id") % 10 == 0)
    told = F.coalesce("comment_unit", "file_unit")
    asked = records.withColumn("told", F.when(hide, told)).withColumn("other", hide & ~_same(told, F.col("file_unit")))
    asked = asked.withColumn("comment_unit", F.when(~hide, F.col("comment_unit"))).withColumn("file_unit", F.when(~hide, F.col("file_unit")))
    out = decode_units(asked, keep=("told", "other")).where("told IS NOT NULL")
    right = _same(F.col("unit"), F.col("told"))
    return out.groupBy("field_name").agg(
        F.count("*").alias("n_hidden"), F.count_if(right).alias("n_right"), F.round(F.avg(right.cast("double")), 6).alias("recall"), F.count_if("other").alias("n_unlike_file"), F.count_if(F.col("other") & right).alias("n_unlike_file_right")
    )


def p7_contradicted(spark, d):
    """Per field and unit: the records, and those whose number lies a decade or more off their file's level in the unit they state and closer in another."""
    return _decoded(spark, d).groupBy("field_name", "unit").agg(F.count_distinct("record_id").alias("n_records"), F.count_distinct(F.when(F.col("contradicts"), F.col("record_id"))).alias("n_contradicted"))


QUERIES = {"p7_found": p7_found, "p7_units": p7_units, "p7_recovered": p7_recovered, "p7_contradicted": p7_contradicted}


def _packed(c):
    return f"regexp_replace(translate(lower({c}), '⁻−¹²³µμ', '--123uu'), '[\\s ·⋅]+', '', 'g')"


_NUMBER = r"^(?:~|≈|ca\.?|c=|approx\.?|about)*([-+]?\d+(?:[.,]\d+)?)(?:[x×*]10\^?([-+]?\d+)|e([-+]?\d+))?(.*)$"


def _unit(c):
    whens = " ".join(f"WHEN replace({c}, '^', '') IN ({', '.join(repr(x) for x in names)}) THEN '{unit}'" for unit, names in SPELLINGS.items())
    return f"CASE {whens} END"


def _part(table_, record, field, column_unit, raw, comment, subject, of, masses):
    any_ = "|".join(sorted((x for names in SPELLINGS.values() for x in names), key=len, reverse=True))
    group = lambda i: f"regexp_extract({_packed(raw)}, '{_NUMBER}', {i})"
    note = f"list_transform(list_filter(string_split(lower({comment}), ';'), lambda x: regexp_matches(x, '{subject}')), lambda x: regexp_extract(replace({_packed('x')}, '^', ''), '({any_})\\.?$', 1))"
    blank = f"({raw} IS NULL OR lower(trim({raw})) IN ('', '-', '- -', 'n/a', '?', 'none', 'nan'))"
    return f"""SELECT {record} AS record_id, '{field}' AS field_name, '{column_unit}' AS column_unit, CASE WHEN NOT isnan({field}) THEN {field} END AS v,
  CASE WHEN NOT {blank} THEN TRY_CAST(replace({group(1)}, ',', '.') || CASE WHEN {group(2)} || {group(3)} <> '' THEN 'e' || {group(2)} || {group(3)} ELSE '' END AS DOUBLE) END AS stated,
  coalesce({_unit(group(4))}, {_unit(f"list_last(list_filter({note}, lambda u: u <> ''))")}, s.unit) AS unit, k.molar_mass AS mass
FROM {table_} t LEFT JOIN source_units s ON s.source_file = t.source_file AND s.field_name = '{field}' LEFT JOIN ({masses}) k ON k.of = t.{of}"""


_UM = "CASE " + " ".join(f"WHEN unit = '{u}' THEN x * {f}" for u, f in MICROMOLES.items()) + " " + " ".join(f"WHEN unit = '{u}' THEN x * {f} / mass" for u, f in MICROGRAMS.items()) + " END"
_SCALE = "CASE u WHEN " + " WHEN ".join(f"'{u}' THEN {f}" for u, f in MICROMOLES.items()) + " END"
_PARTS = "WITH p AS (\n" + "\nUNION ALL\n".join(
        (
            _part("dataset_all_metals", "canonical_measurement_id", "acid_concentration_M", "M", "acid_concentration_raw", "comments_raw", ACID, "acid_primary", "SELECT species AS of, molar_mass FROM species_mass WHERE kind = 'acid'"),
            _part("dataset_all_metals", "canonical_measurement_id", "extractant_primary_concentration_M", "M", "extractant_concentration_raw", "comments_raw", LIGAND, "extractant_primary_name", "SELECT name AS of, molar_mass FROM ligand_catalog"),
            _part("corpus_records", "record_id", "metal_initial_mM", "mM", "metal_initial_text", "comments", METAL, "metal", "SELECT species AS of, molar_mass FROM species_mass WHERE kind = 'metal'"),
        )
    )
SQL = {
    "p7_found": _PARTS
    + f"""),
q AS (SELECT *, coalesce(v, stated) AS x FROM p),
w AS (SELECT record_id, field_name, {_UM} AS um FROM q WHERE x IS NOT NULL AND (v IS NULL OR NOT coalesce(unit = column_unit OR {_SCALE.replace('CASE u', 'CASE unit')} = {_SCALE.replace('CASE u', 'CASE column_unit')}, false)))
SELECT DISTINCT record_id, field_name, CAST(round(CASE WHEN um = 0 THEN 0 WHEN 1 - floor(log10(abs(um))) > 0 THEN round(um * pow(10.0, 1 - floor(log10(abs(um))))) / pow(10.0, 1 - floor(log10(abs(um)))) ELSE round(um * pow(10.0, 1 - floor(log10(abs(um))))) * pow(10.0, floor(log10(abs(um))) - 1) END) AS BIGINT) AS value_um
FROM w WHERE um IS NOT NULL
""",
    "p7_units": _PARTS + "), q AS (SELECT * FROM p WHERE coalesce(v, stated) IS NOT NULL) SELECT field_name, unit, count(DISTINCT record_id) AS n_records FROM q GROUP BY ALL",
}


def quantities_sql(table_: str, raw: str) -> str:
    """(unit, n, n_stated) of a column of stated quantities."""
    group = lambda i: f"regexp_extract({_packed(raw)}, '{_NUMBER}', {i})"
    stated = f"CASE WHEN lower(trim({raw})) NOT IN ('', '-', '- -', 'n/a', '?', 'none', 'nan') THEN TRY_CAST(replace({group(1)}, ',', '.') || CASE WHEN {group(2)} || {group(3)} <> '' THEN 'e' || {group(2)} || {group(3)} ELSE '' END AS DOUBLE) END"
    return f"SELECT {_unit(group(4))} AS unit, count(*) AS n, count({stated}) AS n_stated FROM {table_} GROUP BY 1"


SQL["parse_quantities"] = quantities_sql("dataset_all_metals", "acid_concentration_raw")  # the query stands with the curation of raw texts
