"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.clean import is_blank
from quarrystone.llm.catalog_match import catalog_spellings, match_values
from quarrystone.sources.tables import table


def _mapped(spark, d, source, record, typed, catalog, entry):
    """One row per record whose typed value is neither blank nor a catalogue name, with its entry."""
    rows = table(spark, d, source, record, typed)
    names = table(spark, d, catalog, entry, "name", "synonyms")
    spellings = catalog_spellings(names, entry, "name", "synonyms", rows.groupBy(typed).agg(F.count("*").alias("n")))
    other = rows.where(~is_blank(F.col(typed))).join(names.select(F.col("name").alias(typed)), typed, "left_anti")
    once = other.select(F.col(record).alias("record_id"), F.col(typed).alias("typed")).distinct()
    return once.join(match_values(once.select("typed"), spellings), "typed").select(F.lit(typed).alias("field_name"), "record_id", "typed", "entry_id", "distance")


def _both(spark, d):
    return _mapped(spark, d, "dataset", "row_id", "extractant_name", "ligand_catalog", "ligand_id").unionByName(
        _mapped(spark, d, "dataset_all_metals", "canonical_measurement_id", "solvent_key", "solvent_catalog", "solvent_id")
    )


def p5_found(spark, d):
    """Every record whose typed value needs mapping, with its catalogue entry or 0."""
    return _both(spark, d).select("field_name", "record_id", "entry_id")


def p5_unmatched(spark, d):
    """The typed values that match no entry, and how many records carry each."""
    return _both(spark, d).where("entry_id = 0").groupBy("field_name", "typed").agg(F.count("*").alias("n_records"))


QUERIES = {"p5_found": p5_found, "p5_unmatched": p5_unmatched}


_TAIL = r"(\s*[(\[][^()\[\]]*[)\]]|\s*,\s+[a-z][a-z0-9_ ]*|[\s*.]+)$"


def _key(c):
    out = f"lower(trim(regexp_replace({c}, '[\\s ]+', ' ', 'g')))"
    for _ in range(3):
        out = f"regexp_replace({out}, '{_TAIL}', '')"
    return f"regexp_replace({out}, '[^a-z0-9]', '', 'g')"


def _sql(source, record, typed, catalog, entry):
    blank = f"({typed} IS NULL OR lower(trim(regexp_replace({typed}, '[\\s ]+', ' ', 'g'))) IN ('', '-', '- -', 'n/a', '?', 'none', 'nan'))"
    allowed = "CASE WHEN length(c.k) < 4 THEN 0 WHEN length(c.k) < 7 THEN 1 ELSE 2 END"
    return f"""SELECT '{typed}' AS field_name, o.record_id, o.typed, coalesce(m.entry_id, 0) AS entry_id FROM
(SELECT DISTINCT {record} AS record_id, {typed} AS typed, {_key(typed)} AS k FROM {source} WHERE NOT {blank} AND {typed} NOT IN (SELECT name FROM {catalog})) o LEFT JOIN
(SELECT t.k, first(c.entry_id ORDER BY damerau_levenshtein(t.k, c.k), c.syn, coalesce(f.n, 0) DESC, c.entry_id) AS entry_id
 FROM (SELECT DISTINCT {_key(typed)} AS k FROM {source} WHERE NOT {blank}) t
 JOIN (SELECT {entry} AS entry_id, name, {_key('name')} AS k, 0 AS syn FROM {catalog} UNION ALL SELECT {entry}, name, {_key('s')}, 1 FROM (SELECT {entry}, name, unnest(synonyms) AS s FROM {catalog})) c
   ON abs(length(t.k) - length(c.k)) <= 2 AND damerau_levenshtein(t.k, c.k) <= {allowed}
 LEFT JOIN (SELECT {typed} AS name, count(*) AS n FROM {source} GROUP BY 1) f ON f.name = c.name
 GROUP BY t.k) m USING (k)"""


_BOTH = (
    _sql("dataset", "row_id", "extractant_name", "ligand_catalog", "ligand_id")
    + "\nUNION ALL\n"
    + _sql("dataset_all_metals", "canonical_measurement_id", "solvent_key", "solvent_catalog", "solvent_id")
)
SQL = {
    "p5_found": f"SELECT field_name, record_id, entry_id FROM ({_BOTH})",
    "p5_unmatched": f"SELECT field_name, typed, count(*) AS n_records FROM ({_BOTH}) WHERE entry_id = 0 GROUP BY ALL",
}
