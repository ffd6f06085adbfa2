"""Windows over events, and small operators of the archive's lists and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.clean import label_key, number_or_null
from quarrystone.functions.text import nfkc, parse_mixture, parse_state, split_components, state_text, weighted_property
from quarrystone.plans.metric_queries import rounded
from quarrystone.sources.files import manifest, pending
from quarrystone.sources.tables import table
from quarrystone.streaming import windows as W


def _events(spark, d):
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def tumbling_windows(spark, d):
    return rounded(W.windowed(_events(spark, d), "ts", "event_type", "value", "6 hours"), 4)


def sliding_windows(spark, d):
    return rounded(W.windowed(_events(spark, d), "ts", "event_type", "value", "12 hours", "6 hours"), 4)


def session_windows(spark, d):
    return W.sessions(_events(spark, d), "ts", "user_id", "2 hours").select("user_id", F.col("start"), "n")


def first_deliveries(spark, d):
    t = table(spark, d, "corpus_records", "record_id", "metal")
    return W.first_deliveries(t, "metal", "record_id", "1 hour").groupBy("metal").agg(F.count("*").alias("n"))


def pending_publications(spark, d):
    wanted = table(spark, d, "dataset_all_metals", "doi_primary").withColumnRenamed("doi_primary", "publication")
    return pending(wanted, table(spark, d, "leakage_publication_components", "publication"), "publication")


def file_manifest(spark, d):
    return manifest(spark, f"{d}/nation.parquet")


def list_columns(spark, d):
    """Lists per record as JSON text and back, with their sizes."""
    t = table(spark, d, "ligand_catalog", "ligand_id", "synonyms")
    text = F.to_json("synonyms")
    back = F.from_json(text, "array<string>")
    return t.select("ligand_id", F.size(back).alias("n_synonyms"), F.array_join(F.array_sort(back), ";").alias("names"))


def vocabulary_counts(spark, d):
    """How often each word pair of the reagent names occurs."""
    t = table(spark, d, "dataset", "extractant_name").where("extractant_name IS NOT NULL")
    return t.select(F.explode(F.split(F.lower(F.trim("extractant_name")), r"[^a-z0-9]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def mass_action(spark, d):
    """Logarithmic conditions and their products per record; NULL where a quantity is not positive."""
    t = table(spark, d, "corpus_records", "record_id", "acid_nominal_M", "ligand_M", "log_d").dropDuplicates(["record_id"])
    log = lambda c: F.when(number_or_null(F.col(c)) > 0, F.log10(F.col(c)))
    return rounded(t.select("record_id", log("acid_nominal_M").alias("log_acid"), log("ligand_M").alias("log_ligand"), (log("acid_nominal_M") * log("ligand_M")).alias("product")), 6)


def interval_distances(spark, d):
    t = table(spark, d, "corpus_records", "record_id", "temperature_C").dropDuplicates(["record_id"])
    x = number_or_null(F.col("temperature_C"))
    return t.select("record_id", F.round(F.greatest(F.lit(20.0) - x, x - 30.0, F.lit(0.0)), 6).alias("distance"))


def stable_hashes(spark, d):
    t = table(spark, d, "dataset", "chemotype").select(label_key(F.col("chemotype")).alias("k")).where("k IS NOT NULL").distinct()
    return t.select("k", (F.conv(F.substring(F.md5("k"), 1, 8), 16, 10).cast("long") % 2147483648).alias("h"))


def note_counts(spark, d):
    t = table(spark, d, "dataset_all_metals", "comments_raw")
    return t.select(F.explode(split_components(F.col("comments_raw"), ";")).alias("note")).groupBy("note").agg(F.count("*").alias("n"))


def state_keys(spark, d):
    t = table(spark, d, "dataset_all_metals", "metal_symbol", "metal_oxidation_state")
    s = state_text(F.col("metal_symbol"), F.col("metal_oxidation_state"))
    return t.select(s.alias("state"), parse_state(s).alias("p")).groupBy("state", F.col("p.oxidation").alias("oxidation")).agg(F.count("*").alias("n"))


def mixture_properties(spark, d):
    """Mixtures of two part names read back from text, with their price-like property weighted by volume."""
    t = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    text = F.concat(F.col("p_brand"), F.lit(" with "), (F.col("p_size") % 50).cast("string"), F.lit("% modifier"))
    known = F.create_map(F.col("p_brand"), F.lit(100.0), F.lit("modifier"), F.lit(200.0))
    return t.select("p_partkey", F.round(weighted_property(parse_mixture(text), known), 6).alias("value"))


def folded_names(spark, d):
    return table(spark, d, "dataset", "extractant_name").groupBy(nfkc(F.col("extractant_name")).alias("name")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (tumbling_windows, sliding_windows, session_windows, first_deliveries, pending_publications, file_manifest, list_columns, vocabulary_counts, mass_action, interval_distances, stable_hashes, note_counts, state_keys, mixture_properties, folded_names)}
_H6 = "time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')"
_CR = "(SELECT DISTINCT record_id, acid_nominal_M, ligand_M, temperature_C FROM corpus_records)"
SQL = {
    "tumbling_windows": f"SELECT {_H6} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_windows": f"SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([{_H6}, {_H6} - INTERVAL '6 hours']) AS start, event_type, value FROM events) GROUP BY ALL",
    "session_windows": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
    "first_deliveries": "SELECT metal, count(DISTINCT record_id) AS n FROM corpus_records GROUP BY 1",
    "pending_publications": "SELECT DISTINCT doi_primary AS publication FROM dataset_all_metals WHERE doi_primary IS NOT NULL AND doi_primary NOT IN (SELECT publication FROM leakage_publication_components)",
    "list_columns": "SELECT ligand_id, CAST(len(synonyms) AS INT) AS n_synonyms, array_to_string(list_sort(synonyms), ';') AS names FROM ligand_catalog",
    "vocabulary_counts": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(trim(extractant_name)), '[^a-z0-9]+')) AS word FROM dataset) WHERE word <> '' GROUP BY 1",
    "mass_action": f"SELECT record_id, round(a, 6) AS log_acid, round(l, 6) AS log_ligand, round(a * l, 6) + 0.0 AS product FROM (SELECT record_id, CASE WHEN NOT isnan(acid_nominal_M) AND acid_nominal_M > 0 THEN log10(acid_nominal_M) END AS a, CASE WHEN NOT isnan(ligand_M) AND ligand_M > 0 THEN log10(ligand_M) END AS l FROM {_CR})",
    "interval_distances": f"SELECT record_id, round(CASE WHEN temperature_C IS NULL OR isnan(temperature_C) THEN 0.0 ELSE greatest(20.0 - temperature_C, temperature_C - 30.0, 0.0) END, 6) AS distance FROM {_CR}",
    "stable_hashes": "SELECT k, CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % 2147483648 AS h FROM (SELECT DISTINCT CASE WHEN chemotype IS NOT NULL AND lower(trim(chemotype)) NOT IN ('', '-', '- -', 'n/a', '?', 'none', 'nan') THEN regexp_replace(lower(chemotype), '[^a-z0-9]+', '', 'g') END AS k FROM dataset) WHERE k IS NOT NULL",
    "note_counts": "SELECT note, count(*) AS n FROM (SELECT trim(regexp_replace(unnest(string_split(comments_raw, ';')), '\\s+', ' ', 'g')) AS note FROM dataset_all_metals) WHERE lower(note) NOT IN ('', '-', '- -', 'n/a', '?', 'none', 'nan') GROUP BY 1",
    "state_keys": "SELECT metal_symbol || '(' || ['0','I','II','III','IV','V','VI','VII'][CAST(o AS INT) + 1] || ')' AS state, CASE WHEN o BETWEEN 0 AND 7 AND o = floor(o) THEN CAST(o AS INT) END AS oxidation, count(*) AS n FROM (SELECT metal_symbol, CASE WHEN NOT isnan(metal_oxidation_state) THEN metal_oxidation_state END AS o FROM dataset_all_metals) GROUP BY ALL",
    "mixture_properties": "SELECT p_partkey, round(((1 - (p_size % 50) / 100) * 100.0 + (p_size % 50) / 100 * 200.0), 6) AS value FROM part",
}
