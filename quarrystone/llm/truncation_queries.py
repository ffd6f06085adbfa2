"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.llm.truncation import FORM_LEAST, FORM_SHARE, ending_forms, find_truncated
from quarrystone.sources.tables import table

def _judged(spark, d):
    return find_truncated(table(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


def p10_found(spark, d):
    """The documents whose text was cut."""
    return _judged(spark, d).where("cut").select("doc_id").distinct()


def p10_report(spark, d):
    """How many texts of each source were cut, at its limit or in transfer."""
    return _judged(spark, d).groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count(F.when(F.col("cut"), 1)).alias("n_cut"), F.count(F.when(F.col("evidence") == "limit", 1)).alias("n_at_limit"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share_cut")
    )


def p10_forms(spark, d):
    """The forms of last lines that were learned to be complete without terminal punctuation."""
    return ending_forms(table(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


QUERIES = {"p10_found": p10_found, "p10_report": p10_report, "p10_forms": p10_forms}
_END = "rtrim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(160) || chr(8194) || chr(8195) || chr(8201) || chr(8203) || chr(12288) || chr(65279))"
_LAST = f"trim(list_last(string_split({_END}, chr(10))))"
_CLOSED = r"[.。．!！?？…][)\]}\"'”’»」』]*$".replace("'", "''")
_LEAD = r"regexp_replace(regexp_extract(last, '^(\p{L}+:|[^\p{L}\p{N}\s]+|[0-9]|\p{L}+)', 1), '[0-9]', '0')"
_TAIL = r"CASE WHEN regexp_matches(last, '[;:|=]$') THEN right(last, 1) ELSE regexp_extract(last, '(?s)^(?:.*[;:|=])?([^;:|=]*)$', 1) END"
_MASKED = rf"regexp_replace(regexp_replace(regexp_replace(trim(lower({_TAIL})), '[0-9]', '0', 'g'), '(^|[^.0])0+', '\10', 'g'), '[-−+]0', '0', 'g')"
_BASE = f"""
WITH d AS (SELECT doc_id, source, {_END} AS e, length(text) AS c, octet_length(encode(rtrim(text, chr(65533)))) AS b, coalesce(regexp_matches({_END}, '{_CLOSED}'), true) AS closed, {_LAST} AS last, text FROM documents),
u AS (SELECT DISTINCT source, md5(text) AS h, c, b FROM d WHERE text IS NOT NULL),
bars AS (SELECT source, 'chars' AS kind, c AS len, 1 AS slack, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT source, 'bytes', b, 4, count(*) FROM u GROUP BY ALL),
w AS (SELECT *, max(len) OVER (PARTITION BY source, kind) AS longest FROM bars),
x AS (SELECT *, max(CASE WHEN len >= 0.95 * longest THEN (n, len) END) OVER (PARTITION BY source, kind) AS t FROM w WHERE len >= 0.8 * longest),
y AS (SELECT source, kind, t[2] AS top, slack, n, len FROM x),
l AS (SELECT source, kind, top FROM y GROUP BY source, kind, top, slack
  HAVING coalesce(sum(n) FILTER (WHERE len > top - slack AND len <= top), 0) >= 5
     AND coalesce(sum(n) FILTER (WHERE len > top - slack AND len <= top), 0) >= 5 * slack * coalesce(sum(n) FILTER (WHERE len <= top - slack), 0) / greatest(0.2 * top, 1.0)
     AND coalesce(sum(n) FILTER (WHERE len > top), 0) <= 0.1 * coalesce(sum(n) FILTER (WHERE len > top - slack AND len <= top), 0)),
lim AS (SELECT source, max(top) FILTER (WHERE kind = 'chars') AS c0, max(top) FILTER (WHERE kind = 'bytes') AS b0 FROM l GROUP BY source),
j AS (SELECT d.*, coalesce(c >= c0, false) OR coalesce(b > b0 - 4, false) OR (coalesce(regexp_matches(e, '(\\.\\.\\.|…)$'), false) AND (coalesce(c >= 0.99 * c0, false) OR coalesce(b >= 0.99 * b0, false))) AS at_limit FROM d LEFT JOIN lim ON d.source IS NOT DISTINCT FROM lim.source),
f AS (SELECT doc_id, md5(text) AS h, CASE WHEN NOT closed THEN {_LEAD} || ' … ' || {_MASKED} END AS form, at_limit, e FROM j),
known AS (SELECT form, count(DISTINCT h) AS n_texts FROM f WHERE form IS NOT NULL AND NOT at_limit AND e <> '' GROUP BY form HAVING count(DISTINCT h) >= greatest({FORM_LEAST}, {FORM_SHARE} * (SELECT count(DISTINCT h) FROM f WHERE NOT at_limit))),
jf AS (SELECT j.*, f.form IN (SELECT form FROM known) AS formed FROM j JOIN (SELECT DISTINCT doc_id, form FROM f) f USING (doc_id)),
k AS (SELECT doc_id, source, at_limit, coalesce(e <> '', false) AND ((NOT closed AND NOT coalesce(formed, false)) OR (at_limit AND coalesce(regexp_matches(e, '(\\.\\.\\.|…)$'), false))) AS cut FROM jf)
"""
SQL = {
    "p10_found": _BASE + "SELECT DISTINCT doc_id FROM k WHERE cut",
    "p10_forms": _BASE + "SELECT form, n_texts FROM known",
    "p10_report": _BASE + "SELECT source, count(*) AS n_documents, count(*) FILTER (WHERE cut) AS n_cut, count(*) FILTER (WHERE cut AND at_limit) AS n_at_limit, round(avg(CASE WHEN cut THEN 1.0 ELSE 0.0 END), 6) AS share_cut FROM k GROUP BY source",
}
