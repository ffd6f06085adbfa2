"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.llm.ivfpq import pack_vectors, similar_pairs
from quarrystone.sources.tables import table


def p2_found(spark, d):
    """Pairs of structures of which one is among the other's five most similar, with similarity of at least 0.6."""
    vectors = pack_vectors(table(spark, d, "ligand_fingerprint", "structure_id", "fingerprint"), "structure_id", "fingerprint", 256)
    return similar_pairs(vectors, 5, 0.6).select(F.col("a").alias("structure_id_a"), F.col("b").alias("structure_id_b"))


QUERIES = {"p2_found": p2_found}
SQL = {
    "p2_found": """
WITH v AS (SELECT structure_id AS i, list_transform(range(256), lambda k: CASE WHEN fingerprint[k + 1] > 0.5 THEN 1 ELSE 0 END) AS f
           FROM ligand_fingerprint
           WHERE len(fingerprint) = 256 AND len(list_filter(fingerprint, lambda x: x IS NULL OR isnan(x))) = 0 AND list_sum(fingerprint) > 0),
n AS (SELECT i, CAST(f AS INTEGER[]) AS f, list_sum(f) AS ones FROM v),
s AS (SELECT a.i AS a, b.i AS b, list_dot_product(CAST(a.f AS DOUBLE[]), CAST(b.f AS DOUBLE[])) AS c, a.ones + b.ones AS t FROM n a JOIN n b ON a.i <> b.i),
r AS (SELECT a, b, c / (t - c) AS sim, row_number() OVER (PARTITION BY a ORDER BY c / (t - c) DESC, b) AS place FROM s)
SELECT DISTINCT least(a, b) AS structure_id_a, greatest(a, b) AS structure_id_b FROM r WHERE place <= 5 AND sim >= 0.6
"""
}
