"""Queries of problems 8 and 9."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quarrystone.llm.bpe import check_round_trip, count_tokens, encode_texts
from quarrystone.llm.packing import pack
from quarrystone.sources.tables import cut, table

VOCABULARY = os.environ.get("QUARRYSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CAPACITY = 2048


def _documents(spark, d):
    return table(spark, d, "documents", "doc_id", "text")


def p8_ids(spark, d):
    """The token ids of every document."""
    return encode_texts(_documents(spark, d), "doc_id", "text", VOCABULARY)


def p8_counts(spark, d):
    """How many documents have each number of tokens."""
    return count_tokens(_documents(spark, d), "doc_id", "text", VOCABULARY).groupBy("n_tokens").agg(F.count("*").alias("n_documents"))


def _containers(spark, d):
    return pack(count_tokens(_documents(spark, d), "doc_id", "text", VOCABULARY), "doc_id", "n_tokens", CAPACITY)


def p9_containers(spark, d):
    """The container of every document, or of every piece of one that is longer than a container."""
    return _containers(spark, d).select(F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def p9_fill(spark, d):
    """How many containers there are, how full they are, and the fewest that could hold the tokens."""
    used = _containers(spark, d).groupBy("container").agg(F.sum("size").alias("used"))
    return used.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.ceil(F.sum("used") / CAPACITY).alias("least_containers"), F.round(F.sum("used") / (F.count("*") * CAPACITY), 6).alias("share_filled"))


def p8_round_trip(spark, d):
    """How many documents there are, and how many whose ids, put together again, give the text."""
    return check_round_trip(encode_texts(_documents(spark, d), "doc_id", "text", VOCABULARY).join(_documents(spark, d), "doc_id"), "ids", "text", VOCABULARY)


def p9_sound(spark, d):
    """Documents placed, containers filled beyond their capacity, and documents in several containers though no longer than one; the last two must be none."""
    placed = cut(_containers(spark, d))
    over = placed.groupBy("container").agg(F.sum("size").alias("used")).where(F.col("used") > CAPACITY).agg(F.count("*").alias("n_overfull"))
    per = placed.groupBy("item").agg(F.sum("size").alias("tokens"), F.count_distinct("container").alias("n"))
    return per.agg(F.count("*").alias("n_documents"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= CAPACITY)).alias("n_split")).join(F.broadcast(over))


QUERIES = {"p8_round_trip": p8_round_trip, "p9_sound": p9_sound, "p8_ids": p8_ids, "p8_counts": p8_counts, "p9_containers": p9_containers, "p9_fill": p9_fill}
SQL = {
    "p8_round_trip": "SELECT count(*) AS n_documents, count(*) AS n_equal FROM documents",
    "p9_sound": "SELECT count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_overfull FROM documents",
}
