"""Problem 1: one surviving record per group of duplicates, by window ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.clean import is_filled, squeeze


def _count(conditions: list[Column]) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + c.cast("int")
    return total


def ranked_records(df: DataFrame, group: str, record_id: str, fields: list[str], recency: Column, flags: str, suspects: DataFrame, member: Column | None = None) -> DataFrame:
    """(group_id, rec_id, filled, recent, suspect, member, fields...) of every row with a group and an id.

    filled counts the fields with a usable value, recent is `recency` with -1
    for unknown, suspect counts the different flags (white space trimmed, in
    lower case) found in the one-column table `suspects`. NULL flags are no
    flags. member tells whether the row makes its group one to be represented
    (NULL: it does not; left out: every row does); one such row is enough for
    the whole group. Fields come out NULL where they hold no usable value.
    """
    plain = lambda c: F.lower(squeeze(c))
    bad = suspects.agg(F.collect_set(plain(F.col(suspects.columns[0])))).scalar()
    mine = F.transform(F.coalesce(F.col(f"`{flags}`"), F.array().cast("array<string>")), plain)
    return df.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{record_id}`").isNotNull()).select(
        F.col(f"`{group}`").alias("group_id"), F.col(f"`{record_id}`").alias("rec_id"), _count([is_filled(df, f) for f in fields]).alias("filled"),
        F.coalesce(recency, F.lit(-1)).alias("recent"), F.size(F.array_intersect(mine, bad)).alias("suspect"), F.coalesce(F.lit(True) if member is None else member, F.lit(False)).alias("member"),
        *[F.when(is_filled(df, f), F.col(f"`{f}`")).alias(f) for f in fields],
    )


def best_representative(records: DataFrame) -> DataFrame:
    """One row per represented group: the record ranked first by completeness, trust and recency, ties to the smallest id.

    Columns: group_id, rec_id, filled, recent, suspect, several (two or
    more records), dominates (at least as good as every other
    record in each of the three) and unique (no other record ties with it).
    A group is represented if one of its rows is a member; then all its rows
    compete. Rows delivered again under one id are one record. Groups of one
    record come out with several = false. An empty table stays empty.

    Rows are first reduced, before any shuffle, to one per (group, filled,
    suspect, recent); the window then orders these few rows, so a group that
    holds a third of all rows is ordered as cheaply as any other.
    """
    ties = records.groupBy("group_id", "filled", "suspect", "recent").agg(F.min("rec_id").alias("first_id"), F.max("rec_id").alias("last_id"), F.max("member").alias("member"))
    order = Window.partitionBy("group_id").orderBy(F.desc("filled"), F.asc("suspect"), F.desc("recent"))
    whole = Window.partitionBy("group_id")
    seen = ties.select(
        "*", F.row_number().over(order).alias("place"), F.max("recent").over(whole).alias("newest"), F.min("suspect").over(whole).alias("cleanest"),
        F.min("first_id").over(whole).alias("lowest"), F.max("last_id").over(whole).alias("highest"), F.max("member").over(whole).alias("represented"),
    )
    return seen.where((F.col("place") == 1) & F.col("represented")).select(
        "group_id", F.col("first_id").alias("rec_id"), "filled", "recent", "suspect", (F.col("lowest") != F.col("highest")).alias("several"),
        ((F.col("recent") == F.col("newest")) & (F.col("suspect") == F.col("cleanest"))).alias("dominates"), (F.col("first_id") == F.col("last_id")).alias("unique"),
    )


def merged_fields(records: DataFrame, fields: list[str]) -> DataFrame:
    """One row per represented group with each field's value from the most trusted, then most recent, then smallest record that fills it.

    Fields that no record of the group fills are NULL. Rank and value come from
    the same row, so the choice is one aggregate with map-side combination; no
    group is gathered and nothing is joined.
    """
    rank = F.struct(F.col("suspect"), (-F.col("recent")).alias("age"), F.col("rec_id"))
    chosen = [F.min(F.when(F.col(f"`{f}`").isNotNull(), F.struct(rank.alias("r"), F.col(f"`{f}`").alias("v")))).getField("v").alias(f) for f in fields]
    return records.groupBy("group_id").agg(F.max("member").alias("_member"), *chosen).where("_member").drop("_member")
