"""Leakage-safe partitions: grouped folds, masks, size-matched controls, audits.

Random order is the order of MD5 hashes of (seed, key), so every engine and
every partitioning deals the same folds. Dealing works on the table of distinct
groups: groups are ranked within 4096 hash ranges and the ranges' counts are
summed, so no task sees all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.keys import hash_order


def global_rank(df: DataFrame, order: Column, by: list[str] | None = None) -> DataFrame:
    """df with `rank` from 0 in the order of a hexadecimal hash text, per `by`, without one task for all rows.

    Rows are ranked inside the range of their first three digits; a table of at
    most 4096 counts per group adds what lies before. Equal hashes are ranked in any order.
    """
    by = by or []
    x = df.withColumn("_o", order).withColumn("_range", F.substring("_o", 1, 3))
    counts = x.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = x.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_o")) - 1)
    return inside.join(before, [*by, "_range"]).withColumn("rank", F.col("_r") + F.col("_before")).drop("_o", "_range", "_r", "_before")


def grouped_folds(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """(group, fold): groups in hashed order dealt round robin; a group is never split. NULL groups are dealt as one group."""
    groups = df.select(F.col(group)).distinct()
    return global_rank(groups, hash_order(F.lit(seed), F.coalesce(F.col(group).cast("string"), F.lit("NA")))).select(group, F.pmod("rank", F.lit(k)).cast("int").alias("fold"))


def remainder_folds(df: DataFrame, group: str, least: int) -> DataFrame:
    """(group, fold): leave-one-group-out folds named by their group; groups of fewer than `least` rows share the fold REMAINDER."""
    return df.groupBy(group).agg(F.count("*").alias("n")).select(group, "n", F.when(F.col("n") >= least, F.col(group)).otherwise("REMAINDER").alias("fold"))


def publication_mask(rows: DataFrame, row_id: str, fold: str, publication: str, k: int) -> DataFrame:
    """(row_id, held_fold): training rows of every fold, without those whose publication occurs in the held-out fold."""
    held = rows.select(F.col(fold).alias("held_fold"), F.col(publication).alias("_p")).distinct()
    train = rows.withColumn("held_fold", F.explode(F.array(*[F.lit(i) for i in range(k)]))).where(F.col("held_fold") != F.col(fold))
    return train.alias("t").join(held.alias("h"), (F.col("t.held_fold") == F.col("h.held_fold")) & (F.col(f"t.{publication}") == F.col("h._p")), "left_anti").select(row_id, "held_fold")


def sharing(rows: DataFrame, row_id: str, fold: str, values: str) -> DataFrame:
    """(row_id, fold, other_fold): the folds, its own among them, that hold any of the values a row lists in the array column `values`; one line each."""
    long = rows.select(row_id, fold, F.explode(values).alias("_v"))
    held = long.select("_v", F.col(fold).alias("other_fold")).distinct()
    return long.join(held, "_v").select(row_id, fold, "other_fold").distinct()


def mask_of_all(rows: DataFrame, row_id: str, fold: str, values: str, k: int) -> DataFrame:
    """(row_id, held_fold): training rows of every fold, without those that list any value which occurs in the held-out fold."""
    train = rows.withColumn("held_fold", F.explode(F.array(*[F.lit(i) for i in range(k)]))).where(F.col("held_fold") != F.col(fold))
    return train.select(row_id, "held_fold").join(sharing(rows, row_id, fold, values).select(row_id, F.col("other_fold").alias("held_fold")), [row_id, "held_fold"], "left_anti")


def leak_audit_of_all(rows: DataFrame, row_id: str, fold: str, values: str, name: str) -> DataFrame:
    """leak_audit of an array column: every listed value counts, and a row counts once however many of its values leak."""
    long = rows.select(fold, F.explode(values).alias("_v"))
    leaking = long.groupBy("_v").agg(F.count_distinct(fold).alias("folds")).agg(F.count_if(F.col("folds") > 1).alias("n_leaking"))
    reached = sharing(rows, row_id, fold, values).where(F.col("other_fold") != F.col(fold)).agg(F.count_distinct(row_id).alias("n_rows"))
    return leaking.crossJoin(reached).select(F.lit(name).alias("column_name"), "n_leaking", "n_rows")


def size_matched(rows: DataFrame, sizes: DataFrame, by: list[str], row_id: str, seed: int) -> DataFrame:
    """Rows with the first `n_drop` (column of `sizes`, per `by`) of a hashed order removed: a random control of the same size."""
    ranked = global_rank(rows, hash_order(F.lit(seed), *[F.col(c) for c in by], F.col(row_id)), by)
    return ranked.join(sizes, by).where(F.col("rank") >= F.col("n_drop")).drop("rank", "n_drop")


def hash_sample(df: DataFrame, n: int, seed: int, row_id: str, by: list[str] | None = None) -> DataFrame:
    """A reproducible sample of n rows, or of n rows of every group: the first in hashed order, taken by a limited window."""
    key = hash_order(F.lit(seed), F.col(row_id))
    if not by:
        return df.orderBy(key, row_id).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key, row_id))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def permuted(df: DataFrame, row_id: str, value: str, seed: int, by: list[str]) -> DataFrame:
    """df with `value` shuffled within `by`: row i in natural order takes the value of row i in hashed order."""
    natural = global_rank(df, F.md5(F.col(row_id).cast("string")), by)
    other = global_rank(df.select(*by, F.col(value).alias("_v"), F.col(row_id).alias("_id")), hash_order(F.lit(seed), F.col("_id")), by).drop("_id")
    return natural.join(other, [*by, "rank"]).drop(value, "rank").withColumnRenamed("_v", value)


def leak_audit(rows: DataFrame, fold: str, columns: list[str]) -> DataFrame:
    """Per column: how many of its values occur in more than one fold (0 where nothing leaks), and the rows that carry them."""
    long = rows.select(fold, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s")).select(fold, "s.*").where("v IS NOT NULL")
    per = long.groupBy("column_name", "v").agg(F.count_distinct(fold).alias("folds"), F.count("*").alias("n"))
    return per.groupBy("column_name").agg(F.count_if(F.col("folds") > 1).alias("n_leaking"), F.sum(F.when(F.col("folds") > 1, F.col("n")).otherwise(0)).alias("n_rows"))


def relation_masks(rows: DataFrame, held: DataFrame, relations: dict[str, str]) -> DataFrame:
    """rows with one boolean per relation: whether any held-out row shares that column's value (NULL never does)."""
    out = rows
    for name, column in relations.items():
        mark = held.select(F.col(column).alias(f"_{name}")).where(F.col(f"_{name}").isNotNull()).distinct().withColumn(f"_is_{name}", F.lit(True))
        out = out.join(mark, F.col(column) == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(f"_is_{name}", F.lit(False))).drop(f"_{name}", f"_is_{name}")
    return out


def fingerprint(df: DataFrame, columns: list[str], digits: int = 12) -> DataFrame:
    """One row: the number of rows and a digest of the table that ignores row and column order: the sum of row hashes."""
    from quarrystone.functions.keys import quantised

    numeric = {"double", "float"}
    parts = [quantised(F.col(c).cast("double"), digits) if dict(df.dtypes)[c] in numeric else F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in sorted(columns)]
    row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(row).cast("string").alias("digest"))
