"""Duplicate ladders, classes and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_fanout(df: DataFrame, key: str, order: list[Column], lists: dict[str, str]) -> DataFrame:
    """One row per key: the first in `order` (a complete one), the sorted different values of each list column, and the number of rows.

    The first row is taken by a limited window, which cuts every key to one row before the shuffle.
    """
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    sets = df.groupBy(key).agg(F.count("*").alias("fanout_size"), *[F.array_sort(F.collect_set(c)).alias(a) for c, a in lists.items()])
    return first.join(sets, key)


def constancy(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: the keys in which it takes more than one value (NULL counts as a value), and the most values it takes."""
    per = df.groupBy(key).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    return per.unpivot([], columns, "column_name", "n_values").groupBy("column_name").agg(F.count_if(F.col("n_values") > 1).alias("n_varying"), F.max("n_values").alias("most_values"))


def ladder(df: DataFrame, levels: list[tuple[str, Column]]) -> DataFrame:
    """Per level of ever coarser keys: groups of two or more rows, rows in them, and redundant rows; raises if a coarser level finds fewer redundant rows.

    All levels share one scan: each row is expanded to one (level, key hash) per level and counted with map-side combination.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(n).alias("name"), F.sha2(F.coalesce(k, F.lit("NA")), 256).alias("k")) for i, (n, k) in enumerate(levels)]))
    groups = df.select(keys.alias("x")).groupBy("x.level", "x.name", "x.k").agg(F.count("*").alias("n"))
    per = groups.groupBy("level", "name").agg(F.count_if(F.col("n") > 1).alias("n_groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_rows"), F.sum(F.col("n") - 1).alias("n_redundant"))
    before = F.lag("n_redundant").over(Window.partitionBy(F.lit(1)).orderBy("level"))  # one row per level
    fine = F.when(F.col("n_redundant") < before, F.raise_error(F.lit("the ladder is not monotone"))).otherwise(F.lit(True))
    return per.withColumn("ok", fine.cast("boolean")).where("ok").select("level", "name", "n_groups", "n_rows", "n_redundant")


def classify_groups(df: DataFrame, key: Column, row_id: str, value: Column, provenance: list[Column], essential: list[Column], digits: Column, copied_digits: int = 5) -> DataFrame:
    """(key, n, class, representative): per key the rows, the class and the record with the lowest number in its id.

    F: an essential field is missing; UNIQUE: one row; E: several values; A: one provenance (a combination of its columns, NULL
    is a value); B: several, but a value written with copied_digits or more; C: several and a coarser value, which may be
    a repeat. A group holding any share of the rows is aggregated on the map side.
    """
    missing = F.lit(False)
    for e in essential:
        missing = missing | e.isNull()
    source = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in provenance])
    number = F.coalesce(F.regexp_extract(row_id, r"(\d{1,15})\D*$", 1).try_cast("long"), F.lit(2**62))
    per = df.groupBy(key.alias("key")).agg(
        F.count("*").alias("n"), F.min(F.struct(number.alias("number"), F.col(row_id).alias("id"))).getField("id").alias("representative"), F.count_distinct(value).alias("n_values"), F.count_distinct(source).alias("n_sources"), F.max(missing).alias("lacks"), F.max(digits).alias("digits"),
    )
    label = F.when(F.col("lacks"), "F").when(F.col("n") == 1, "UNIQUE").when(F.col("n_values") > 1, "E").when(F.col("n_sources") <= 1, "A").when(F.col("digits") >= copied_digits, "B").otherwise("C")
    return per.select("key", "n", label.alias("class"), "representative")


def canonical_rows(df: DataFrame, key: Column, row_id: str, classes: DataFrame) -> DataFrame:
    """df with `class`, `representative` and `is_canonical_row`: of groups of class A and B only the representative is, of all others every row."""
    marked = df.withColumn("_key", key).join(classes.select(F.col("key").alias("_k"), "class", "representative"), F.col("_key").eqNullSafe(F.col("_k")), "left")
    return marked.withColumn("is_canonical_row", ~F.col("class").isin("A", "B") | (F.col(row_id) == F.col("representative"))).drop("_key", "_k")


def one_field_conflicts(df: DataFrame, fields: list[str], value: Column) -> DataFrame:
    """For each field: groups of rows that agree in all other fields, take several values of this one, and still record a single value.

    Each row is written once per field under the hash of its other fields.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.sha2(F.concat_ws("\x1f", *[text(o) for o in fields if o != f]), 256).alias("rest"), text(f).alias("own"), F.col(f).isNull().alias("gone")) for f in fields]))
    rows = df.select(stacked.alias("s"), value.alias("v")).select("s.*", "v")
    groups = rows.groupBy("field", "rest").agg(F.count_distinct("own").alias("variants"), F.count_distinct("v").alias("values"), F.max("gone").alias("gone"), F.count("*").alias("n"))
    return groups.groupBy("field").agg(F.count_if((F.col("variants") > 1) & (F.col("values") == 1) & ~F.col("gone")).alias("n_conflicts"), F.sum(F.when((F.col("variants") > 1) & (F.col("values") == 1) & ~F.col("gone"), F.col("n")).otherwise(0)).alias("n_rows"))


def decade_gaps(df: DataFrame, cell: list[str], value: Column, tol: float = 1e-6) -> DataFrame:
    """Neighbouring values of a cell, in order, that differ by a whole non-zero number (log10 units: a decade slip)."""
    x = df.where(value.isNotNull()).select(*cell, value.alias("value"))
    gap = F.col("value") - F.lag("value").over(Window.partitionBy(*cell).orderBy("value"))
    return x.withColumn("gap", gap).where((F.abs(F.col("gap") - F.round("gap")) < tol) & (F.round("gap") != 0))
