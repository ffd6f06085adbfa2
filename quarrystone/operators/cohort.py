"""Cohorts: waterfalls, exclusion rules, tiers, validated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def waterfall(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """How many rows pass the first k rules, for every k, in one pass; a NULL condition fails. Columns: step, rule, n_pass."""
    passed = F.lit(True)
    counts = [F.count("*").alias("c0")]
    for i, (_, rule) in enumerate(rules, 1):
        passed = passed & F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(passed).alias(f"c{i}"))
    one = df.agg(*counts)
    rows = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.col(f"c{i}").alias("n_pass")) for i, n in enumerate(["all", *[r[0] for r in rules]])]
    return one.select(F.inline(F.array(*rows)))


def first_exclusion(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with `excluded_by`: the first rule it fails, NULL if none; and `only_rule`: the rule without which it would pass."""
    ok = [F.coalesce(r, F.lit(False)) for _, r in rules]
    first, fails = F.lit(None).cast("string"), F.lit(0)
    for (name, _), o in reversed(list(zip(rules, ok, strict=True))):
        first = F.when(~o, F.lit(name)).otherwise(first)
    for o in ok:
        fails = fails + (~o).cast("int")
    return df.withColumn("excluded_by", first).withColumn("only_rule", F.when(fails == 1, first))


def first_label(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(otherwise)
    for rule, label in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df as it is; when run, it raises if two rows share a key. Checked inside the plan, in the grouping that joins on the keys need anyway."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("key not unique: "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))).otherwise(F.lit(True))
    return df.withColumn("_ok", checked.cast("boolean")).where("_ok").drop("_ok")


def join_validated(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", left_unique: bool = False) -> DataFrame:
    """An equi-join whose right side (and left side if asked) must have unique keys."""
    return (assert_unique(left, keys) if left_unique else left).join(assert_unique(right, keys), keys, how)


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that raises rather than lose a row of either side."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), keys, "full_outer")
    fine = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("keys of one side only"))).otherwise(F.lit(True))
    return both.withColumn("_ok", fine.cast("boolean")).where("_ok").drop("_l", "_r", "_ok")


def coverage_of(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: keys on either side only and on both, and the greatest difference of `value` on keys of both."""
    a, b = left.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")), right.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    j = a.join(b, keys, "full_outer")
    return j.agg(F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest_difference"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time; one sort of the union, no range join. NULL where none is."""
    from pyspark.sql import Window

    side = right.select(key, at, *value, F.lit(0).alias("_side"))
    base = left.select(*left.columns, F.lit(1).alias("_side"))
    both = base.unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct(F.lit(1).alias("_1"), *value)), ignorenulls=True).over(w))
    return seen.where("_side = 1").select(*[c for c in left.columns if c not in value], *[F.col(f"_last.{v}").alias(v) for v in value])


def range_join(points: DataFrame, ranges: DataFrame, key: str, x: str, low: str, high: str, width: float) -> DataFrame:
    """Points inside the closed ranges of their key, as an equi-join on bins of `width`: a range is listed in each bin it touches."""
    p = points.withColumn("_bin", F.floor(F.col(x) / width))
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, [key, "_bin"]).where((F.col(x) >= F.col(low)) & (F.col(x) <= F.col(high))).drop("_bin")


def ledger_balance(raw: DataFrame, ledger: DataFrame, key: str, folded: str) -> DataFrame:
    """One row: raw_rows and ledger_rows, each counted from its own table, n_lost (keys of raw rows without a line in the ledger),
    n_invented (lines without a raw row), n_wrong (lines whose `folded` is not the number of their raw rows) and balanced.

    A NULL key is a key. Both tables are reduced to one line a key before they meet.
    """
    have = raw.groupBy(F.col(key).alias("_a")).agg(F.count("*").alias("_n"))
    said = ledger.groupBy(F.col(key).alias("_b")).agg(F.sum(folded).alias("_m"))
    both = have.join(said, F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
    one = both.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_rows"), F.coalesce(F.sum("_m"), F.lit(0)).alias("ledger_rows"), F.count_if(F.col("_m").isNull()).alias("n_lost"), F.count_if(F.col("_n").isNull()).alias("n_invented"), F.count_if(F.col("_n") != F.col("_m")).alias("n_wrong")
    )
    return one.withColumn("balanced", F.expr("n_lost = 0 AND n_invented = 0 AND n_wrong = 0"))
