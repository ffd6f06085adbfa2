"""Filling missing values by predictive mean matching over nested groups.

Rows live in a fine group (the same condition) inside a coarse one (the same
series). For each field a predictor is fitted from grouped sufficient
statistics: the mean of the fine group, shrunk to the mean of the coarse one by
the ratio of the pooled variances. A row without the value searches the donors
of its coarse group, or where that supports nothing of its fine group, whose
prediction lies within a relative caliper of its own, and copies the observed value of the nearest donor together with the donor's id.

Predictions depend only on the two groups, so fitting and the range search run
on one row per (coarse, fine, field) cell: what is shuffled is pre-aggregated
on the map side, and a series that holds a third of all rows is still only as
many rows as it has conditions. Only the last join touches rows again; its
right side has one row per key, so a hot key is split by adaptive skew joins
and never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.sources.tables import cut


@dataclass(frozen=True)
class Field:
    """A numeric field and the range outside which a number counts as unrecorded."""

    name: str
    low: float
    high: float


def _alike(low: Column, high: Column, tol: float) -> Column:
    """Whether the extremes of a set of numbers lie within the relative tolerance."""
    return (high - low) <= F.lit(tol) * F.greatest(F.abs(low), F.abs(high))


def predictive_mean_fill(
    df: DataFrame,
    row_id: str,
    fields: list[Field],
    fine: str,
    coarse: str,
    tol: float = 1e-3,
    min_coarse: int = 2,
    min_fine: int = 1,
    across: bool = True,
) -> DataFrame:
    """Long result: one row per unrecorded field of a row that its groups support.

    Columns: row id, field_name, fill_value, donor_id, tier ('fine' or
    'coarse'), prediction, support (recorded rows of the tier), coarse_n,
    coarse_low and coarse_high (the recorded values of the coarse group).

    A tier supports a value when enough rows record it (min_fine, min_coarse)
    and all of them agree within tol. The fine tier asks the rows of the fine
    group in the same coarse group first, then those in any (not
    with across=False). NULL groups support nothing at their level. NULL, NaN and numbers outside a field's range are unrecorded and
    never donate. Rows repeated under one id are filled alike. Ties between
    donors go to the smallest id. An empty table gives an empty result.
    Columns of df other than those named play no part, whatever their names.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(f.name).alias("field_name"), F.when(~F.isnan(F.col(f"`{f.name}`")) & F.col(f"`{f.name}`").between(f.low, f.high), F.col(f"`{f.name}`").cast("double")).alias("value")) for f in fields]))
    long = df.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{fine}`").alias("_fine"), F.col(f"`{coarse}`").alias("_coarse"), stack.alias("_s")).select("_id", "_fine", "_coarse", "_s.field_name", "_s.value")
    seen = long.where(F.col("value").isNotNull())

    # Cells: the sufficient statistics of (coarse, fine, field), and the observed row nearest to what most rows of it say.
    cells = cut(seen.groupBy("_coarse", "_fine", "field_name", "value").agg(F.count("*").alias("n"), F.min("_id").alias("donor")).groupBy("_coarse", "_fine", "field_name").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("value")).alias("s1"),
        F.sum(F.col("n") * F.col("value") * F.col("value")).alias("s2"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.max(F.struct(F.col("n"), (-F.length(F.col("value").cast("string"))).alias("l"), (-F.col("value")).alias("v"), F.col("donor"))).alias("top"),
    ))  # read three times below
    by_coarse = cells.where(F.col("_coarse").isNotNull()).groupBy("_coarse", "field_name").agg(
        F.sum("n").alias("c_n"), F.sum("s1").alias("c_s1"), F.min("low").alias("c_low"), F.max("high").alias("c_high"),
    )
    # Pooled variances within and between the fine groups, one row per field.
    pooled = cells.groupBy("field_name").agg(
        (F.sum(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))).alias("within"),
        F.coalesce(F.var_samp(F.col("s1") / F.col("n")), F.lit(0.0)).alias("total"),
    ).select("field_name", F.when(F.col("total") > 0, F.greatest(F.col("within"), F.lit(0.0)) / F.col("total")).otherwise(0.0).alias("shrink"))

    # The cells that need a value: one row per (coarse, fine, field) however many rows lack it.
    lacking = long.where(F.col("value").isNull() & (F.col("_coarse").isNotNull() | F.col("_fine").isNotNull()))
    need = lacking.select("_coarse", "_fine", "field_name").distinct().withColumn("need", F.lit(True))

    # One table of cells that have donors, need values, or both, each with the fitted prediction and the tier that supports it.
    keys = F.col("a._coarse").eqNullSafe(F.col("b._coarse")) & F.col("a._fine").eqNullSafe(F.col("b._fine")) & (F.col("a.field_name") == F.col("b.field_name"))
    both = cells.withColumn("need", F.lit(False)).unionByName(need, allowMissingColumns=True).groupBy("_coarse", "_fine", "field_name").agg(F.max("need").alias("need"), *[F.max(c).alias(c) for c in ("n", "s1", "low", "high", "top")])
    both = both.join(by_coarse, ["_coarse", "field_name"], "left").join(F.broadcast(pooled), "field_name", "left")  # pooled: one row per field
    own = F.col("n").isNotNull() & F.col("_fine").isNotNull() & (F.col("n") >= min_fine) & _alike(F.col("low"), F.col("high"), tol)
    wide = F.coalesce((F.col("c_n") >= min_coarse) & _alike(F.col("c_low"), F.col("c_high"), tol), F.lit(False))
    shrunk = (F.coalesce(F.col("s1"), F.lit(0.0)) + F.col("shrink") * F.col("c_s1") / F.col("c_n")) / (F.coalesce(F.col("n"), F.lit(0)) + F.col("shrink"))
    fitted = F.when(wide, F.col("c_s1") / F.col("c_n")).when(F.col("c_n").isNull() | (F.col("shrink") == 0), F.col("s1") / F.col("n")).otherwise(shrunk)
    fit = both.withColumn("tier", F.when(wide, "coarse").when(own, "fine")).withColumn("prediction", fitted).withColumn("support", F.when(wide, F.col("c_n")).otherwise(F.col("n")))
    fit = fit.withColumn("_group", F.coalesce(F.concat(F.lit("c:"), F.col("_coarse").cast("string")), F.concat(F.lit("f:"), F.col("_fine").cast("string"))))
    if across:
        # A cell that neither supports takes prediction and donor from its condition in all series.
        fit = cut(fit)  # read twice
        lost = fit.where(F.col("need") & F.col("tier").isNull() & F.col("_fine").isNotNull()).drop("top", "prediction", "support")
        by_fine = cells.join(lost.select("_fine", "field_name").distinct(), ["_fine", "field_name"], "left_semi").groupBy("_fine", "field_name").agg(
            F.sum("n").alias("support"), (F.sum("s1") / F.sum("n")).alias("prediction"), F.min("low").alias("f_low"), F.max("high").alias("f_high"),
            F.min(F.struct(*[(-F.col(f"top.{c}")).alias(c) for c in "nlv"], F.col("top.donor").alias("donor"))).alias("d"),
        ).where((F.col("support") >= min_fine) & _alike(F.col("f_low"), F.col("f_high"), tol))
        found = lost.drop("tier", "_group").join(by_fine.drop("f_low", "f_high"), ["_fine", "field_name"]).withColumn("tier", F.lit("fine")).withColumn("_group", F.concat(F.lit("x:"), F.col("_fine").cast("string")))
        found = found.withColumn("top", F.struct(*[(-F.col(f"d.{c}")).alias(c) for c in "nlv"], F.col("d.donor").alias("donor"))).drop("d")
        fit = fit.where(F.col("tier").isNotNull()).unionByName(found)
    fit = fit.where(F.col("tier").isNotNull() & F.col("prediction").isNotNull())

    # Range search: predictions fall into bins as wide as the caliper, so a near donor is in the bin itself or beside it.
    # Each bin keeps one donor, the most common observed value of its cells, however many cells it holds.
    caliper = 2 * tol
    p = F.col("prediction")
    fit = fit.withColumn("_bin", F.when(p == 0, F.lit(0)).otherwise((F.signum(p) * (1_000_000 + F.floor(F.ln(F.abs(p)) / caliper))).cast("long")))
    donors = fit.where(F.col("top").isNotNull()).groupBy("_group", "field_name", "_bin").agg(F.max(F.struct("top", "prediction")).alias("d"))
    asking = fit.where("need").withColumn("_bin", F.explode(F.array(*[F.col("_bin") + F.lit(k) for k in (-1, 0, 1)])))
    gap = F.abs(F.col("d.prediction") - F.col("prediction"))
    near = gap <= F.lit(caliper) * F.greatest(F.abs(F.col("prediction")), F.lit(1e-12))
    fills = (
        asking.join(donors, ["_group", "field_name", "_bin"]).where(near)
        .groupBy("_coarse", "_fine", "field_name", "tier", "prediction", "support", F.col("c_n").alias("coarse_n"), F.col("c_low").alias("coarse_low"), F.col("c_high").alias("coarse_high"))
        .agg(F.min(F.struct(gap.alias("gap"), F.col("d.top.donor").alias("donor_id"), F.col("d.top.v").alias("v"))).alias("d"))
        .select("_coarse", "_fine", "field_name", (-F.col("d.v")).alias("fill_value"), "d.donor_id", "tier", "prediction", "support", "coarse_n", "coarse_low", "coarse_high")
    )
    return lacking.alias("a").join(fills.alias("b"), keys).select(F.col("a._id").alias(row_id), "a.field_name", "b.fill_value", "b.donor_id", "b.tier", "b.prediction", "b.support", "b.coarse_n", "b.coarse_low", "b.coarse_high")


def apply_fills(df: DataFrame, fills: DataFrame, row_id: str, fields: list[Field]) -> DataFrame:
    """df with, per field, `<field>__filled` (the value after filling), `<field>__is_filled` and `<field>__donor`.

    Unrecorded values that nothing supports come out NULL and are not marked.
    The id must be unique in df, or repeated rows must lack the same fields.
    """
    wide = fills.groupBy(row_id).agg(*[F.max(F.when(F.col("field_name") == f.name, F.struct("fill_value", "donor_id"))).alias(f"_f{i}") for i, f in enumerate(fields)])
    out = df.join(wide, row_id, "left")
    new = []
    for i, f in enumerate(fields):
        x = F.col(f"`{f.name}`")
        ok = F.coalesce(~F.isnan(x) & x.between(f.low, f.high), F.lit(False))
        new += [F.when(ok, x).otherwise(F.col(f"_f{i}.fill_value")).alias(f"{f.name}__filled"), (~ok & F.col(f"_f{i}").isNotNull()).alias(f"{f.name}__is_filled"), F.when(~ok, F.col(f"_f{i}.donor_id")).alias(f"{f.name}__donor")]
    return out.select(*[df[c] for c in df.columns], *new)


__all__ = ["Field", "predictive_mean_fill", "apply_fills"]
