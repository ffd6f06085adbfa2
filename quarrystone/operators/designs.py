"""Further designs: held-out metals, halves, thinning, pools, arms on fixed tests, guards, greedy balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.keys import hash_order
from quarrystone.operators.folds import global_rank


def eligible_holdouts(df: DataFrame, state: str, system: str, least_rows: int, least_systems: int) -> DataFrame:
    """(state, n_rows, n_systems): the values of `state` with enough rows and systems to be held out whole."""
    per = df.where(F.col(state).isNotNull()).groupBy(state).agg(F.count("*").alias("n_rows"), F.count_distinct(system).alias("n_systems"))
    return per.where((F.col("n_rows") >= least_rows) & (F.col("n_systems") >= least_systems))


def random_folds(df: DataFrame, row_id: str, k: int, seed: int) -> DataFrame:
    """df with `fold` by the hash of the row id: the diagnostic split that keeps nothing together."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))


def halves(groups: DataFrame, group: str, size: str, stratum: str, salt: str) -> DataFrame:
    """groups with `half` 'selection' or 'confirmation': within each stratum, heaviest first (ties by salted hash), dealt in the order A B B A."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc(size), F.md5(F.concat(F.lit(salt), F.col(group)))))
    return groups.withColumn("_p", place).withColumn("half", F.when(F.pmod(F.col("_p"), F.lit(4)).isin(1, 0), "selection").otherwise("confirmation")).drop("_p")


def thinned(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Rows of k groups, the first in hashed order."""
    keep = df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(hash_order(F.lit(seed), F.col(group)), group).limit(k)
    return df.join(keep, group, "left_semi")


def pool_and_evaluation(df: DataFrame, unit: str, row_id: str, seed: int, cap: int) -> DataFrame:
    """df with `part`: per unit, max(2, n // 2) rows in hashed order are 'evaluation', the next `cap` are 'pool', the rest 'unused'."""
    w = Window.partitionBy(unit)
    ranked = global_rank(df, hash_order(F.lit(seed), F.col(row_id)), [unit])
    n = F.count("*").over(w)
    cut = F.greatest(F.lit(2), F.floor(n / 2))
    return ranked.withColumn("part", F.when(F.col("rank") < cut, "evaluation").when(F.col("rank") < cut + cap, "pool").otherwise("unused")).drop("rank")


def fixed_test_arms(core: DataFrame, extra: DataFrame, row_id: str, fold: str, k: int, seed: int) -> DataFrame:
    """(arm, held_fold, row_id, role): the same test rows in every arm; training is the core's other folds (BASE), also all extra rows
    (EXPANDED), or the core with as many of its rows replaced by extra ones as there are (ROWMATCHED)."""
    test = core.select(F.explode(F.array(*[F.lit(a) for a in ("BASE", "EXPANDED", "ROWMATCHED")])).alias("arm"), F.col(fold).alias("held_fold"), row_id, F.lit("test").alias("role"))
    n_extra = extra.agg(F.count("*")).scalar()
    listed = F.array(*[F.lit(i) for i in range(k)])
    train = core.select(F.explode(F.array_remove(listed, F.col(fold))).alias("held_fold"), row_id)
    base = train.select(F.lit("BASE").alias("arm"), "held_fold", row_id, F.lit("train").alias("role"))
    more = extra.select(F.explode(listed).alias("held_fold"), row_id)
    expanded = train.unionByName(more).select(F.lit("EXPANDED").alias("arm"), "held_fold", row_id, F.lit("train").alias("role"))
    ranked = global_rank(train, hash_order(F.lit(seed), F.col("held_fold"), F.col(row_id)), ["held_fold"])
    matched = ranked.where(F.col("rank") >= n_extra).select("held_fold", row_id).unionByName(more).select(F.lit("ROWMATCHED").alias("arm"), "held_fold", row_id, F.lit("train").alias("role"))
    return test.unionByName(base).unionByName(expanded).unionByName(matched)


def guarded(scored: DataFrame, registered: DataFrame, row_id: str) -> DataFrame:
    """scored as it is; when run, it raises if it holds a row of the registered hold-out."""
    mark = registered.select(row_id).distinct().withColumn("_held", F.lit(True))
    checked = F.when(F.col("_held"), F.raise_error(F.concat(F.lit("held-out row scored: "), F.col(row_id).cast("string")))).otherwise(F.lit(True))
    return scored.join(mark, row_id, "left").withColumn("_ok", checked.cast("boolean")).where("_ok").drop("_held", "_ok")


def greedy_bins(sizes: list[tuple[str, int]], bins: int) -> dict[str, int]:
    """Units to bins, heaviest first to the lightest bin, ties to the lower bin: for the small unit tables of a design."""
    load, out = [0] * bins, {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        b = min(range(bins), key=lambda i: (load[i], i))
        out[name] = b
        load[b] += n
    return out


def closest_fit(sizes: list[tuple[str, int]], need: int) -> list[str]:
    """Units dropped one after another, each time the one whose size is nearest what is still needed, until the need is met: the structure-matched control."""
    left, out = dict(sizes), []
    while need > 0 and left:
        pick = min(left, key=lambda u: (abs(left[u] - need), u))
        need -= left.pop(pick)
        out.append(pick)
    return out


def constant_mean(value: str) -> Column:
    """The mean of a group's values if they are all one value, else NULL."""
    return F.when(F.count_distinct(value) <= 1, F.avg(value))
