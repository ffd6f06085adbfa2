"""Sequential selection, few-shot calibration, baselines and simulation.

Policies whose state evolves run as grouped functions, one entity at a time.
Entities of more than CHUNK rows are never gathered: each step of the same
greedy choice is an aggregate over all their rows. Everything else is SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.keys import hash_order
from quarrystone.operators.metrics import beside
from quarrystone.sources.tables import cut


def shrunk_offsets(support: DataFrame, unit: str, residual: str, strength: float) -> DataFrame:
    """(unit, n, offset): the mean residual of a unit's revealed rows, shrunk by n / (n + strength)."""
    return support.where(F.col(residual).isNotNull()).groupBy(unit).agg(F.count("*").alias("n"), (F.avg(residual) * F.count("*") / (F.count("*") + strength)).alias("offset"))


def revealed(df: DataFrame, unit: str, row_id: str, k: int, policy: str, score: str, seed: int = 0) -> DataFrame:
    """df with `revealed`: the k rows of each unit that a policy chooses: RANDOM, MAX_SD (highest score), MIN_SD, CENTRAL (score nearest its unit's mean), MEDIAN_PREDICTION."""
    w = Window.partitionBy(unit)
    order = {
        "RANDOM": hash_order(F.lit(seed), F.col(row_id)),
        "MAX_SD": F.desc(score),
        "MIN_SD": F.asc(score),
        "CENTRAL": F.round(F.abs(F.col(score) - F.avg(score).over(w)), 9),
        "MEDIAN_PREDICTION": F.round(F.abs(F.col(score) - F.percentile(F.col(score), F.lit(0.5)).over(w)), 9),
    }[policy]
    keyed = df.withColumn("_o", order) if policy not in ("MAX_SD", "MIN_SD") else df
    by = F.col("_o") if policy not in ("MAX_SD", "MIN_SD") else order
    return keyed.withColumn("revealed", F.row_number().over(w.orderBy(by, row_id)) <= k).drop("_o")


def acquire(df: DataFrame, unit: str, row_id: str, k: int, policy: str, axes: list[str], prediction: str, spread: str) -> DataFrame:
    """(unit, row_id, place): the k rows of each unit that a policy reveals first. No policy reads the target.

    On the axes, standardised within the unit (rows lacking one take no part): CENTRAL nearest and FARTHEST farthest
    from the unit's centre, MEDOID with the least summed L1 distance to all rows, MID with the last axis nearest its median.
    On the model's output: MEDIAN_PREDICTION nearest the unit's median prediction, MAX_SPREAD and MIN_SPREAD by the spread of
    an ensemble or the disagreement of models. Ties go to smaller ids. Units are reduced to one line of moments each;
    only the final choice orders rows, limited to k before the shuffle.
    """
    x = df
    if policy in ("CENTRAL", "FARTHEST", "MEDOID", "MID"):
        for a in axes:
            x = x.where(F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")))
        x = beside(x, [unit], *[F.avg(a).alias(f"_m{i}") for i, a in enumerate(axes)], *[F.stddev_pop(a).alias(f"_s{i}") for i, a in enumerate(axes)])
        sd = [F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i in range(len(axes))]
    if policy in ("CENTRAL", "FARTHEST"):
        far = F.round(_total([F.pow((F.col(a) - F.col(f"_m{i}")) / sd[i], 2) for i, a in enumerate(axes)]), 9)
        order = far if policy == "CENTRAL" else -far
    elif policy == "MEDOID":
        # The summed distance along an axis comes from running sums over its different values, so no pairs are formed.
        cost = F.lit(0.0)
        for i, a in enumerate(axes):
            w = Window.partitionBy("_u").orderBy("_v")
            values = x.groupBy(F.col(unit).alias("_u"), F.col(a).alias("_v")).agg(F.count("*").alias("_n")).select("_u", "_v", F.sum("_n").over(w).alias("_cn"), F.sum(F.col("_n") * F.col("_v")).over(w).alias("_cs"))
            values = beside(values, ["_u"], F.max("_cn").alias("_tn"), F.max(F.struct("_cn", "_cs")).getField("_cs").alias("_ts"))
            summed = F.col("_v") * F.col("_cn") - F.col("_cs") + (F.col("_ts") - F.col("_cs")) - F.col("_v") * (F.col("_tn") - F.col("_cn"))
            x = x.join(values.select("_u", "_v", summed.alias(f"_c{i}")), F.col(unit).eqNullSafe(F.col("_u")) & (F.col(a) == F.col("_v"))).drop("_u", "_v")
            cost = cost + F.col(f"_c{i}") / sd[i]
        order = F.round(cost, 6)
    elif policy in ("MID", "MEDIAN_PREDICTION"):
        of = axes[-1] if policy == "MID" else prediction
        x = beside(x.where(F.col(of).isNotNull()), [unit], F.median(of).alias("_mid"))
        order = F.round(F.abs(F.col(of) - F.col("_mid")), 9)
    elif policy in ("MAX_SPREAD", "MIN_SPREAD"):
        order = F.round(F.col(spread), 9) * (-1 if policy == "MAX_SPREAD" else 1)
        x = x.where(F.col(spread).isNotNull())
    else:
        raise ValueError(f"no policy {policy}")
    place = F.row_number().over(Window.partitionBy(unit).orderBy("_o", row_id))
    return x.withColumn("_o", order).withColumn("place", place).where(F.col("place") <= k).select(unit, row_id, "place")


def ridge_corrections(support: DataFrame, unit: str, residual: str, columns: list[str], penalty: float) -> DataFrame:
    """(unit, b0, b1, ...): ridge coefficients of a unit's residuals on an unpenalised intercept and up to two columns, from grouped sums, solved in closed form."""
    names = ["1", *columns]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    n = len(names)
    sums = [F.sum(col(a) * col(b)).alias(f"_g{i}{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    g = support.where(F.col(residual).isNotNull()).groupBy(unit).agg(*sums, *[F.sum(col(a) * F.col(residual)).alias(f"_r{i}") for i, a in enumerate(names)])
    m = [[F.col(f"_g{min(i, j)}{max(i, j)}") + (penalty if i == j and i else 0.0) for j in range(n)] for i in range(n)]
    r = [F.col(f"_r{i}") for i in range(n)]

    def det(a):
        if len(a) == 1:
            return a[0][0]
        return reduce(lambda p, q: p + q, [(1 if j % 2 == 0 else -1) * a[0][j] * det([row[:j] + row[j + 1 :] for row in a[1:]]) for j in range(len(a))])

    whole = det(m)
    return g.select(unit, *[(det([[r[i] if j == k else m[i][j] for j in range(n)] for i in range(n)]) / whole).alias(f"b{k}") for k in range(n)])


CHUNK = 100_000


def _sides(df: DataFrame, unit: str, row_id: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of units of up to CHUNK rows; rows of larger units, one per id with all features as numbers x0, x1, ...). The larger are written once, as every step reads them."""
    rows = df.select(unit, row_id, *features)
    large = rows.groupBy(F.col(unit).alias("_unit")).agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNK)
    marked = rows.join(large, F.col(unit).eqNullSafe(F.col("_unit")), "left")
    x = [F.col(f).cast("double") for f in features]
    whole = marked.where(F.col("_n").isNotNull()).select(F.col(unit).alias("_unit"), F.col(row_id).alias("_id"), F.struct(*[c.alias(f"x{i}") for i, c in enumerate(x)]).alias("_x"))
    for i in range(len(x)):
        whole = whole.where(F.col(f"_x.x{i}").isNotNull() & ~F.isnan(f"_x.x{i}"))
    return marked.where("_n IS NULL").select(unit, row_id, *features), cut(whole.groupBy("_unit", "_id").agg(F.min("_x").alias("_x")).select("_unit", "_id", "_x.*"))


def _pick(rows: DataFrame, state: DataFrame | None, order: Column, carried: list[str], point: list[Column]) -> DataFrame:
    """One greedy step for every unit: the row that is first by (order, id) among those not in `ids`, reduced on the map side; `state` has a line per unit with the `carried` columns."""
    entry = F.struct(order.alias("o"), F.col("_id"), F.array(*point).alias("p"))
    if state is None:
        return rows.groupBy("_unit").agg(F.min(entry).alias("_best"))
    s = state.withColumnRenamed("_unit", "_of")
    met = rows.join(F.broadcast(s), F.col("_unit").eqNullSafe(F.col("_of")))  # a line per unit of more than CHUNK rows
    return met.groupBy("_unit").agg(F.min(F.when(~F.array_contains("ids", F.col("_id")), entry)).alias("_best"), *[F.first(c).alias(c) for c in carried])


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _steps(state: DataFrame, unit: str, row_id: str) -> DataFrame:
    return state.select(F.col("_unit").alias(unit), F.posexplode("ids").alias("step", row_id)).select(unit, row_id, "step")


def maxmin_order(df: DataFrame, unit: str, row_id: str, features: list[str], k: int) -> DataFrame:
    """(unit, row_id, step): greedy k-centre: first the row nearest the unit's mean, then each time the row farthest from all chosen; ties to smaller ids."""
    kinds = dict(df.dtypes)

    def choose(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=features).sort_values(row_id, kind="stable").drop_duplicates(row_id)
        x = g[features].to_numpy(float)
        if not len(x):
            return pd.DataFrame({unit: g[unit].to_numpy(), row_id: g[row_id].to_numpy(), "step": np.zeros(0, dtype=np.int32)})
        sd = x.std(0)
        x = (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
        chosen = [int(np.round((x * x).sum(1), 9).argmin())]
        far = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < min(k, len(x)):
            far[chosen] = -1.0
            chosen.append(int(np.round(far, 9).argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        return pd.DataFrame({unit: g[unit].iloc[chosen].to_numpy(), row_id: g[row_id].iloc[chosen].to_numpy(), "step": np.arange(len(chosen), dtype=np.int32)})

    small, rows = _sides(df, unit, row_id, features)
    out = small.groupBy(unit).applyInPandas(choose, f"{unit} {kinds[unit]}, {row_id} {kinds[row_id]}, step int")
    names = range(len(features))
    moments = rows.groupBy(F.col("_unit").alias("_of")).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in names], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in names])
    z = [((F.col(f"x{i}") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0)).alias(f"z{i}") for i in names]
    rows = rows.join(F.broadcast(moments), F.col("_unit").eqNullSafe(F.col("_of"))).select("_unit", "_id", *z)
    point = [F.col(f"z{i}") for i in names]
    state = _pick(rows, None, F.round(_total([c * c for c in point]), 9), [], point).select("_unit", F.array("_best._id").alias("ids"), F.array("_best.p").alias("points"))
    for _ in range(k - 1):
        far = F.array_min(F.transform("points", lambda c: _total([(z - c[i]) * (z - c[i]) for i, z in enumerate(point)])))
        state = _pick(rows, state, -F.round(far, 9), ["ids", "points"], point)
        more = F.col("_best").isNotNull()
        state = state.select("_unit", F.when(more, F.concat("ids", F.array("_best._id"))).otherwise(F.col("ids")).alias("ids"), F.when(more, F.concat("points", F.array("_best.p"))).otherwise(F.col("points")).alias("points"))
    return out.unionByName(_steps(state, unit, row_id))


def d_optimal(df: DataFrame, unit: str, row_id: str, features: list[str], k: int, ridge: float = 1e-3) -> DataFrame:
    """(unit, row_id, step): greedy D-optimal rows: each maximises the determinant of the information matrix."""
    kinds = dict(df.dtypes)

    def choose(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=features).sort_values(row_id, kind="stable").drop_duplicates(row_id)
        x = np.column_stack([np.ones(len(g)), g[features].to_numpy(float)])
        inverse, chosen = np.eye(x.shape[1]) / ridge, []
        for _ in range(min(k, len(x))):
            gain = np.round(np.einsum("ij,jk,ik->i", x, inverse, x), 9)
            gain[chosen] = -1.0
            i = int(gain.argmax())
            chosen.append(i)
            u = inverse @ x[i]
            inverse = inverse - np.outer(u, u) / (1 + x[i] @ u)
        return pd.DataFrame({unit: g[unit].iloc[chosen].to_numpy(), row_id: g[row_id].iloc[chosen].to_numpy(), "step": np.arange(len(chosen), dtype=np.int32)})

    small, rows = _sides(df, unit, row_id, features)
    out = small.groupBy(unit).applyInPandas(choose, f"{unit} {kinds[unit]}, {row_id} {kinds[row_id]}, step int")
    point = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(features))]]
    n = len(point)
    at = lambda i, j: F.get("inverse", F.lit(i * n + j))
    state = rows.select("_unit").distinct().select("_unit", F.array().cast(f"array<{kinds[row_id]}>").alias("ids"), F.array(*[F.lit(1.0 / ridge if i == j else 0.0) for i in range(n) for j in range(n)]).alias("inverse"))
    for _ in range(k):
        gain = _total([point[i] * at(i, j) * point[j] for i in range(n) for j in range(n)])
        state = _pick(rows, state, -F.round(gain, 9), ["ids", "inverse"], point).withColumn("p", F.col("_best.p"))
        state = state.withColumn("u", F.array(*[_total([at(i, j) * F.get("p", F.lit(j)) for j in range(n)]) for i in range(n)]))
        u = [F.get("u", F.lit(i)) for i in range(n)]
        less = F.lit(1.0) + _total([F.get("p", F.lit(i)) * u[i] for i in range(n)])
        more = F.col("_best").isNotNull()
        state = state.select("_unit", F.when(more, F.concat("ids", F.array("_best._id"))).otherwise(F.col("ids")).alias("ids"), F.when(more, F.array(*[at(i, j) - u[i] * u[j] / less for i in range(n) for j in range(n)])).otherwise(F.col("inverse")).alias("inverse"))
    return out.unionByName(_steps(state, unit, row_id))


def baseline_chain(train: DataFrame, test: DataFrame, levels: list[list[str]], y: str) -> DataFrame:
    """test with `prediction` and `level`: the training mean of the most specific group that has one; level counts from 0, the last is the overall mean."""
    out, guesses, marks = test, [], []
    for i, keys in enumerate(levels):
        means = train.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.avg(y).alias(f"_m{i}"))
        out = out.join(means, keys, "left")
        guesses.append(F.col(f"_m{i}"))
        marks.append(F.when(F.col(f"_m{i}").isNotNull(), F.lit(i)))
    overall = train.agg(F.avg(y)).scalar()
    out = out.withColumn("prediction", F.coalesce(*guesses, overall)).withColumn("level", F.coalesce(*marks, F.lit(len(levels))))
    return out.drop(*[f"_m{i}" for i in range(len(levels))])


def domain_flags(rows: DataFrame, reference: DataFrame, columns: list[str], margin: float = 0.0) -> DataFrame:
    """rows with `n_outside` and `distance`: how many columns lie outside the reference's range, and the summed distance in units of the range."""
    box = reference.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    n, total = F.lit(0), F.lit(0.0)
    for c in columns:
        lo, hi = box.select(f"_lo_{c}").scalar(), box.select(f"_hi_{c}").scalar()
        gap = F.greatest(lo - F.col(c), F.col(c) - hi, F.lit(0.0)) / F.greatest(hi - lo, F.lit(1e-12))
        n, total = n + F.coalesce((gap > margin).cast("int"), F.lit(0)), total + F.coalesce(gap, F.lit(0.0))
    return rows.withColumn("n_outside", n).withColumn("distance", total)


def support_score(parts: list[Column]) -> Column:
    """The mean of the parts that are recorded, NULL if none is."""
    total, n = F.lit(0.0), F.lit(0)
    for p in parts:
        total, n = total + F.coalesce(p, F.lit(0.0)), n + p.isNotNull().cast("int")
    return F.when(n > 0, total / n)


def normal_draws(spark, draws: int, columns: dict[str, tuple[float, float, float, float]], rho: float, seed: int) -> DataFrame:
    """A table of Monte Carlo draws: equicorrelated normals (a Gaussian copula), column -> (mean, sd, low, high) truncated by inversion; each draw depends on (seed, draw) only."""
    names = list(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normal = NormalDist()
        for frame in frames:
            out = {"draw": frame["id"].to_numpy()}
            z = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(len(names) + 1) for i in frame["id"]]) if len(frame) else np.zeros((0, len(names) + 1))
            mixed = np.sqrt(rho) * z[:, :1] + np.sqrt(1 - rho) * z[:, 1:]
            for j, name in enumerate(names):
                mean, sd, low, high = columns[name]
                a, b = normal.cdf((low - mean) / sd), normal.cdf((high - mean) / sd)
                u = np.array([normal.cdf(v) for v in mixed[:, j]])
                out[name] = [mean + sd * normal.inv_cdf(min(max(a + x * (b - a), 1e-12), 1 - 1e-12)) for x in u]
            yield pd.DataFrame(out)

    return spark.range(draws).mapInPandas(run, "draw long, " + ", ".join(f"{n} double" for n in names))


def operating_points(draws: DataFrame, by: list[str], goal: Column, limit: Column) -> DataFrame:
    """Per candidate: the shares of draws that meet the goal, keep the limit, and both."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return draws.groupBy(*by).agg(share(goal).alias("p_goal"), share(limit).alias("p_limit"), share(goal & limit).alias("p_both"), F.count("*").alias("n_draws"))
