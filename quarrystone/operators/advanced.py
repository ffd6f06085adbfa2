"""Covariances and their uses, corrected cluster errors, posteriors on a grid, size studies, stacking, replays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_covariance(df: DataFrame, cell: list[str], item: str, value: str, least_pairs: int) -> DataFrame:
    """(a, b, n, covariance) of item pairs measured in the same cells, with a <= b; pairs with fewer than least_pairs cells are left out.

    Values are averaged per (cell, item) first, so a cell contributes each pair once.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*cell, item).agg(F.avg(value).alias("v"))
    x, y = c.alias("x"), c.alias("y")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in cell] + [F.col(f"x.{item}") <= F.col(f"y.{item}")]
    return x.join(y, on).groupBy(F.col(f"x.{item}").alias("a"), F.col(f"y.{item}").alias("b")).agg(F.count("*").alias("n"), F.covar_samp("x.v", "y.v").alias("covariance")).where(F.col("n") >= least_pairs)


def _matrix(covariance: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
    rows = covariance.limit(most * most + 1).collect()
    if len(rows) > most * most:
        raise ValueError(f"more than {most} items")
    items = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    m = np.zeros((len(items), len(items)))
    for r in rows:
        i, j = items.index(r["a"]), items.index(r["b"])
        m[i, j] = m[j, i] = r["covariance"]
    return items, m


def nearest_positive(m: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """The symmetric matrix with its negative eigenvalues raised to the floor."""
    value, vector = np.linalg.eigh((m + m.T) / 2)
    return (vector * np.maximum(value, floor)) @ vector.T


def blup(df: DataFrame, cell: str, item: str, value: str, covariance: DataFrame, noise: float, most: int = 200) -> DataFrame:
    """(cell, item, estimate, observed): the best linear unbiased prediction of every item of a cell from the items measured in it.

    The item table is small and checked (most); cells are few rows each and pass through Arrow batches in groups.
    """
    items, m = _matrix(covariance, most)
    m = nearest_positive(m)
    means = dict(df.where(F.col(value).isNotNull() & F.col(item).isin(*items)).groupBy(item).agg(F.avg(value)).collect())  # the items of the matrix, at most `most`
    mu = np.array([means[i] for i in items])
    kind = dict(df.dtypes)[cell]
    per = df.where(F.col(value).isNotNull() & F.col(item).isin(*items)).groupBy(cell, item).agg(F.avg(value).alias("v")).groupBy(cell).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(item, "v")))).alias("seen"))

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {i: k for k, i in enumerate(items)}
        for frame in frames:
            parts = []
            for name, seen in zip(frame[cell], frame["seen"], strict=True):
                o = np.array([at[i] for i in seen])
                y = np.array(list(seen.values()))
                gain = np.linalg.solve(m[np.ix_(o, o)] + noise * np.eye(len(o)), y - mu[o])
                parts.append(pd.DataFrame({cell: name, "item": items, "estimate": mu + m[:, o] @ gain, "observed": [i in seen for i in items]}))
            if parts:
                yield pd.concat(parts)

    return per.mapInPandas(predict, f"{cell} {kind}, item string, estimate double, observed boolean")


def principal_shapes(spark, covariance: DataFrame, k: int, most: int = 200) -> DataFrame:
    """(component, item, loading, share): the leading shapes of a covariance, signed so that the loadings' sum is not negative."""
    items, m = _matrix(covariance, most)
    value, vector = np.linalg.eigh((m + m.T) / 2)
    rows = []
    for c in range(min(k, len(items))):
        v = vector[:, -1 - c] * (1 if vector[:, -1 - c].sum() >= 0 else -1)
        rows += [(c, i, float(x), float(value[-1 - c] / value.clip(0).sum())) for i, x in zip(items, v, strict=True)]
    return spark.createDataFrame(rows, "component int, item string, loading double, share double")


def corrected_errors(blocks: DataFrame) -> DataFrame:
    """One row: the mean's cluster-robust errors with each cluster's residual sum scaled by its leverage: CR2 (square root) and CR3 (whole)."""
    s, n = blocks.agg(F.sum("s")).scalar(), blocks.agg(F.sum("n")).scalar()
    e = F.col("s") - s / n * F.col("n")
    keep = 1 - F.col("n") / n
    total = F.sum("n")
    return blocks.where(keep > 0).agg((F.sqrt(F.sum(e * e / keep)) / total).alias("cr2"), (F.sqrt(F.sum(e * e / (keep * keep))) / total).alias("cr3"))


def grid_posterior(blocks: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, weight, mu): the posterior of the between-block deviation on a grid (flat priors), and the mean given each; blocks give their means and variances of the mean."""
    b = blocks.where("n > 1").select((F.col("s") / F.col("n")).alias("m"), F.greatest((F.col("s2") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1) / F.col("n"), F.lit(1e-12)).alias("v"))
    g = b.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    w = 1 / (F.col("v") + F.col("tau") * F.col("tau"))
    per = g.groupBy("tau").agg(F.sum(w).alias("w"), F.sum(w * F.col("m")).alias("wm"), F.sum(w * F.col("m") * F.col("m")).alias("wmm"), F.sum(F.ln(w)).alias("lw"))
    fit = per.select("tau", (F.col("wm") / F.col("w")).alias("mu"), (0.5 * F.col("lw") - 0.5 * F.ln("w") - 0.5 * (F.col("wmm") - F.col("wm") * F.col("wm") / F.col("w"))).alias("l"))
    all_ = Window.partitionBy(F.lit(1))  # one row per grid point
    p = F.exp(F.col("l") - F.max("l").over(all_))
    return fit.withColumn("p", p).select("tau", (F.col("p") / F.sum("p").over(all_)).alias("weight"), "mu")


def size_study(spark, sizes: list[int], between: float, sims: int, seed: int) -> DataFrame:
    """(sim, t): t statistics of simulated null data with the given cluster sizes and between-cluster deviation; each simulation depends on (seed, sim) only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.array(sizes, float)
        for frame in frames:
            out = []
            for i in frame["id"]:
                rng = np.random.default_rng([seed, int(i)])
                s = n * between * rng.standard_normal(len(n)) + np.sqrt(n) * rng.standard_normal(len(n))
                m = s.sum() / n.sum()
                g = len(n)
                out.append(m / (np.sqrt(((s - m * n) ** 2).sum() * g / (g - 1)) / n.sum()))
            yield pd.DataFrame({"sim": frame["id"], "t": out})

    return spark.range(sims).mapInPandas(run, "sim long, t double")


def simplex_weights(df: DataFrame, truth: str, arms: list[str], rounds: int = 2000) -> list[float]:
    """Non-negative weights of sum 1 that minimise the squared error of the mixed arms: one aggregate of products, solved on the driver."""
    row = df.agg(*[F.avg((F.col(a) - F.col(truth)) * (F.col(b) - F.col(truth))).alias(f"g{i}_{j}") for i, a in enumerate(arms) for j, b in enumerate(arms)]).first()
    g = np.array([[row[f"g{i}_{j}"] for j in range(len(arms))] for i in range(len(arms))], float)
    w = np.full(len(arms), 1 / len(arms))
    step = 1 / max(np.linalg.eigvalsh(g).max(), 1e-12)
    for _ in range(rounds):
        v = w - step * (g @ w)
        u = np.sort(v)[::-1]
        c = np.cumsum(u) - 1
        k = np.flatnonzero(u - c / np.arange(1, len(u) + 1) > 0)[-1]
        w = np.maximum(v - c[k] / (k + 1), 0)
    return [float(x) for x in w]


def replay(df: DataFrame, unit: str, order: list[Column], value: str, checkpoints: list[int]) -> DataFrame:
    """(unit, k, estimate, n_rest, mae_rest): revealing a unit's rows in order, the mean of the first k and its error on the rest."""
    w = Window.partitionBy(unit)
    x = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(*order)))
    x = x.withColumn("k", F.explode(F.array(*[F.lit(c) for c in checkpoints])))
    seen = F.avg(F.when(F.col("_r") <= F.col("k"), F.col(value))).over(Window.partitionBy(unit, "k"))
    rest = F.col("_r") > F.col("k")
    return x.withColumn("estimate", seen).groupBy(unit, "k").agg(F.first("estimate").alias("estimate"), F.count_if(rest).alias("n_rest"), F.avg(F.when(rest, F.abs(F.col(value) - F.col("estimate")))).alias("mae_rest"))


def rank_product(df: DataFrame, by: list[str], scores: list[str], row_id: str) -> DataFrame:
    """df with `product`, the product of its mean ranks by every score (highest first), and `place` by it; ties to smaller ids."""
    w = Window.partitionBy(*by)
    product = F.lit(1.0)
    for s in scores:
        product = product * (F.rank().over(w.orderBy(F.desc(s))) + (F.count("*").over(Window.partitionBy(*by, s)) - 1) / 2)
    x = df.withColumn("product", product)
    return x.withColumn("place", F.row_number().over(w.orderBy("product", row_id)))


def schema_document(df: DataFrame) -> DataFrame:
    """(column_name, kind, n_filled, n_distinct) of every column, from one aggregate."""
    names = df.columns
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(names)], *[F.approx_count_distinct(F.col(f"`{c}`").cast("string")).alias(f"d{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("kind"), F.col(f"f{i}").alias("n_filled"), F.col(f"d{i}").alias("about_distinct")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.inline(F.array(*rows)))
