"""Bootstrap intervals, paired permutation tests, effect sizes and Holm's correction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
RESAMPLES = 10_000
_BLOCK = 4_000_000


def _blocks(n: int, width: int) -> list[int]:
    """Resamples by blocks of bounded size."""
    rows = max(1, _BLOCK // max(1, width))
    return [min(rows, n - i) for i in range(0, n, rows)]


def _series(pdf: pd.DataFrame, keys: Sequence[str], order: str) -> list[tuple[tuple, pd.DataFrame]]:
    """The groups of a frame, each sorted; a frame is a group where there are no keys."""
    if not keys:
        return [((), pdf.sort_values(order))]
    return [(k if isinstance(k, tuple) else (k,), part.sort_values(order)) for k, part in pdf.groupby(list(keys), sort=True)]


def _by_length(series: list[np.ndarray]) -> dict[int, list[int]]:
    """Which series have which length: those of one length have the same draws."""
    out: dict[int, list[int]] = {}
    for i, x in enumerate(series):
        out.setdefault(len(x), []).append(i)
    return out


def bootstrap_ci(df: DataFrame, by: Sequence[str], value: str, order: str, n: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05, together: Sequence[str] = ()) -> DataFrame:
    """(by, mean, ci95_low, ci95_high, num_queries) per group, finite values only.

    A group is the per-query scores of one system and metric; its rows are sorted by
    ``order``, so that the seed gives the same interval on any partitioning.  The draws
    depend on seed and length alone: groups that differ in ``together`` only share a task,
    and its draws.
    """
    apart = [c for c in by if c not in together]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _series(pdf, together, order)
        xs = [part[value].to_numpy(dtype=float) for _, part in found]
        xs = [x[np.isfinite(x)] for x in xs]
        bounds = [(np.nan, np.nan)] * len(xs)
        for length, members in _by_length(xs).items():
            if length:
                rng = np.random.RandomState(seed)
                means: dict[int, list[np.ndarray]] = {i: [] for i in members}
                for rows in _blocks(n, length):
                    drawn = rng.randint(0, length, size=(rows, length))
                    for i in members:
                        means[i].append(xs[i][drawn].mean(axis=1))
                for i in members:
                    bounds[i] = tuple(np.percentile(np.concatenate(means[i]), [100 * alpha / 2, 100 * (1 - alpha / 2)]))
        rows = [[*(part[c].iloc[0] for c in by), x.mean() if len(x) else np.nan, low, high, len(x)] for (_, part), x, (low, high) in zip(found, xs, bounds)]
        return pd.DataFrame(rows, columns=[*by, "mean", "ci95_low", "ci95_high", "num_queries"])

    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, order, value).groupBy(*apart).applyInPandas(one, f"{types}, mean double, ci95_low double, ci95_high double, num_queries bigint")


def permutation_test(pairs: DataFrame, by: Sequence[str], a: str, b: str, order: str, n: int = RESAMPLES, seed: int = SEED, together: Sequence[str] = ()) -> DataFrame:
    """(by, delta_mean, p_value): two-sided sign-flip test, p = share of flips whose mean
    difference is at least as large in absolute value.  ``together`` as in ``bootstrap_ci``."""
    apart = [c for c in by if c not in together]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _series(pdf, together, order)
        ds = [part[a].to_numpy(dtype=float) - part[b].to_numpy(dtype=float) for _, part in found]
        hits = np.zeros(len(ds), dtype=np.int64)
        for length, members in _by_length(ds).items():
            rng = np.random.RandomState(seed)
            d = np.array([ds[i] for i in members])
            least = np.abs(d.mean(axis=1)) - 1e-12
            for rows in _blocks(n, length):
                flipped = rng.choice([-1.0, 1.0], size=(rows, length)) @ d.T / length
                hits[members] += (np.abs(flipped) >= least).sum(axis=0)
        rows = [[*(part[c].iloc[0] for c in by), float(d.mean()), h / n] for (_, part), d, h in zip(found, ds, hits)]
        return pd.DataFrame(rows, columns=[*by, "delta_mean", "p_value"])

    types = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    return pairs.select(*by, order, a, b).groupBy(*apart).applyInPandas(one, f"{types}, delta_mean double, p_value double")


def method_pairs(scores: DataFrame, by: Sequence[str], method: str, query: str, value: str) -> DataFrame:
    """(by, method_a, method_b, query, a, b) of all pairs of methods on the same query.

    Methods are few per query, so they are paired inside one aggregated row a query.
    """
    g = scores.groupBy(*by, query).agg(F.array_sort(F.collect_list(F.struct(F.col(method).alias("m"), F.col(value).alias("v")))).alias("s"))
    first = g.select(*by, query, F.posexplode("s").alias("i", "x"), "s")
    rest = F.slice(F.col("s"), F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))
    return first.select(*by, query, "x", F.explode(rest).alias("y")).select(
        *by, F.col("x.m").alias("method_a"), F.col("y.m").alias("method_b"), query, F.col("x.v").alias("a"), F.col("y.v").alias("b")
    )


def paired_effect(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, delta_mean, effect_size_dz, effect_label, n); dz is 0 for n < 2 or no spread."""
    d = F.col("a") - F.col("b")
    g = pairs.groupBy(*by).agg(F.avg(d).alias("delta_mean"), F.stddev_samp(d).alias("sd"), F.count("*").alias("n"))
    dz = F.when((F.col("n") < 2) | (F.coalesce("sd", F.lit(0.0)) < 1e-12), 0.0).otherwise(F.col("delta_mean") / F.col("sd"))
    return g.select(*by, "delta_mean", dz.alias("effect_size_dz"), effect_label(dz).alias("effect_label"), "n")


def effect_label(dz: Column) -> Column:
    size = F.abs(dz)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def holm(df: DataFrame, by: Sequence[str], p: str, ties: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Adds p_value_holm and significant_holm_0_05 within each family."""
    w = Window.partitionBy(*by).orderBy(F.col(p), *ties)
    m = F.count("*").over(Window.partitionBy(*by))
    step = df.withColumn("_adjusted", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    out = step.withColumn("p_value_holm", F.max("_adjusted").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("significant_holm_0_05", F.col("p_value_holm") < alpha).drop("_adjusted")


def stars(p: Column, alpha: float = 0.05) -> Column:
    """Significance marks: *** below 0.001, ** below 0.01, * below alpha."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < alpha, "*").otherwise("")
