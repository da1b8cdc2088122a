"""Statistics of paired evaluations: intervals, exact tests, corrections, resampling and the quantiles in use."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, clamped to [0, 1]; NaN without trials."""
    n = trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    nan = F.lit(float("nan"))
    return F.when(n > 0, low).otherwise(nan), F.when(n > 0, high).otherwise(nan)


def _lower_tail(low: int, n: int) -> float:
    """The chance of at most ``low`` successes in ``n`` fair trials. Whole numbers up to 500 trials; beyond, terms from the
    largest down, until they no longer count: about the square root of n of them."""
    if n <= 500:
        return sum(math.comb(n, i) for i in range(low + 1)) / 2**n
    first = math.exp(math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2))
    total = term = 1.0
    for i in range(low, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, first * total)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k successes in n fair trials: all outcomes no likelier than the observed one, which for fair
    trials are the two tails."""
    low = min(k, n - k)
    return 1.0 if 2 * low >= n - 1 else min(1.0, 2 * _lower_tail(low, n))


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided sign test over decided trials; 1 without any."""
    return binomial_two_sided(wins, wins + losses)


def binomial_p(k: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([binomial_two_sided(int(x), int(y)) for x, y in zip(a, b)])

    return p(k, n)


def sign_p(wins: Column, losses: Column) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sign_test(int(x), int(y)) for x, y in zip(a, b)])

    return p(wins, losses)


def holm(df: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """``df`` with ``p_holm``, step-down adjusted inside each family; equal p are taken in the given order."""
    by = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    ranked = by.orderBy(p, *order)
    m = F.count("*").over(by)
    step = F.least(F.lit(1.0), (m - F.row_number().over(ranked) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def paired_bootstrap(deltas: np.ndarray, resamples: int = 10_000, seed: int = 42) -> tuple[float, float, float]:
    """Percentile interval of the mean and the sign-flip permutation p of paired differences."""
    rng = np.random.default_rng(seed)
    n = len(deltas)
    low, high, hits, done = [], [], 0, 0
    means = np.empty(resamples)
    step = max(1, 2_000_000 // max(1, n))
    while done < resamples:
        b = min(step, resamples - done)
        means[done : done + b] = deltas[rng.integers(0, n, (b, n))].mean(1)
        done += b
    low, high = np.percentile(means, [2.5, 97.5])
    observed, done = abs(deltas.mean()), 0
    while done < resamples:
        b = min(step, resamples - done)
        hits += int((np.abs((rng.choice([-1.0, 1.0], (b, n)) * deltas).mean(1)) >= observed - 1e-12).sum())
        done += b
    return float(low), float(high), (hits + 1) / (resamples + 1)


def bootstrap_by(df: DataFrame, family: str, value: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean, interval and p of paired differences per family. A family is one comparison of evaluations; its differences
    are first counted by value, so what a task gets is bounded by the number of distinct differences."""
    return bootstrap_counts(df.groupBy(family, value).agg(F.count("*").alias("n")), [family], value, "n", resamples, seed)


def bootstrap_counts(counted: DataFrame, family: list[str], value: str, count: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """``family`` columns, ``n``, ``mean``, percentile interval (``low``, ``high``) and sign-flip ``p`` of differences that
    are given as counts of distinct values. Resamples are drawn as multinomial and binomial counts of the values, a bounded
    number of them at once."""
    kinds = ", ".join(f"{c} {counted.schema[c].dataType.simpleString()}" for c in family)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        values, n = pdf[value].to_numpy(float), pdf[count].to_numpy()
        rng = np.random.default_rng(seed)
        total = int(n.sum())
        step = max(1, 2_000_000 // len(n))
        lots = [min(step, resamples - at) for at in range(0, resamples, step)]
        means = np.concatenate([rng.multinomial(total, n / total, b) @ values / total for b in lots])
        low, high = np.percentile(means, [2.5, 97.5])
        observed = abs(float(values @ n) / total)
        hits = sum(int((np.abs((2 * rng.binomial(n, 0.5, (b, len(n))) - n) @ values / total) >= observed - 1e-12).sum()) for b in lots)
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in family} | {"n": [total], "mean": [float(values @ n) / total], "low": [low], "high": [high], "p": [(hits + 1) / (resamples + 1)]})

    return counted.groupBy(*family).applyInPandas(run, f"{kinds}, n long, mean double, low double, high double, p double")


def bootstrap_mean(values: list[float], resamples: int = 2_000, seed: int = 42, short: bool = False) -> tuple[float, float]:
    """Interval of the mean with the standard library's generator; ``short`` takes one index less at the upper end."""
    rng = random.Random(seed)
    n = len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    top = int(0.975 * resamples) - 1 if short else min(resamples - 1, int(0.975 * resamples))
    return means[int(0.025 * resamples)], means[top]


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles per group from counts of distinct values. ``wanted`` names columns with a kind and a share q:
    ``half_even`` is the value at index round(q * (n - 1)), halves to the even index; ``nearest_rank`` that at index
    ceil(q * n) - 1; ``linear`` lies between the values around (n - 1) * q. Nulls don't count."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_c").over(Window.partitionBy(*by))
    c = counted.withColumn("_to", upto).withColumn("_n", total)
    at = lambda i: F.min(F.when(F.col("_to") > i, F.col(value)))
    cols = []
    for name, (kind, q) in wanted.items():
        n = F.col("_n")
        if kind == "half_even":
            cols.append(at(F.bround(F.lit(q) * (n - 1), 0)).cast("double").alias(name))
        elif kind == "nearest_rank":
            cols.append(at(F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0))).cast("double").alias(name))
        else:
            place = F.lit(q) * (n - 1)
            share = F.max(place - F.floor(place))
            cols.append((at(F.floor(place)) * (1 - share) + at(F.ceil(place)) * share).alias(name))
    return c.groupBy(*by).agg(*cols)


def guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation, NaN where either side is constant."""
    flat = (F.coalesce(F.stddev_pop(a), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(b), F.lit(0.0)) == 0)
    cov, sa, sb = F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)
    return F.when(flat, F.lit(float("nan"))).otherwise(F.try_divide(cov, sa * sb))


def bin_index(value: Column, edges: list[float]) -> Column:
    """Right-open bins by their edges; whatever lies outside goes to the last bin."""
    out = F.lit(len(edges) - 2)
    for i in reversed(range(len(edges) - 1)):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def sign_flip(delta: Column, baseline: Column) -> Column:
    """Whether a difference contradicts the baseline; no difference or no baseline counts as a flip."""
    return (delta == 0) | (baseline == 0) | (F.signum(delta) != F.signum(baseline))


def outcome_score(outcome: Column) -> Column:
    return F.when(outcome == "win", 1.0).when(outcome == "tie", 0.5).otherwise(0.0)
