"""Statistics that SQL lacks: tails of distributions and the paired bootstrap."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chi2_tail(x: float, df: int) -> float:
    """The upper tail of the chi-square distribution with a whole number of degrees of freedom."""
    if df <= 0 or x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for k in range(1, (df + 1) // 2):
        total += term
        term *= half / (k + 0.5)
    return min(1.0, total)


def mcnemar_p(b: int, c: int) -> float:
    """Two-sided exact binomial p-value of b against c discordant pairs."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    top = math.lgamma(n + 1) - n * math.log(2)
    return min(1.0, 2 * math.fsum(math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1)) for i in range(k + 1)))


def chi2_sf(statistic: str, df: str) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(a, int(b)) for a, b in zip(x, d)], dtype="float64")

    return tail(F.col(statistic), F.col(df))


def mcnemar_exact(b: str, c: str) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(i), int(j)) for i, j in zip(x, y)], dtype="float64")

    return p(F.col(b), F.col(c))


def bootstrap_ci(pairs: DataFrame, by: tuple[str, ...], a: str, b: str, resamples: int = 5000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """ci_low, ci_high of the mean paired difference of each group, by resampling of its pairs (A10).

    A group is gathered as its distinct differences and how often each occurs: three for 0/1 outcomes, whatever the
    group's size. A resample is a multinomial draw of these counts, which is the distribution of as many drawn pairs.
    Pairs with a null have no difference and are left out.
    """
    import numpy as np

    difference = (F.col(a) - F.col(b)).cast("double")
    counts = pairs.groupBy(*by, difference.alias("_d")).agg(F.count("*").alias("_n")).filter("_d is not null")
    gathered = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_d", "_n"))).alias("_counts"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for found in frame["_counts"]:
            d, n = np.array([x["_d"] for x in found]), np.array([x["_n"] for x in found])
            rng = np.random.default_rng([seed, *n.tolist()])
            some = max(1, 1_000_000 // len(d))  # resamples held at once
            drawn = np.sort(np.concatenate([rng.multinomial(n.sum(), n / n.sum(), min(some, resamples - at)) @ d for at in range(0, resamples, some)]) / n.sum())
            out.append((float(drawn[int(alpha / 2 * resamples)]), float(drawn[int((1 - alpha / 2) * resamples) - 1])))
        return frame[list(by)].assign(ci_low=[x for x, _ in out], ci_high=[x for _, x in out])

    kinds = ", ".join(f"{c} {gathered.schema[c].dataType.simpleString()}" for c in by)
    return gathered.mapInPandas(lambda frames: map(draw, frames), f"{kinds}, ci_low double, ci_high double")


def drawn_indices(n: int, resamples: int, seed: int = 42):
    """The indices below n that Python's generator draws after ``random.seed(seed)``, n for each resample, in arrays of whole
    resamples: words of the Mersenne twister, cut to the bits of n, and passed over where they are not below it."""
    import numpy as np

    bits = np.random.RandomState([seed])._bit_generator
    shift, left, done = np.uint64(32 - n.bit_length()), np.empty(0, np.int64), 0
    while done < resamples:
        words = bits.random_raw(max(1 << 16, 2 * n)) >> shift
        left = np.concatenate([left, words[words < n].astype(np.int64)])
        whole = min(len(left) // n, resamples - done)
        if whole:
            yield left[: whole * n].reshape(whole, n)
            left, done = left[whole * n :], done + whole


def bootstrap_replayed(pairs: DataFrame, by: tuple[str, ...], a: str, b: str, order: tuple[str, ...], resamples: int = 5000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """mean_delta, ci_low, ci_high of each group, with the very draws of Python's generator from that seed, over the group's
    pairs in the given order (A10): equal to the last digit to what a loop over these draws gives.

    A task holds a group's differences, 8 bytes a pair, and draws resamples times as many numbers; groups of a benchmark
    have some thousands of pairs. bootstrap_ci is for groups of any size. Pairs with a null are left out.
    """
    import numpy as np

    rows = pairs.select(*by, *order, (F.col(a) - F.col(b)).cast("double").alias("_d")).filter("_d is not null")

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        d = frame.sort_values(list(order))["_d"].to_numpy()
        means = np.sort(np.concatenate([d[at].mean(axis=1) for at in drawn_indices(len(d), resamples, seed)]))
        low, high = max(0, int(alpha / 2 * resamples)), min(resamples - 1, int((1 - alpha / 2) * resamples) - 1)
        return frame[list(by)].head(1).assign(mean_delta=float(d.mean()), ci_low=float(means[low]), ci_high=float(means[high]))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).applyInPandas(draw, f"{kinds}, mean_delta double, ci_low double, ci_high double")
