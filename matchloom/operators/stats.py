"""Paired statistics of methods: (method, pair_id, metric)."""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(df: DataFrame, metric: str) -> DataFrame:
    """(a, b, pair_id, x, y) of all ordered pairs of different methods on the pair_ids they share."""
    left = df.select("pair_id", F.col("method").alias("a"), F.col(metric).alias("x"))
    right = df.select("pair_id", F.col("method").alias("b"), F.col(metric).alias("y"))
    return left.join(right, "pair_id").where("a <> b")


def winrates(df: DataFrame, metric: str) -> DataFrame:
    """(a, b, wins, ties, losses, support, winrate_no_ties, winrate_half_ties, cliff_delta, mean_delta, median_delta)."""
    x, y = F.col("x"), F.col("y")
    n = lambda c: F.count(F.when(c, 1))
    agg = paired(df, metric).groupBy("a", "b").agg(
        n(x > y).alias("wins"), n(x == y).alias("ties"), n(x < y).alias("losses"), F.count(F.lit(1)).alias("support"),
        F.avg(x - y).alias("mean_delta"), F.median(x - y).alias("median_delta"),
    )
    wins, losses, ties = F.col("wins"), F.col("losses"), F.col("ties")
    return agg.withColumns(
        {
            "winrate_no_ties": F.when(wins + losses > 0, 100.0 * wins / (wins + losses)),
            "winrate_half_ties": (wins + 0.5 * ties) / F.col("support"),
            "cliff_delta": (wins - losses) / F.col("support"),
        }
    )


def winrate_matrix(df: DataFrame, metric: str, methods: list[str], value: str = "winrate_no_ties") -> DataFrame:
    """One row and one column for each of ``methods``; the diagonal is null."""
    return winrates(df, metric).groupBy(F.col("a").alias("method")).pivot("b", methods).agg(F.first(value))


def against_best(df: DataFrame, metric: str, prefix: str) -> DataFrame:
    """Win rates of the best method whose name starts with ``prefix`` against every other."""
    mean = df.where(F.col("method").startswith(prefix)).groupBy("method").agg(F.avg(metric).alias("m"))
    best = mean.agg(F.max(F.struct("m", "method")).alias("b")).select(F.col("b.method").alias("a"))
    return winrates(df, metric).join(F.broadcast(best), "a", "left_semi")  # one row


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided binomial; not a number without decisions."""
    n, k = wins + losses, min(wins, losses)
    if not n:
        return float("nan")
    term = total = 1.0  # C(n, i) / C(n, k) from i = k down: the ratios fall, so what is left out is below rounding
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        if term < 1e-18 * total:
            break
        total += term
    return min(1.0, 2 * total * (comb(n, k) / 2**n))


def sign_test_column(wins: Column, losses: Column) -> Column:
    @F.pandas_udf("double")
    def p(w: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([sign_test(int(a), int(b)) for a, b in zip(w, x, strict=True)])

    return p(wins, losses)


def wilcoxon(deltas: np.ndarray, alternative: str = "two-sided") -> float:
    """Signed-rank test on the non-zero deltas: exact for up to 25 without ties, else normal with tie correction."""
    d = deltas[deltas != 0]
    n = len(d)
    if not n:
        return float("nan")
    size = np.abs(d)
    order = np.argsort(size, kind="stable")
    values, back, times = np.unique(size, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(times) - (times - 1) / 2)[back]
    del order
    w = float(ranks[d > 0].sum())
    if n <= 25 and len(values) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        low, high = ways[: int(w) + 1].sum() / 2.0**n, ways[int(w) :].sum() / 2.0**n
        return float(high if alternative == "greater" else min(1.0, 2 * min(low, high)))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - (times**3 - times).sum() / 48
    z = (w - mean) / sqrt(var) if var > 0 else 0.0
    upper = 0.5 * (1 - erf(z / sqrt(2)))
    return float(upper if alternative == "greater" else min(1.0, 2 * min(upper, 1 - upper)))


def wilcoxon_column(deltas: Column) -> Column:
    """Of an array of deltas: one number for each pair that two methods share."""

    @F.pandas_udf("double")
    def p(d: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon(np.asarray(x, float)) for x in d])

    return p(deltas)


def wilcoxon_by_pair_of_methods(df: DataFrame, metric: str, alternative: str = "two-sided") -> DataFrame:
    """(a, b, wilcoxon_p). A group holds one number for each pair_id two methods share."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        p = wilcoxon((pdf["x"] - pdf["y"]).to_numpy(float), alternative)
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "wilcoxon_p": [p]})

    return paired(df, metric).groupBy("a", "b").applyInPandas(test, "a string, b string, wilcoxon_p double")


def holm(df: DataFrame, p: str, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``holm_p``: the running maximum of p times the tests left, at most 1."""
    w = Window.partitionBy(*keys).orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    step = F.col(p) * (m - F.row_number().over(w) + 1)
    return df.withColumn("__s", step).withColumn(
        "holm_p", F.least(F.lit(1.0), F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ).drop("__s")
