"""Filters and summaries of score tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INFINITY)


def z_filter(df: DataFrame, score: str = "log_score", threshold: float = 3.0) -> DataFrame:
    """Outliers by z-score with the population deviation of the finite rows; infinite rows always stay."""
    x = F.col(score)
    stats = df.where(is_finite(x)).agg(F.avg(score).alias("__mean"), F.stddev_pop(score).alias("__dev"))
    z = F.try_divide(x - F.col("__mean"), F.col("__dev"))
    return df.crossJoin(F.broadcast(stats)).where((F.abs(x) == INFINITY) | (z < -threshold) | (z > threshold)).drop("__mean", "__dev")  # stats is one row


def disparity_filter(df: DataFrame, score: str = "count_disparity", threshold: float = 0.5) -> DataFrame:
    return df.where(F.abs(score) >= threshold)


def pos_filter(df: DataFrame, pos: str = "ADJ") -> DataFrame:
    return df.where(F.col("pos") == pos)


def profession_filter(df: DataFrame, professions: DataFrame, word: str = "words", pos: str | None = "NOUN") -> DataFrame:
    """Rows whose word is in professions (column word), and whose part of speech is pos if one is asked for."""
    out = df.join(professions.select(F.col("word").alias(word)).distinct(), word, "left_semi")
    return out if pos is None else out.where(F.col("pos") == pos)


def finite_summary(df: DataFrame, score: str) -> DataFrame:
    """One row: n, mean and sample deviation of the finite values (null deviation under two)."""
    return df.where(is_finite(F.col(score))).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("stdev"))


def t_quantile(p: float, df: int) -> float:
    """The quantile of Student's t, by bisection on the regularised incomplete beta function."""
    def beta_fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    def incomplete(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b

    def cdf(t: float) -> float:
        tail = incomplete(df / 2, 0.5, df / (df + t * t)) / 2
        return 1 - tail if t > 0 else tail

    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def confidence(df: DataFrame, score: str, level: float = 0.95) -> DataFrame:
    """finite_summary with margin: half the width of the t interval, null under two values.  The quantile is found where the one row of the summary is."""
    def quantiles(n: pd.Series) -> pd.Series:
        return pd.Series([t_quantile((1 + level) / 2, int(k) - 1) if k >= 2 else None for k in n], dtype="float64")

    quantile = F.pandas_udf(quantiles, "double")
    return finite_summary(df, score).withColumn("margin", F.col("stdev") / F.sqrt("n") * quantile("n"))
