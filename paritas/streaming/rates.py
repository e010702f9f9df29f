"""Running fairness rates over a stream: an extension; the rates are sums, so windows merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.operators.fairness import group_counts


def windowed_counts(stream: DataFrame, ts: str, attrs: Sequence[str], target: str, prediction: str | None, positive, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """group_counts per tumbling window; later rows than the watermark allows are left out.  Works on batches too."""
    timed = stream.withWatermark(ts, late).withColumn("window", F.window(ts, window))
    return group_counts(timed, ["window", *attrs], target, prediction, positive)


def windowed_rates(stream: DataFrame, ts: str, attrs: Sequence[str], target: str, prediction: str | None, positive, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, attrs and the rates of each window."""
    counts = windowed_counts(stream, ts, attrs, target, prediction, positive, window, late)
    return counts.select(
        F.col("window.start").alias("window_start"),
        *attrs,
        "n",
        F.try_divide("correct", "n").alias("accuracy"),
        F.try_divide("p", "n").alias("statistical_parity"),
        F.try_divide("p_actual", "n_actual").alias("equal_opportunity"),
        F.try_divide("p_other", "n_other").alias("false_positive_rate"),
    )
