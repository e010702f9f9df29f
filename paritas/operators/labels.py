"""Multilabel and multiclass evaluation of sets of attribute values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def multilabel_errors(df: DataFrame, values: Sequence[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """A row per value: hits, spurious, missing, correct rejections; one pass over the rows."""
    def both(v: str):
        return F.array_contains(F.col(gold), v), F.array_contains(F.col(predicted), v)

    stats = [F.struct(F.lit(v).alias("label"), F.count_if(g & p).alias("hits"), F.count_if(~g & p).alias("spurious"), F.count_if(g & ~p).alias("missing"), F.count_if(~g & ~p).alias("rejected")) for v in values for g, p in [both(v)]]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def multilabel_scores(df: DataFrame, values: Sequence[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Per label: precision, recall, f1."""
    e = multilabel_errors(df, values, gold, predicted)
    p, r = _ratio(F.col("hits"), F.col("hits") + F.col("spurious")), _ratio(F.col("hits"), F.col("hits") + F.col("missing"))
    return e.select("label", p.alias("precision"), r.alias("recall")).select("label", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def multilabel_summary(df: DataFrame, values: Sequence[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: macro precision, recall, f1; exact-match accuracy over rows and averaged over gold sets."""
    macro = multilabel_scores(df, values, gold, predicted).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    exact = df.select(F.array_sort(F.array_distinct(gold)).alias("g"), F.array_sort(F.array_distinct(predicted)).alias("p"))
    by_set = exact.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == F.col("p")).alias("ok"))
    accuracy = by_set.agg(_ratio(F.sum("ok"), F.sum("n")).alias("micro_accuracy"), F.coalesce(F.avg(F.col("ok") / F.col("n")), F.lit(0.0)).alias("macro_accuracy"))
    return macro.crossJoin(F.broadcast(accuracy))  # one row each


def to_class(values, neutral: str = "neutral"):
    """A set's class: its value if it has one alone, else neutral."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).otherwise(F.lit(neutral))


def multiclass_scores(df: DataFrame, gold: str = "gold", predicted: str = "predicted", neutral: str = "neutral") -> DataFrame:
    """A row per class: n, accuracy; micro_accuracy and macro_accuracy of all are repeated."""
    classes = df.select(to_class(F.col(gold), neutral).alias("class"), to_class(F.col(predicted), neutral).alias("said"))
    per = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == F.col("said")).alias("ok"))
    whole = per.agg(_ratio(F.sum("ok"), F.sum("n")).alias("micro_accuracy"), F.avg(F.col("ok") / F.col("n")).alias("macro_accuracy"))
    return per.select("class", "n", (F.col("ok") / F.col("n")).alias("accuracy")).crossJoin(F.broadcast(whole))  # whole is one row
