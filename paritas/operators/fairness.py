"""Group-fairness rates and their spread over groups.

One aggregation per call serves every metric: sums of conditions per group.  Rows
without a group are aggregated too and left out afterwards, so the total of the
positives is a sum over the groups' few rows and the table is read once.
Multi-valued attributes are exploded into (value, multiplicity) inside the row, so a
row that lists a value twice counts twice among the group's rows but once among its
positives, without a distinct shuffle; one of a row's pieces carries the row's mark
for the total.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy_disparity", "statistical_parity", "equal_opportunity", "false_positive_rate", "equalized_odds", "representation_disparity")
WEIGHT, MARK = "__weight", "__mark"
#: Target values that by_target_value takes in turn.
MOST_TARGETS = 100


def exploded(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """A row for each distinct value of the array attributes, weighted by how often it is listed, one of them marked.

    Empty and null arrays leave one row without a group.
    """
    out = df.withColumn(WEIGHT, F.lit(1)).withColumn(MARK, F.lit(True)) if WEIGHT not in df.columns else df
    for attr in attrs:
        values = F.col(attr)
        counted = F.transform(F.array_distinct(values), _counter(values))
        others = [c for c in out.columns if c not in (attr, WEIGHT, MARK)]
        pieces = out.select(*[F.col(f"`{c}`") for c in others], WEIGHT, MARK, F.posexplode_outer(counted).alias("__at", "__pair"))
        weight = F.col(WEIGHT) * F.coalesce("__pair.n", F.lit(1))
        out = pieces.select(*[F.col(f"`{c}`") for c in others], F.col("__pair.value").alias(attr), weight.alias(WEIGHT), (F.col(MARK) & (F.coalesce("__at", F.lit(0)) == 0)).alias(MARK))
    return out


def _counter(values: Column) -> Callable[[Column], Column]:
    return lambda v: F.struct(v.alias("value"), F.size(F.filter(values, lambda x: x == v)).alias("n"))


def count_columns(df: DataFrame, target: str, predicted: Column, positive) -> list[Column]:
    """Sums per group: rows, correct rows, and rows and predicted positives overall, among true positives, among the rest; marked positives."""
    said = predicted == F.lit(positive)
    actual = F.col(target).eqNullSafe(F.lit(positive))
    weight = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1)
    mark = F.col(MARK) if MARK in df.columns else F.lit(True)
    return [
        F.sum(weight).alias("n"),
        F.sum(F.when(F.col(target) == predicted, weight).otherwise(0)).alias("correct"),
        F.count_if(said).alias("p"),
        F.sum(F.when(actual, weight).otherwise(0)).alias("n_actual"),
        F.count_if(said & actual).alias("p_actual"),
        F.sum(F.when(~actual, weight).otherwise(0)).alias("n_other"),
        F.count_if(said & ~actual).alias("p_other"),
        F.count_if(said & mark).alias("marked"),
    ]


def group_counts(df: DataFrame, attrs: Sequence[str], target: str, prediction: str | None, positive) -> DataFrame:
    """count_columns per group; groups with a null are there too."""
    return df.groupBy(*attrs).agg(*count_columns(df, target, F.col(prediction or target), positive))


def harmonic(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0))


def rates_of(counts: DataFrame, attrs: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """From group_counts: each group's probability by every metric (null: no row in its condition), separately for each value of within."""
    whole = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))  # over the groups' rows, not the table's
    known = F.lit(True)
    for attr in attrs:
        known = known & F.col(attr).isNotNull()
    eo, fpr = F.try_divide("p_actual", "n_actual"), F.try_divide("p_other", "n_other")
    return counts.withColumn("all_positives", F.sum("marked").over(whole)).where(known).select(
        *[c for c in within if c not in attrs],
        *attrs,
        F.try_divide("correct", "n").alias("accuracy_disparity"),
        F.try_divide("p", "n").alias("statistical_parity"),
        eo.alias("equal_opportunity"),
        fpr.alias("false_positive_rate"),
        harmonic(F.coalesce(eo, F.lit(0.0)), F.coalesce(fpr, F.lit(0.0))).alias("equalized_odds"),
        F.try_divide("p", "all_positives").alias("representation_disparity"),
    )


def group_rates(df: DataFrame, attrs: Sequence[str], target: str, prediction: str | None, positive, multivalued: bool = False) -> DataFrame:
    """attrs and one column per metric; one aggregation over df."""
    return rates_of(group_counts(exploded(df, attrs) if multivalued else df, attrs, target, prediction, positive), attrs)


def spread(low: Column, high: Column, mode: str | Callable[[Column, Column], Column] = "difference") -> Column:
    """difference: max - min; ratio: 1 - min / max (0 where max is 0); or a function of (min, max)."""
    if callable(mode):
        return mode(low, high)
    if mode == "difference":
        return high - low
    if mode == "ratio":
        return F.when(high == 0, 0.0).when(high.isNotNull(), 1 - F.try_divide(low, high))
    raise ValueError(f"unknown mode {mode!r}")


def spread_of(metric: str, mode="difference", ndigits: int | None = None, over=None) -> Column:
    """The spread of one metric, as an aggregate or over a window; equalized odds is 1 - F1 of the complements of the two spreads it joins.

    No group gives null.  Rounding (half to even) is applied after the value, and not to equalized odds.
    """
    def seen(c: Column) -> Column:
        return c.over(over) if over is not None else c

    def of(name: str) -> Column:
        return spread(seen(F.min(name)), seen(F.max(name)), mode)

    if metric == "equalized_odds":
        return F.when(seen(F.count(metric)) > 0, 1 - harmonic(1 - of("equal_opportunity"), 1 - of("false_positive_rate"))).cast("double")
    return (of(metric) if ndigits is None else F.bround(of(metric), ndigits)).cast("double")


def spreads(rates: DataFrame, metrics: Sequence[str] = METRICS, mode="difference", ndigits: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row (one for each value of by), a column per metric."""
    return rates.groupBy(*by).agg(*[spread_of(m, mode, ndigits).alias(m) for m in metrics])


def every_group() -> Window:
    """A window over all groups: as many rows as there are groups."""
    return Window.partitionBy(F.lit(1))


def report(df: DataFrame, attrs: Sequence[str], target: str, prediction: str | None, positive, metrics: Sequence[str] = METRICS, mode="difference", multivalued: bool = False, ndigits: int | None = None) -> DataFrame:
    """Long table: metric, value, attrs, prob: every metric from one aggregation."""
    rates = group_rates(df, attrs, target, prediction, positive, multivalued)
    whole = every_group()
    made = rates.select(*attrs, *[F.struct(F.lit(m).alias("metric"), spread_of(m, mode, ndigits, whole).alias("value"), F.col(m).alias("prob")).alias(f"__{m}") for m in metrics])
    long = made.select(*attrs, F.explode(F.array(*[F.col(f"__{m}") for m in metrics])).alias("x"))
    return long.where(F.col("x.prob").isNotNull()).select("x.metric", "x.value", *attrs, "x.prob")


def report_table(report_: DataFrame, attr: str, groups: Sequence[str]) -> DataFrame:
    """One row per metric: value and a column per group."""
    return report_.groupBy("metric", "value").pivot(attr, list(groups)).agg(F.first("prob"))


def accuracy(df: DataFrame, target: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(target) == F.col(prediction)).cast("double")).alias("accuracy"))


def delta_percent(estimate: Column, true: Column, scale: float) -> Column:
    """|estimate - true| in percent, cut down to a multiple of scale; null outside [0, 1]."""
    if not 0 < scale <= 1:
        raise ValueError("scale must lie in (0, 1]")
    return F.when(estimate.between(0, 1) & true.between(0, 1), F.floor(F.abs(estimate - true) / scale) * scale * 100)


def compare(df: DataFrame, true_attr: str, estimated_attr: str, target: str, positive, metrics: Sequence[str] = ("statistical_parity", "representation_disparity"), ndigits: int | None = 3) -> DataFrame:
    """metric, mode, true and estimated value: the same metrics on two multi-valued attributes, from one aggregation of both."""
    sides = F.array(F.struct(F.lit("true").alias("side"), F.col(true_attr).alias("g")), F.struct(F.lit("estimated").alias("side"), F.col(estimated_attr).alias("g")))
    both = df.select(F.col(target).alias("__target"), F.explode(sides).alias("x")).select("__target", "x.side", F.col("x.g").alias("__g"))
    rates = rates_of(group_counts(exploded(both, ["__g"]), ["side", "__g"], "__target", None, positive), ["side", "__g"], within=["side"])
    pairs = [(m, mode) for mode in ("difference", "ratio") for m in metrics]
    found = rates.groupBy("side").agg(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(mode).alias("mode"), spread_of(m, mode, ndigits).alias("v")) for m, mode in pairs]).alias("x"))
    long = found.select("side", F.explode("x").alias("x")).select("side", "x.*")
    sided = {name: F.max(F.when(F.col("side") == name, F.col("v"))).alias(f"{name}_value") for name in ("true", "estimated")}
    return long.groupBy("metric", "mode").agg(*sided.values())


def fairness_function(attrs: Sequence[str], target: str, positive, metrics: Sequence[str] | str, score: Callable[[Column, Column], Column] | None = None, aggregate: Callable[..., Column] | None = None, mode="difference", multivalued: bool = False, sensor: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """An evaluator of predictions: one row with the metrics, an optional score and their optional aggregate."""
    names = [metrics] if isinstance(metrics, str) else list(metrics or [])

    def evaluate(df: DataFrame, prediction: str) -> DataFrame:
        missing = [c for c in (*attrs, target, prediction) if c not in df.columns and not (sensor and c in attrs)]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        seen = sensor(df) if sensor else df
        out = spreads(group_rates(seen, attrs, target, prediction, positive, multivalued), names, mode) if names else seen.limit(0).agg(F.lit(None).cast("double").alias("__none")).drop("__none")
        if score is not None:
            one = seen.agg(score(F.col(target), F.col(prediction)).alias("score"))
            out = out.crossJoin(F.broadcast(one)) if names else one  # one row each
        return out.withColumn("aggregate", aggregate(*[F.col(c) for c in out.columns])) if aggregate else out

    return evaluate


def coerced(df: DataFrame, predictions: DataFrame, row_id: str = "row_id", prediction: str = "prediction") -> DataFrame:
    """df with the prediction of each row, met by row id; rows without one have null."""
    return df.join(predictions.select(row_id, prediction), row_id, "left")


def by_target_value(df: DataFrame, joined: str, target: str, metrics: Sequence[str] = ("statistical_parity", "representation_disparity"), values: Sequence | None = None, ndigits: int | None = 3) -> DataFrame:
    """target value, metric, value: fairness of a table whose groups are joined by ' & ', with each value of the target in turn as the positive one.

    Without values, all that occur are taken; more than MOST_TARGETS raise ValueError, since each makes eight sums.
    """
    from paritas.functions.text import split_groups

    each = values if values is not None else [r[0] for r in df.select(target).distinct().where(F.col(target).isNotNull()).orderBy(target).limit(MOST_TARGETS + 1).collect()]
    if len(each) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target values")
    groups = df.select(target, F.when(F.col(joined).isNotNull(), split_groups(F.col(joined))).alias("__g"))
    pieces = exploded(groups, ["__g"])
    counts = pieces.groupBy("__g").agg(F.array(*[F.struct(F.lit(v).cast("string").alias("positive"), *count_columns(pieces, target, F.col(target), v)) for v in each]).alias("__c"))
    rates = rates_of(counts.select("__g", F.explode("__c").alias("__c")).select("__g", "__c.*"), ["__g"], within=["positive"])
    long = rates.groupBy("positive").agg(F.array(*[F.struct(F.lit(m).alias("metric"), spread_of(m, "difference", ndigits).alias("value")) for m in metrics]).alias("x"))
    return long.select("positive", F.explode("x").alias("x")).select("positive", "x.*")


def named_metrics(df: DataFrame, attr: str, target: str, positive, prediction: str | None = None, names: dict[str, tuple[str, str]] | None = None, ndigits: int | None = 3) -> DataFrame:
    """One row, a column per name: (metric, mode) of each on one multi-valued attribute; predictions default to the target."""
    asked = names or {f"{m}_{mode}": (m, mode) for m in ("statistical_parity", "representation_disparity") for mode in ("difference", "ratio")}
    rates = group_rates(df, [attr], target, prediction, positive, True)
    return rates.agg(*[spread_of(m, mode, ndigits).alias(name) for name, (m, mode) in asked.items()])
