"""Sensors run end to end: annotate a table, dump the annotations, score them and compare the fairness they show.

A sensor is a function of the table that gives (key, values); each is joined to the table by its key, so sensors that read
the table as a whole (embeddings, entities, names in text) and those that look at a row alone run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.operators import embedding, fairness, labels, sensors
from paritas.sources import sinks

Sensor = Callable[[DataFrame], DataFrame]
HANDLER = "Handler"


def of_column(make: Callable[[DataFrame], Column], key: str = "doc_id") -> Sensor:
    """A sensor from a column expression over the table's rows."""
    return lambda df: df.select(key, make(df).alias("values"))


def embedding_of(vectors: DataFrame, attributes: Mapping[str, Sequence[float]], configuration: embedding.Configuration = embedding.HIERARCHY, key: str = "doc_id", text: str = "text") -> Sensor:
    """An embedding sensor; by default words of sentences, as the run over the reviews has it."""
    return lambda df: embedding.annotate(df.select(key, text), vectors, attributes, configuration, key, text)


def annotated(df: DataFrame, handlers: Mapping[str, Sensor], merge: Callable[[Sequence[Column]], Column] = sensors.union_merge, key: str = "doc_id") -> DataFrame:
    """df with a column for each sensor and HANDLER, what they say together; key is unique.  No sensor raises ValueError."""
    if not handlers:
        raise ValueError("no sensor")
    clash = [n for n in (*handlers, HANDLER) if n in df.columns]
    if clash:
        raise ValueError(f"columns are there already: {clash}")
    none, out = F.array().cast("array<string>"), df
    for i, (name, sensor) in enumerate(handlers.items()):
        said = sensor(df).select(F.col(key).alias("__key"), F.col("values").alias(f"__s{i}"))
        out = out.join(said, out[key] == said["__key"], "left").drop("__key").withColumn(name, F.array_sort(F.array_distinct(F.coalesce(f"__s{i}", none)))).drop(f"__s{i}")
    return out.withColumn(HANDLER, F.array_sort(F.array_distinct(merge([F.col(f"`{n}`") for n in handlers]))))


def dump(df: DataFrame, path: str) -> None:
    """The table with its annotations as CSV; the values of every list are joined."""
    sinks.write_annotations(df, path, [c for c, kind in df.dtypes if kind == "array<string>"])


def scored(df: DataFrame, gold: str, values: Sequence[str], predictions: Sequence[str] = (HANDLER,)) -> DataFrame:
    """predicted, label, precision, recall, f1 of each column of predictions, from one pass over df."""
    known = F.col(gold).isNotNull()
    stats = []
    for p in predictions:
        for v in values:
            g, said = known & F.array_contains(gold, v), F.coalesce(F.array_contains(f"`{p}`", v), F.lit(False))
            stats.append(F.struct(F.lit(p).alias("predicted"), F.lit(v).alias("label"), F.count_if(g & said).alias("hits"), F.count_if(known & ~g & said).alias("spurious"), F.count_if(g & ~said).alias("missing")))
    e = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rates = e.select("predicted", "label", ratio(F.col("hits"), F.col("hits") + F.col("spurious")).alias("precision"), ratio(F.col("hits"), F.col("hits") + F.col("missing")).alias("recall"))
    return rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(df: DataFrame, gold: str, values: Sequence[str], predicted: str = HANDLER, neutral: str | None = None) -> DataFrame:
    """One row of macro scores and accuracies; with a neutral value, a row for each class instead."""
    if neutral is None:
        return labels.multilabel_summary(df, values, gold, f"`{predicted}`")
    return labels.multiclass_scores(df.withColumn("__said", F.col(f"`{predicted}`")), gold, "__said", neutral)


def compared(df: DataFrame, gold: str, target: str, positive, predicted: str = HANDLER, **options) -> DataFrame:
    """metric, mode, true and estimated value: fairness between the groups of the gold annotations, and of the sensors'."""
    return fairness.compare(df.withColumn("__said", F.col(f"`{predicted}`")), gold, "__said", target, positive, **options)


def evaluated(df: DataFrame, handlers: Mapping[str, Sensor], gold: str, values: Sequence[str], target: str | None = None, positive=None, key: str = "doc_id", path: str | None = None, merge=sensors.union_merge) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The whole run: annotated table, scores of every sensor and of all together, fairness compared (None without a target).  With a path, the annotations are dumped there."""
    told = annotated(df, handlers, merge, key)
    if path:
        dump(told, path)
    return told, scored(told, gold, values, [HANDLER, *handlers]), compared(told, gold, target, positive) if target else None


def review_run(reviews: DataFrame, vectors: DataFrame, attributes: Mapping[str, Sequence[float]], key: str = "review_id", path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The preset for reviews: words of sentences against the attributes' vectors, scored against Gender; reviews as the reader gives them, with a key."""
    handlers = {"EmbeddingBasedSensor": embedding_of(vectors, attributes, embedding.HIERARCHY, key, "Review")}
    return evaluated(reviews, handlers, "Gender", sorted(attributes), "Sentiment" if "Sentiment" in reviews.columns else None, "positive", key, path)
