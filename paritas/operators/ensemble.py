"""Voting, oracles and model adapters over a column of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(columns: Sequence[str]) -> Column:
    """The predictions of several classifiers as one array."""
    return F.array(*columns)


def select_predictions(preds: Column, selection: Sequence[int]) -> Column:
    return F.array(*[F.get(preds, F.lit(i)) for i in selection])


def _votes(preds: Column, label: Column) -> Column:
    return F.size(F.filter(preds, lambda p: p == label))


def majority_vote(preds: Column, preferred=None) -> Column:
    """The most frequent label; ties go to the first met, or to preferred if it is among the best."""
    distinct = F.array_distinct(preds)
    ranked = F.transform(distinct, lambda v: F.struct(_votes(preds, v).alias("n"), (-F.array_position(preds, v)).alias("first"), v.alias("label")))
    best = F.array_max(ranked)
    if preferred is None:
        return best["label"]
    return F.when(_votes(preds, F.lit(preferred)) >= best["n"], F.lit(preferred)).otherwise(best["label"])


def scored_vote(preds: Column, scores: Sequence[float] | Column, maximize: bool = True) -> Column:
    """Majority vote; ties go to the label with the best score of a classifier that chose it, then to the first met."""
    sign = 1.0 if maximize else -1.0
    known = F.transform(scores, lambda s: s * sign) if isinstance(scores, Column) else F.array(*[F.lit(sign * s) for s in scores])

    def key(v: Column) -> Column:
        own = F.zip_with(preds, known, lambda p, s: F.when(p == v, s))
        return F.struct(_votes(preds, v).alias("n"), F.array_max(own).alias("score"), (-F.array_position(preds, v)).alias("first"), v.alias("label"))

    return F.array_max(F.transform(F.array_distinct(preds), key))["label"]


def overfit_oracle(df: DataFrame, scores: Sequence[float], fit_on: DataFrame | None = None, preds: str = "preds", gold: str = "gold", order: str = "row_id", maximize: bool = True) -> DataFrame:
    """df with oracle: the most common gold label of the row's tuple of predictions (first met on ties).

    Tuples not met while fitting get the prediction of the best-scored classifier.
    """
    pick = (max if maximize else min)(range(len(scores)), key=lambda i: scores[i])
    counted = (fit_on or df).groupBy(preds, gold).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    table = counted.groupBy(preds).agg(F.max_by(gold, F.struct("n", (-F.col("first")).alias("first"))).alias("__oracle"))
    return df.join(table, preds, "left").withColumn("oracle", F.coalesce("__oracle", F.get(preds, F.lit(pick)))).drop("__oracle")


def optimistic_oracle(preds: Column, gold: Column) -> Column:
    """gold if any classifier says so, else the first classifier's prediction."""
    return F.when(F.array_contains(preds, gold), gold).otherwise(F.get(preds, F.lit(0)))


def optimistic_coverage(df: DataFrame, preds: str = "preds", gold: str = "gold") -> DataFrame:
    return df.agg(F.avg(F.array_contains(F.col(preds), F.col(gold)).cast("double")).alias("coverage"))


def detriment_limit(best: float, detriment: float) -> float:
    """The lowest score an ensemble may have: a whole number is percent of the best, a fraction is absolute."""
    return best - (best * detriment / 100 if isinstance(detriment, int) and not isinstance(detriment, bool) else detriment)


def encode_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """<column>_code: place of the value among the sorted distinct values, through pyspark.ml; unseen values raise."""
    from pyspark.ml.feature import StringIndexer

    names = [f"{c}_code" for c in columns]
    out = StringIndexer(inputCols=list(columns), outputCols=names, stringOrderType="alphabetAsc", handleInvalid="error").fit(df).transform(df)
    return out.withColumns({n: F.col(n).cast("long") for n in names})


def fourier_frequencies(n_features: int, n: int, gamma: float, seed: int = 0) -> tuple[list[list[float]], list[float]]:
    """Seeded frequencies and phases of n random Fourier features of the Gaussian kernel exp(-gamma * |x - y|**2)."""
    import numpy as np

    if n < 1 or gamma <= 0:
        raise ValueError("n and gamma must be positive")
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, n_features)) * (2 * gamma) ** 0.5).tolist(), r.uniform(0, 2 * np.pi, n).tolist()


def fourier_features(features: Sequence[str], n: int = 256, gamma: float = 1.0, seed: int = 0) -> Column:
    """An array of n numbers whose inner products are the Gaussian kernel of the features, within about 1 / sqrt(n).

    Features should be of like scale; a null counts as 0.
    """
    import numpy as np

    frequencies, phases = fourier_frequencies(len(features), n, gamma, seed)
    flat, shift = F.lit(np.array(frequencies).ravel()), F.lit(np.array(phases))
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]

    def one(k: Column) -> Column:
        along = sum((F.get(flat, k * len(x) + j) * v for j, v in enumerate(x)), F.get(shift, k))
        return F.cos(along) * (2 / n) ** 0.5

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


class KernelSVC:
    """Support vectors with a Gaussian kernel: a linear machine over random Fourier features.

    Labels are any two values; with more, one machine for each against the rest, the greatest margin wins.
    """

    def __init__(self, features: Sequence[str], n: int = 256, gamma: float = 1.0, seed: int = 0, **options):
        self.features, self.mapped, self.options = list(features), fourier_features(features, n, gamma, seed), options
        self.labels: list = []
        self.models: list = []

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("__features", array_to_vector(self.mapped))

    def fit(self, df: DataFrame, gold: str) -> KernelSVC:
        """Learns from the rows with a label."""
        known = df.where(F.col(gold).isNotNull())
        self.labels = [r[0] for r in known.select(gold).distinct().orderBy(gold).limit(101).collect()]
        if not 2 <= len(self.labels) <= 100:
            raise ValueError(f"{len(self.labels)} labels: there must be 2 to 100")
        rows = self._vectors(known).persist()
        try:
            for label in self.labels[1:] if len(self.labels) == 2 else self.labels:
                one = rows.withColumn("__gold", (F.col(gold) == F.lit(label)).cast("double"))
                self.models.append(base_model("svc", featuresCol="__features", labelCol="__gold", **self.options).fit(one))
        finally:
            rows.unpersist()
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the predicted label."""
        along = lambda m: F.aggregate(F.zip_with("__x", F.lit(m.coefficients.toArray()), lambda x, w: x * w), F.lit(float(m.intercept)), lambda total, x: total + x)
        margins = [along(m) for m in self.models]
        out = df.withColumn("__x", self.mapped)
        if len(self.labels) == 2:
            said = F.when(margins[0] > 0, F.lit(self.labels[1])).otherwise(F.lit(self.labels[0]))
        else:
            scores = F.array(*margins)
            said = F.get(F.array(*map(F.lit, self.labels)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
        return out.withColumn(name, said).drop("__x")


def base_model(kind: str, **options):
    """Decision tree, logistic regression or linear support vectors as a pyspark.ml estimator."""
    from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression

    made = {"tree": DecisionTreeClassifier, "logistic": LogisticRegression, "svc": LinearSVC}
    return made[kind](**options)


def one_group_wins(attr: Column, group, positive, negative) -> Column:
    """The rule that predicts positive for one group only."""
    return F.when(attr == F.lit(group), F.lit(positive)).otherwise(F.lit(negative))


def _prediction_vectors(df: DataFrame, n: int, preds: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__features", array_to_vector(F.array(*[F.get(preds, F.lit(i)).cast("double") for i in range(n)])))


def stacking_model(df: DataFrame, n: int, preds: str = "preds", gold: str = "gold", kind: str = "tree"):
    """A pyspark.ml model that learns gold from the vector of predictions."""
    return base_model(kind, featuresCol="__features", labelCol="__gold").fit(_prediction_vectors(df, n, preds).withColumn("__gold", F.col(gold).cast("double")))


def apply_stacking(model, df: DataFrame, n: int, preds: str = "preds", name: str = "stacked") -> DataFrame:
    return model.transform(_prediction_vectors(df, n, preds)).select(*df.columns, F.col("prediction").alias(name))


def stacking(df: DataFrame, n: int, preds: str = "preds", gold: str = "gold", kind: str = "tree"):
    """A pyspark.ml model that learns gold from the vector of predictions, and df with its prediction."""
    model = stacking_model(df, n, preds, gold, kind)
    return model, apply_stacking(model, df, n, preds)


def bagging(df: DataFrame, features: Sequence[str], gold: str, n_estimators: int = 1, max_samples: float = 0.5, seed: int = 0, kind: str = "tree") -> DataFrame:
    """df with bagged: the majority vote of models that each saw a seeded share of the rows."""
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(features), outputCol="__features").transform(df).withColumn("__gold", F.col(gold).cast("double"))
    out = vectors
    for i in range(n_estimators):
        model = base_model(kind, featuresCol="__features", labelCol="__gold", predictionCol=f"__m{i}").fit(vectors.sample(max_samples, seed + i))
        out = model.transform(out).drop("rawPrediction", "probability")
    return out.withColumn("bagged", majority_vote(F.array(*[f"__m{i}" for i in range(n_estimators)]))).select(*df.columns, "bagged")
