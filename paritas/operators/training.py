"""Base learners fitted on folds, and mitigation that trains them.

A learner is a naive Bayes over some of the features.  All learners of all folds come from one aggregation: counts of
(fold, feature, value, label); what a fold's model has seen is the total minus the fold's own part.  A row meets the
logarithms of each feature's value by an equi-join with a table of (fold, value), which Catalyst broadcasts where it is
small; then every learner is a sum of array elements in the same row, so that out-of-fold predictions of any number of
learners need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.operators import diversity, evolve, search

#: Labels and folds that a model tells apart, and the value that stands for null.
MOST_LABELS, MOST_FOLDS, NOTHING = 64, 1000, "\0"


def fold_of(key: Column, folds: int, seed: int = 0) -> Column:
    """A fold from 0 for each key, by a seeded hash."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def _value(feature: str) -> Column:
    return F.coalesce(F.col(feature).cast("string"), F.lit(NOTHING))


@dataclass
class Bayes:
    """Fitted counts: for each fold and value of a feature, the logarithms of its share under each label, and the priors.

    Fold null stands for the model of all rows.
    """

    features: tuple[str, ...]
    labels: list
    values: DataFrame
    priors: DataFrame


def fit_bayes(df: DataFrame, features: Sequence[str], gold: str = "gold", fold: str | None = None, added: float = 1.0) -> Bayes:
    """Counts of every feature's values under every label, without each fold's own rows; one pass over df.

    Rows without a label aren't learned from.  More than MOST_LABELS labels raise ValueError.
    """
    known = df.where(F.col(gold).isNotNull())
    labels = [r[0] for r in known.select(gold).distinct().orderBy(gold).limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    part = (F.col(fold) if fold else F.lit(None)).cast("int").alias("fold")
    each = F.explode(F.array(F.struct(F.lit("").alias("feature"), F.lit("").alias("value")), *[F.struct(F.lit(f).alias("feature"), _value(f).alias("value")) for f in features]))
    pieces = known.select(part, F.col(gold).alias("__gold"), each.alias("x")).select("fold", "__gold", "x.*")
    counts = pieces.groupBy("feature", "value", "fold").agg(*[F.count_if(F.col("__gold") == F.lit(g)).alias(f"n{i}") for i, g in enumerate(labels)])
    if fold:  # each value meets every fold: a fold's unlabelled rows may hold one that only others have
        folds = [r[0] for r in known.select(part).distinct().limit(MOST_FOLDS + 1).collect()]
        if len(folds) > MOST_FOLDS:
            raise ValueError(f"more than {MOST_FOLDS} folds")
        sums = counts.groupBy("feature", "value").agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(labels))])
        every = sums.withColumn("fold", F.explode(F.array(*map(F.lit, folds))))
        counts = every.join(counts, ["feature", "value", "fold"], "left").select("feature", "value", "fold", *[(F.col(f"t{i}") - F.coalesce(f"n{i}", F.lit(0))).alias(f"n{i}") for i in range(len(labels))])
    kinds = pieces.groupBy("feature").agg(F.count_distinct("value").alias("kinds"))
    totals = counts.where("feature = ''").select("fold", *[F.col(f"n{i}").alias(f"t{i}") for i in range(len(labels))])
    met = counts.where("feature != ''").join(kinds, "feature").join(totals, counts["fold"].eqNullSafe(totals["fold"])).drop(totals["fold"])
    shares = [F.log((F.col(f"n{i}") + added) / (F.col(f"t{i}") + added * F.col("kinds"))) for i in range(len(labels))]
    rows = sum((F.col(f"t{i}") for i in range(len(labels))), F.lit(0))
    priors = totals.select("fold", F.array(*[F.log((F.col(f"t{i}") + added) / (rows + added * len(labels))) for i in range(len(labels))]).alias("prior"))
    return Bayes(tuple(features), labels, met.select("feature", "value", "fold", F.array(*shares).alias("shares")), priors)


def predict_bayes(model: Bayes, df: DataFrame, learners: Sequence[Sequence[str]], fold: str | None = None, name: str = "preds") -> DataFrame:
    """df with an array of the labels that each learner (its features) predicts; ties go to the first label.

    Values that a model hasn't seen count for no label.
    """
    unknown = sorted({f for own in learners for f in own} - set(model.features))
    if unknown:
        raise ValueError(f"the model has no features {unknown}")
    own = (F.col(f"`{fold}`") if fold else F.lit(None)).cast("int")
    out = df.withColumn("__fold", own)
    for i, f in enumerate(model.features):
        table = model.values.where(F.col("feature") == f).select(F.col("value").alias("__v"), F.col("fold").alias("__f"), F.col("shares").alias(f"__s{i}"))
        out = out.join(table, (_value(f) == table["__v"]) & out["__fold"].eqNullSafe(table["__f"]), "left").drop("__v", "__f")
    priors = model.priors.select(F.col("fold").alias("__f"), "prior")
    out = out.join(priors, out["__fold"].eqNullSafe(priors["__f"]), "left").drop("__f")
    at = {f: i for i, f in enumerate(model.features)}

    def label(features: Sequence[str]) -> Column:
        sums = [F.round(F.get("prior", F.lit(k)) + sum((F.coalesce(F.get(f"__s{at[f]}", F.lit(k)), F.lit(0.0)) for f in features), F.lit(0.0)), 9) for k in range(len(model.labels))]
        scores = F.array(*sums)
        return F.get(F.array(*map(F.lit, model.labels)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))

    made = F.array(*[label(own) for own in learners])
    return out.withColumn(name, made).drop("__fold", "prior", *[f"__s{i}" for i in range(len(model.features))])


def out_of_fold(df: DataFrame, learners: Sequence[Sequence[str]], gold: str = "gold", fold: str = "fold", name: str = "preds") -> DataFrame:
    """df with the predictions of each learner, each row by the models that haven't seen its fold."""
    features = list(dict.fromkeys(f for own in learners for f in own))
    return predict_bayes(fit_bayes(df, features, gold, fold), df, learners, fold, name)


def diversified(df: DataFrame, n: int, top: int, preds: str = "preds", gold: str = "gold") -> tuple[list[int], list[float]]:
    """The `top` most accurate and diverse of n learners, and the accuracy of every one; two aggregations."""
    single = [r["accuracy"] for r in search.score_votes(df, [(i,) for i in range(n)], {"accuracy": search.accuracy_metric}, preds, gold).orderBy("candidate").collect()]
    if n <= 2 or top >= n:
        return sorted(range(n), key=lambda i: (-single[i], i))[:top], single
    pairs = {(r["i"], r["j"]): r["double_fault_inverse"] for r in diversity.pairwise(df, n, preds, gold).collect()}
    ranks = diversity.greedy_rank(single, pairs, min(top, n - 1))
    return sorted(sorted(range(n), key=lambda i: (-ranks[i], i))[:top]), single


def mitigate_trained(df: DataFrame, learners: Sequence[Sequence[str]], attrs: Sequence[str], positive, gold: str = "gold", fold: str = "fold", row_id: str = "row_id", metric: str = "statistical_parity", top: int = 5, detriment: float | None = None, **options) -> tuple[evolve.Outcome, DataFrame]:
    """Train, diversify, combine: an outcome of the search over ensembles of the `top` learners, and df with its best one's prediction.

    Learners predict out of fold; the search scores accuracy and the metric's spread on cells of these predictions.  The best
    one is the fairest of the front; ties go to higher accuracy, then to fewer and earlier classifiers.  Its members number
    the learners.  Without any that the detriment allows, df gets the most accurate learner.
    """
    told = out_of_fold(df, learners, gold, fold)
    chosen, single = diversified(told, len(learners), top, "preds", gold)
    some = told.withColumn("preds", F.array(*[F.get("preds", F.lit(i)) for i in chosen]))
    table = evolve.cells(some, attrs, "preds", gold, row_id)
    outcome = evolve.search_ensembles(table, len(chosen), [single[i] for i in chosen], attrs, positive, (metric,), detriment=detriment, **options)
    outcome.found = [(kind, tuple(chosen[i] for i in m)) for kind, m in outcome.found]
    best = min(outcome.front, key=lambda i: (outcome.scores[i][1], -outcome.scores[i][0], len(outcome.found[i][1]), outcome.found[i]), default=None)
    if best is None:
        only = max(range(len(learners)), key=lambda i: (single[i], -i))
        return outcome, told.withColumn("prediction", F.get("preds", F.lit(only)))
    kind, members = outcome.found[best]
    fitted = search.fit_ensemble(told, "voting" if kind == "learning" else kind, members, single, "preds", gold, row_id) if kind != "learning" else None
    if fitted is not None:
        return outcome, fitted(told, "prediction")
    model = evolve._learned(evolve.cells(told, attrs, "preds", gold, row_id))
    voted = told.crossJoin(F.broadcast(model))  # one row
    return outcome, voted.withColumn("prediction", evolve._scored_by_model(F.col("model"), F.array(*map(F.lit, members)), F.col("preds"))).drop("model")
