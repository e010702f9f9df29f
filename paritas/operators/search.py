"""Enumeration of configurations and ensembles, on the driver; candidates are scored in one Spark job.

It takes the place of an evolutionary search: grids or seeded samples, a log that
can be replayed, and Pareto selection.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.operators import diversity, ensemble, fairness


def grid(space: Mapping[str, Sequence]) -> Iterator[dict]:
    """Every combination, names in the space's order."""
    for values in itertools.product(*space.values()):
        yield dict(zip(space, values))


def expand(arguments: Mapping[str, str], separator: str = "|") -> Iterator[dict]:
    """Every combination of arguments that list their choices with a separator."""
    return grid({k: v.split(separator) for k, v in arguments.items()})


def sampled(space: Mapping[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """n seeded draws from the grid, without repeats, in the order drawn."""
    every = list(grid(space))
    random.Random(seed).shuffle(every)
    return every[:n]


class Choices:
    """Makes choices and logs them by name; a log that is given is replayed first."""

    def __init__(self, log: Sequence[tuple[str, object]] = (), seed: int = 0, by_name: bool = False):
        self.given, self.by_name = list(log), by_name
        self.random, self.log = random.Random(seed), []

    def choose(self, name: str, options: Sequence):
        at = next((i for i, (n, _) in enumerate(self.given) if n == name), None) if self.by_name else (0 if self.given else None)
        if at is None:
            value = self.random.choice(list(options))
        else:
            logged, value = self.given.pop(at)
            if logged != name or value not in options:
                raise ValueError(f"the log has {logged!r} = {value!r}, asked was {name!r}")
        self.log.append((name, value))
        return value


def ensembles(n: int, smallest: int = 2, kinds: Sequence[str] = ("voting", "overfit")) -> Iterator[tuple[str, tuple[int, ...]]]:
    """(kind, classifiers) of every subset of at least so many classifiers."""
    for size in range(min(smallest, n), n + 1):
        for chosen in itertools.combinations(range(n), size):
            for kind in kinds:
                yield kind, chosen


def score_votes(df: DataFrame, subsets: Sequence[Sequence[int]], metrics: Mapping[str, Callable[[Column, Column], Column]], preds: str = "preds", gold: str = "gold") -> DataFrame:
    """candidate (its place in subsets) and metrics of the majority vote of each subset: one aggregation for all."""
    voted = df.select("*", *[ensemble.majority_vote(ensemble.select_predictions(F.col(preds), s)).alias(f"__v{i}") for i, s in enumerate(subsets)])
    rows = [F.struct(F.lit(i).alias("candidate"), *[m(F.col(gold), F.col(f"__v{i}")).alias(name) for name, m in metrics.items()]) for i in range(len(subsets))]
    return voted.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def accuracy_metric(gold: Column, vote: Column) -> Column:
    return F.avg((gold == vote).cast("double"))


def within_detriment(scores: DataFrame, best: float, detriment: float, score: str = "accuracy") -> DataFrame:
    """Candidates whose score isn't below the limit that the best single model sets."""
    return scores.where(F.col(score) >= ensemble.detriment_limit(best, detriment))


def first_that_works(candidates: Sequence, attempt: Callable) -> tuple[object, object] | None:
    """The first candidate whose attempt raises nothing, and its result."""
    for candidate in candidates:
        try:
            return candidate, attempt(candidate)
        except (ValueError, RuntimeError):
            continue
    return None


def candidate_rates(df: DataFrame, predictions: Sequence[Column], attrs: Sequence[str], target: str, positive, by: Sequence[str] = ()) -> DataFrame:
    """by, candidate (from 0), attrs and fairness.METRICS of several predictions: one aggregation for all of them."""
    keys = [*by, *[a for a in attrs if a not in by]]
    each = [F.struct(F.lit(i).alias("candidate"), *fairness.count_columns(df, target, p, positive)) for i, p in enumerate(predictions)]
    counts = df.groupBy(*keys).agg(F.array(*each).alias("__c")).select(*keys, F.explode("__c").alias("__c")).select(*keys, "__c.*")
    return fairness.rates_of(counts, attrs, within=[*by, "candidate"])


def model_report(df: DataFrame, models: Mapping[str, str], attrs: Sequence[str], target: str, positive, metrics: Sequence[str] = fairness.METRICS, split: str | None = None) -> DataFrame:
    """A row per model (name -> prediction column) and split: accuracy and the spread of each metric, from one scan for each.

    A model whose column isn't there, or can't be compared with the target, gives a row with the error's text instead.
    """
    spark, by = df.sparkSession, [split] if split else []
    errors = {}
    for name, column in models.items():
        try:
            df.select(F.col(f"`{column}`") == F.col(target)).schema  # noqa: B018 - analysis alone
        except AnalysisException as e:
            errors[name] = str(e).splitlines()[0]
    sound = {n: c for n, c in models.items() if n not in errors}
    names = F.array(*[F.lit(n) for n in sound]) if sound else F.array().cast("array<string>")
    parts = df.select(F.col(split).cast("string").alias("split")).distinct() if split else spark.createDataFrame([(None,)], "split string")
    out = None
    if sound:
        columns = [F.col(f"`{c}`") for c in sound.values()]
        rates = candidate_rates(df, columns, attrs, target, positive, by)
        values = fairness.spreads(rates, metrics, by=[*by, "candidate"])
        right = F.array(*[F.struct(F.lit(i).alias("candidate"), F.avg((F.col(target) == c).cast("double")).alias("accuracy")) for i, c in enumerate(columns)])
        accuracy = df.groupBy(*by).agg(right.alias("__a")).select(*by, F.explode("__a").alias("__a")).select(*by, "__a.*")
        met = accuracy.join(values, [*by, "candidate"], "left")
        out = met.select(*metrics, "accuracy", F.lit(None).cast("string").alias("error"), F.get(names, F.col("candidate")).alias("model"), (F.col(split).cast("string") if split else F.lit(None).cast("string")).alias("split"))
    if errors:
        failed = spark.createDataFrame(list(errors.items()), "model string, error string").crossJoin(F.broadcast(parts))  # a row per split
        out = failed if out is None else out.unionByName(failed, allowMissingColumns=True)
    return out


def mitigate(df: DataFrame, n: int, attrs: Sequence[str], positive, metric: str = "statistical_parity", detriment: float = 0.05, top: int = 5, preds: str = "preds", gold: str = "gold") -> dict:
    """The fairest voting ensemble whose accuracy stays within the detriment of the best single model.

    Base models are ranked by greedy diversity, the `top` of them are combined in
    every subset, all subsets are scored for accuracy in one aggregation, and those
    within the detriment for the metric in another.  Ties go to higher accuracy, then to fewer and
    earlier classifiers.  Returns classifiers, accuracy, metric's spread, best single accuracy.
    """
    single = [r["accuracy"] for r in score_votes(df, [(i,) for i in range(n)], {"accuracy": accuracy_metric}, preds, gold).orderBy("candidate").collect()]
    pairs = {(r["i"], r["j"]): r["double_fault_inverse"] for r in diversity.pairwise(df, n, preds, gold).collect()}
    ranks = diversity.greedy_rank(single, pairs, min(top, n - 1)) if n > 2 else single
    chosen = sorted(sorted(range(n), key=lambda i: (-ranks[i], i))[:top])
    subsets = [(i,) for i in chosen] + [tuple(chosen[i] for i in s) for _, s in ensembles(len(chosen), kinds=("voting",)) if len(s) > 1]
    accuracies = [r["accuracy"] for r in score_votes(df, subsets, {"accuracy": accuracy_metric}, preds, gold).orderBy("candidate").collect()]
    limit = ensemble.detriment_limit(max(single), detriment)
    allowed = [i for i, a in enumerate(accuracies) if a >= limit]
    votes = [ensemble.majority_vote(ensemble.select_predictions(F.col(preds), subsets[i])) for i in allowed]
    voted = df.select(*attrs, F.col(gold), *[v.alias(f"__v{i}") for i, v in enumerate(votes)])
    rates = candidate_rates(voted, [F.col(f"__v{i}") for i in range(len(votes))], attrs, gold, positive)
    gaps = {allowed[r["candidate"]]: r[metric] for r in fairness.spreads(rates, [metric], by=["candidate"]).collect()}
    best = min(allowed, key=lambda i: (gaps[i] if gaps.get(i) is not None else float("inf"), -accuracies[i], len(subsets[i]), subsets[i]))
    return {"classifiers": subsets[best], "accuracy": accuracies[best], metric: gaps.get(best), "best_single": max(single)}


def ensemble_scores(df: DataFrame, n: int, attrs: Sequence[str], positive, metric: str = "statistical_parity", smallest: int = 2, preds: str = "preds", gold: str = "gold") -> DataFrame:
    """candidate, accuracy and the metric's spread of the majority vote of every subset: one aggregation by group for all of them.

    candidate numbers :func:`ensembles` of kind voting.  Rows without a group count for the accuracy too.
    """
    subsets = [c for _, c in ensembles(n, smallest, ("voting",))]
    voted = df.select(*attrs, F.col(gold), *[ensemble.majority_vote(ensemble.select_predictions(F.col(preds), s)).alias(f"__v{i}") for i, s in enumerate(subsets)])
    each = [F.struct(F.lit(i).alias("candidate"), *fairness.count_columns(voted, gold, F.col(f"__v{i}"), positive)) for i in range(len(subsets))]
    counts = voted.groupBy(*attrs).agg(F.array(*each).alias("__c")).select(*attrs, F.explode("__c").alias("__c")).select(*attrs, "__c.*")
    known = counts.groupBy("candidate").agg((F.sum("correct") / F.sum("n")).alias("accuracy"))
    return known.join(fairness.spreads(fairness.rates_of(counts, attrs, within=["candidate"]), [metric], by=["candidate"]), "candidate")


def fit_ensemble(train: DataFrame, kind: str, classifiers: Sequence[int], scores: Sequence[float], preds: str = "preds", gold: str = "gold", order: str = "row_id") -> Callable[[DataFrame, str], DataFrame]:
    """A function (rows, name) -> rows with the ensemble's prediction: voting, learning (a tree over the predictions) or overfit (the most common gold of each tuple)."""
    own = [scores[i] for i in classifiers]

    def narrowed(df: DataFrame) -> DataFrame:
        return df.withColumn("__some", ensemble.select_predictions(F.col(preds), classifiers))

    if kind == "voting":
        return lambda df, name: df.withColumn(name, ensemble.scored_vote(ensemble.select_predictions(F.col(preds), classifiers), own))
    if kind == "overfit":
        seen = narrowed(train)
        return lambda df, name: ensemble.overfit_oracle(narrowed(df), own, seen, "__some", gold, order).withColumnRenamed("oracle", name).drop("__some")
    if kind == "learning":
        model = ensemble.stacking_model(narrowed(train), len(classifiers), "__some", gold)
        return lambda df, name: ensemble.apply_stacking(model, narrowed(df), len(classifiers), "__some", name).drop("__some")
    raise ValueError(f"unknown kind {kind!r}")


def mitigation_front(df: DataFrame, n: int, attrs: Sequence[str], positive, metric: str = "statistical_parity", **options) -> DataFrame:
    """The ensembles that no other one beats in accuracy and in the metric's spread."""
    from paritas.operators import pareto

    return pareto.front(ensemble_scores(df, n, attrs, positive, metric, **options), ["accuracy", metric], [True, False])
