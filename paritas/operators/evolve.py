"""Search over a space of choices by generations, and over ensembles in particular.

A generation is drawn from a distribution of every named choice, all of its new configurations are scored together (one
Spark job), the best of all that is known are selected by non-dominated fronts and crowding, and each distribution moves
towards what the selected ones chose.  Draws are seeded; each configuration is kept as its log of choices, which
:class:`paritas.operators.search.Choices` replays.

Ensembles are scored on *cells*: counts of rows by groups, tuple of predictions and gold label.  Rows are read once, however
many generations follow; a generation explodes its few candidates inside each cell, so candidates never meet rows in a join.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.operators import ensemble, fairness
from paritas.operators.search import Choices

#: Labels that the learning ensemble tells apart.
MOST_LABELS = 256


class Distributions:
    """What is likely for each named choice: a weight for each option, or mean and deviation of a number."""

    def __init__(self, rate: float = 0.5, explore: float = 0.1):
        self.rate, self.explore = rate, explore
        self.weights: dict[str, dict] = {}
        self.numbers: dict[str, tuple[float, float]] = {}

    def of(self, name: str, options: Sequence) -> list[float]:
        """Weights of the options, each with its share of exploration."""
        known = self.weights.setdefault(name, {})
        for o in options:
            known.setdefault(o, 1 / len(options))
        total = sum(known[o] for o in options) or 1.0
        return [(1 - self.explore) * known[o] / total + self.explore / len(options) for o in options]

    def number(self, name: str, low: float, high: float) -> tuple[float, float]:
        return self.numbers.setdefault(name, ((low + high) / 2, (high - low) / 2))

    def move(self, logs: Sequence[Sequence[tuple[str, object]]]) -> None:
        """Towards the choices of these logs; names that none of them asked stay."""
        met: dict[str, list] = {}
        for log in logs:
            for name, value in log:
                met.setdefault(name, []).extend(value if isinstance(value, tuple) else [value])
        for name, values in met.items():
            if name in self.numbers:
                mean = sum(values) / len(values)
                spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
                old = self.numbers[name]
                self.numbers[name] = tuple((1 - self.rate) * a + self.rate * b for a, b in zip(old, (mean, spread)))
            elif name in self.weights:
                for o, w in self.weights[name].items():
                    self.weights[name][o] = (1 - self.rate) * w + self.rate * values.count(o) / len(values)


class Drawn(Choices):
    """Choices drawn from distributions; the log is that of any Choices."""

    def __init__(self, distributions: Distributions, draws: random.Random):
        super().__init__()
        self.distributions, self.random = distributions, draws

    def _logged(self, name: str, value):
        self.log.append((name, value))
        return value

    def choose(self, name: str, options: Sequence):
        options = list(options)
        return self._logged(name, self.random.choices(options, self.distributions.of(name, options))[0])

    def several(self, name: str, options: Sequence, k: int) -> tuple:
        """k different options, in the order of the options."""
        rest, taken = list(options), []
        weights = dict(zip(rest, self.distributions.of(name, rest)))
        for _ in range(k):
            taken.append(self.random.choices(rest, [weights[o] for o in rest])[0])
            rest.remove(taken[-1])
        return self._logged(name, tuple(o for o in options if o in taken))

    def number(self, name: str, low: float, high: float) -> float:
        mean, spread = self.distributions.number(name, low, high)
        return self._logged(name, min(high, max(low, self.random.gauss(mean, spread))))


class Replayed(Choices):
    """A log played back, with the further kinds of choices."""

    def several(self, name: str, options: Sequence, k: int) -> tuple:
        value = self._given(name)
        if len(value) != k or any(v not in options for v in value):
            raise ValueError(f"the log has {name!r} = {value!r}, asked were {k} of {list(options)!r}")
        return value

    def number(self, name: str, low: float, high: float) -> float:
        value = self._given(name)
        if not low <= value <= high:
            raise ValueError(f"the log has {name!r} = {value!r}, outside {low} to {high}")
        return value

    def _given(self, name: str):
        at = next((i for i, (n, _) in enumerate(self.given) if n == name), None) if self.by_name else 0
        if at is None or at >= len(self.given) or self.given[at][0] != name:
            raise ValueError(f"the log has no {name!r} here")
        value = self.given.pop(at)[1]
        value = tuple(value) if isinstance(value, list) else value
        self.log.append((name, value))
        return value


def beats(x: Sequence[float], y: Sequence[float], maximize: Sequence[bool]) -> bool:
    """Whether x is nowhere worse than y and somewhere better."""
    better = [a > b if up else a < b for a, b, up in zip(x, y, maximize)]
    return any(better) and not any(b > a if up else b < a for a, b, up in zip(x, y, maximize))


def ordered(points: Sequence[Sequence[float]], maximize: Sequence[bool]) -> list[list[int]]:
    """Places of the points by non-dominated fronts; within a front the loneliest points first."""
    rest, fronts = list(range(len(points))), []
    while rest:
        front = [i for i in rest if not any(beats(points[j], points[i], maximize) for j in rest)]
        crowding = dict.fromkeys(front, 0.0)
        for k in range(len(maximize)):
            line = sorted(front, key=lambda i: (points[i][k], i))
            width = points[line[-1]][k] - points[line[0]][k]
            crowding[line[0]] = crowding[line[-1]] = float("inf")
            for a, i, b in zip(line, line[1:], line[2:]):
                crowding[i] += (points[b][k] - points[a][k]) / width if width else 0.0
        fronts.append(sorted(front, key=lambda i: (-crowding[i], i)))
        rest = [i for i in rest if i not in crowding]
    return fronts


class ScoreStore:
    """Scores of configurations in a Parquet table, so that a later search needn't score them again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("key string, scores array<double>").parquet(self.path)
        except AnalysisException:
            return None

    def known(self, keys: Sequence[str]) -> dict[str, tuple]:
        """The scores of those of these keys that are stored."""
        table = self._table()
        if table is None or not keys:
            return {}
        asked = self.spark.createDataFrame([(k,) for k in keys], "key string")
        return {r["key"]: tuple(r["scores"]) for r in table.join(asked, "key", "left_semi").dropDuplicates(["key"]).collect()}

    def add(self, scored: Mapping[str, Sequence[float]]) -> None:
        """Append what isn't stored yet."""
        rows = self.spark.createDataFrame([(k, [float(x) for x in v]) for k, v in scored.items()], "key string, scores array<double>")
        table = self._table()
        (rows if table is None else rows.join(table, "key", "left_anti")).coalesce(1).write.mode("append").parquet(self.path)


@dataclass
class Outcome:
    """All scored configurations in the order met, and the places of those that none beats."""

    logs: list[list[tuple[str, object]]] = field(default_factory=list)
    found: list = field(default_factory=list)
    scores: list[tuple] = field(default_factory=list)
    generation: list[int] = field(default_factory=list)
    front: list[int] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        """generation, place, log (JSON of names and values), scores, best."""
        rows = [(g, i, json.dumps(log), [float(x) for x in s], i in self.front) for i, (g, log, s) in enumerate(zip(self.generation, self.logs, self.scores))]
        return spark.createDataFrame(rows, "generation int, place int, log string, scores array<double>, best boolean")


def search_generations(
    generate: Callable[[Choices], object], score: Callable[[Sequence], Sequence[Sequence[float] | None]], maximize: Sequence[bool], generations: int | None = 10, population: int = 20, selected: int = 5,
    rate: float = 0.5, explore: float = 0.1, seed: int = 0, constraint: Callable[[object, Sequence[float]], bool] | None = None, store: ScoreStore | None = None,
) -> Outcome:
    """Configurations that ``generate`` makes from choices, scored by ``score`` a whole generation at a time.

    A configuration that was met isn't scored again.  One for which generate raises ValueError, or whose scores are None or
    hold a None, is passed over, and so is one that the constraint refuses.  The search ends after so many generations, or
    (always with generations=None) when 50 draws for each place of a generation bring nothing new.
    """
    draws, distributions, out = random.Random(seed), Distributions(rate, explore), Outcome()
    met: set[str] = set()
    generation = 0
    while generations is None or generation < generations:
        new: dict[str, tuple[list, object]] = {}
        for _ in range(50 * population):
            choices = Drawn(distributions, draws)
            try:
                made = generate(choices)
            except ValueError:
                made = None
            key = json.dumps(choices.log)
            if key not in met:
                met.add(key)
                if made is not None:
                    new[key] = (choices.log, made)
            if len(new) == population:
                break
        if not new:
            break
        known = store.known(list(new)) if store else {}
        asked = [k for k in new if k not in known]
        fresh = dict(zip(asked, score([new[k][1] for k in asked]))) if asked else {}
        fresh = {k: tuple(s) for k, s in fresh.items() if s is not None and all(x is not None for x in s)}
        if store and fresh:
            store.add(fresh)
        for key, (log, made) in new.items():
            s = known.get(key, fresh.get(key))
            if s is not None and (constraint is None or constraint(made, s)):
                out.logs.append(log)
                out.found.append(made)
                out.scores.append(s)
                out.generation.append(generation)
        fronts = ordered(out.scores, maximize)
        best = [i for front in fronts for i in front][:selected]
        distributions.move([out.logs[i] for i in best])
        out.front = sorted(fronts[0]) if fronts else []
        generation += 1
    return out


# --- ensembles --------------------------------------------------------------------------------------------------------------

KINDS = ("voting", "learning", "overfit")


def chosen_ensemble(choices, n: int, smallest: int = 2, kinds: Sequence[str] = KINDS) -> tuple[str, tuple[int, ...]]:
    """(kind, classifiers) from named choices: how many, which, and how they are joined."""
    low = min(smallest, n)
    k = choices.choose("n_classifiers", list(range(low, n + 1)))
    members = choices.several("selected_classifiers", list(range(n)), k)
    return choices.choose("ensembler_type", list(kinds)), tuple(members)


def cells(df: DataFrame, attrs: Sequence[str], preds: str = "preds", gold: str = "gold", order: str = "row_id", train: Column | None = None) -> DataFrame:
    """attrs, preds, gold, train, n, first, test: rows that are alike, counted.

    train marks the rows that ensembles are fitted on, the others test them; without it, all rows do both.
    """
    fitted = F.lit(True) if train is None else train
    keyed = df.select(*attrs, F.col(preds).alias("preds"), F.col(gold).alias("gold"), fitted.alias("train"), F.col(order).alias("__order"))
    return keyed.groupBy(*attrs, "preds", "gold", "train").agg(F.count(F.lit(1)).alias("n"), F.min("__order").alias("first")).withColumn("test", F.lit(True) if train is None else ~F.col("train"))


def _weighted_counts(vote: Column, positive) -> list[Column]:
    """What fairness.rates_of needs, from cells of n rows."""
    n, said, actual = F.col("n"), vote == F.lit(positive), F.col("gold").eqNullSafe(F.lit(positive))
    some = lambda when: F.sum(F.when(when, n).otherwise(0))
    return [F.sum(n).alias("n"), some(F.col("gold") == vote).alias("correct"), some(said).alias("p"), some(actual).alias("n_actual"), some(said & actual).alias("p_actual"), some(~actual).alias("n_other"), some(said & ~actual).alias("p_other"), some(said).alias("marked")]


def _learned(train: DataFrame) -> DataFrame:
    """One row: for each label its prior, and the logarithms of how often each classifier says what when the label is true (naive Bayes, one added to each count)."""
    labels = [r[0] for r in train.select("gold").where("gold is not null").distinct().orderBy("gold").limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    told = train.where("gold is not null").select("gold", "n", F.posexplode("preds").alias("i", "said"))
    counts = told.groupBy("i", "said", "gold").agg(F.sum("n").alias("k"))
    said = told.groupBy("i").agg(F.count_distinct("said").alias("kinds"))
    rows = train.where("gold is not null").groupBy("gold").agg(F.sum("n").alias("rows"))
    entries = counts.join(said, "i").join(rows, "gold").groupBy("gold").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "i", "said"), F.log((F.col("k") + 1) / (F.col("rows") + F.col("kinds")))))).alias("told"),
        F.map_from_entries(F.collect_set(F.struct("i", F.log(1 / (F.col("rows") + F.col("kinds")))))).alias("untold"),
        F.first("rows").alias("rows"),
    )
    return entries.agg(F.collect_list(F.struct("gold", "rows", "told", "untold")).alias("model"))


def _scored_by_model(model: Column, members: Column, preds: Column) -> Column:
    """The label of the highest sum of logarithms; of equal ones the largest label."""
    def score(t: Column) -> Column:
        def of(i: Column) -> Column:
            return F.coalesce(t["told"][F.concat_ws("|", i, F.get(preds, i))], t["untold"][i], F.lit(0.0))

        return F.aggregate(members, F.log(t["rows"].cast("double")), lambda total, i: total + of(i))

    return F.array_max(F.transform(model, lambda t: F.struct(F.round(score(t), 9).alias("s"), t["gold"].alias("label"))))["label"]


def ensemble_votes(table: DataFrame, candidates: Sequence[tuple[str, Sequence[int]]], scores: Sequence[float], maximize: bool = True) -> DataFrame:
    """The table's test cells, once for each candidate, with its vote.

    voting: the majority, ties to the best-scored classifier; overfit: the most common gold label of the candidate's tuple of
    predictions where it was fitted (the first met on ties), else the best-scored classifier; learning: naive Bayes over the
    candidate's predictions.
    """
    sign = 1.0 if maximize else -1.0
    made = [F.struct(F.lit(i).alias("candidate"), F.lit(kind).alias("kind"), F.array(*map(F.lit, m)).alias("members"), F.array(*[F.lit(sign * float(scores[j])) for j in m]).alias("own"), F.lit((max if maximize else min)(m, key=lambda j: scores[j])).alias("best")) for i, (kind, m) in enumerate(candidates)]
    each = table.withColumn("__c", F.explode(F.array(*made))).select(*table.columns, "__c.*")
    each = each.withColumn("some", F.transform("members", lambda i: F.get(F.col("preds"), i)))
    tested = each.where("test")
    vote = ensemble.scored_vote(F.col("some"), F.col("own"))
    kinds = {k for k, _ in candidates}
    if "learning" in kinds:
        tested = tested.crossJoin(F.broadcast(_learned(table.where("train"))))  # one row
        vote = F.when(F.col("kind") == "learning", _scored_by_model(F.col("model"), F.col("members"), F.col("preds"))).otherwise(vote)
    if "overfit" in kinds:
        seen = each.where((F.col("kind") == "overfit") & F.col("train")).groupBy("candidate", "some", "gold").agg(F.sum("n").alias("k"), F.min("first").alias("at"))
        learnt = seen.groupBy("candidate", "some").agg(F.max_by("gold", F.struct("k", -F.col("at"))).alias("__seen"))
        tested = tested.join(learnt, ["candidate", "some"], "left")
        vote = F.when(F.col("kind") == "overfit", F.coalesce("__seen", F.get(F.col("preds"), F.col("best")))).otherwise(vote)
    return tested.withColumn("vote", vote)


def score_ensembles(table: DataFrame, candidates: Sequence[tuple[str, Sequence[int]]], scores: Sequence[float], attrs: Sequence[str], positive, metrics: Sequence[str] = ("statistical_parity",), maximize: bool = True) -> DataFrame:
    """candidate, accuracy and the spread of each metric, from cells; one aggregation for all candidates."""
    votes = ensemble_votes(table, candidates, scores, maximize)
    counts = votes.groupBy("candidate", *attrs).agg(*_weighted_counts(F.col("vote"), positive))
    known = counts.groupBy("candidate").agg((F.sum("correct") / F.sum("n")).alias("accuracy"))
    return known.join(fairness.spreads(fairness.rates_of(counts, attrs, within=["candidate"]), metrics, by=["candidate"]), "candidate", "left")


def search_ensembles(table: DataFrame, n: int, scores: Sequence[float], attrs: Sequence[str], positive, metrics: Sequence[str] = ("statistical_parity",), kinds: Sequence[str] = KINDS, smallest: int = 2, detriment: float | None = None, **options) -> Outcome:
    """Ensembles of n classifiers over cells: higher accuracy, smaller spreads; options go to search_generations.

    With a detriment, ensembles whose accuracy falls too far below the best single classifier's score are left out.
    """
    def score(candidates: Sequence) -> list[tuple]:
        rows = {r["candidate"]: tuple(r[c] for c in ("accuracy", *metrics)) for r in score_ensembles(table, candidates, scores, attrs, positive, metrics).collect()}
        return [rows.get(i) for i in range(len(candidates))]

    limit = None if detriment is None else ensemble.detriment_limit(max(scores), detriment)
    constraint = options.pop("constraint", None)

    def allowed(made, s) -> bool:
        return (limit is None or s[0] >= limit) and (constraint is None or constraint(made, s))

    table = table.persist()  # read once for each generation
    try:
        return search_generations(lambda c: chosen_ensemble(c, n, smallest, kinds), score, [True, *[False] * len(metrics)], constraint=allowed, **options)
    finally:
        table.unpersist()
