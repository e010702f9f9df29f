"""Embedding sensors over levels of a text, with a registry of vector tables.

A text is cut into tokens by levels (text -> words, or text -> sentences -> words);
each token meets its vector by an equi-join; its scores are filtered; then one
aggregator per level, the last level first, reduces tokens to their sentence and
sentences to their text.  Every level is one aggregation with partial sums, so a text
of any length is no one task's burden.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.operators import sensors


class VectorRegistry:
    """Vector tables (word, vector) by (language, source); a table may be given as a function that makes it when first asked for."""

    def __init__(self):
        self._known: dict[tuple[str, str], DataFrame | Callable[[], DataFrame]] = {}

    def register(self, language: str, source: str, table: DataFrame | Callable[[], DataFrame]) -> None:
        self._known[language, source] = table

    def load(self, language: str, source: str) -> DataFrame:
        if (language, source) not in self._known:
            raise KeyError(f"no vectors for {language} from {source}; known: {sorted(self._known)}")
        table = self._known[language, source]
        if callable(table):
            table = self._known[language, source] = table()
        return table


def with_subwords(parts: DataFrame, size: int, word: str = "word", vector: str = "vector") -> DataFrame:
    """One vector a word: the sum of those of its parts, as contextual models give them; element by element, in partial sums."""
    sums = F.array(*[F.sum(F.get(vector, F.lit(i)).cast("double")) for i in range(size)])
    return parts.groupBy(word).agg(sums.alias(vector))


def scored_by(kind: str, vector: Column, attributes: Mapping[str, Sequence[float]]) -> Column:
    """Scores of a token: the absolute cosine, or 1 - cosine (which the contextual models call similarity); no vector scores 0."""
    if kind == "cosine":
        return sensors.similarities(vector, attributes)
    if kind != "distance":
        raise ValueError(f"unknown similarity {kind!r}")
    made = [F.struct(F.lit(a).alias("attr"), F.when(vector.isNull(), 0.0).otherwise(F.abs(1 - sensors.cosine(vector, F.array(*[F.lit(float(x)) for x in v])))).alias("score")) for a, v in attributes.items()]
    return F.array(*made)


@dataclass(frozen=True)
class Configuration:
    """What an embedding sensor does: levels, filters and aggregators are named, so that a configuration can be stored and replayed.

    A filter is (name, relative threshold, threshold of the norm); an aggregator is
    (kind, filter or None), one for each level, the last level first.
    """

    levels: tuple[str, ...] = ("words",)
    filters: tuple[tuple, ...] = (("non_neutral", 0.7, 0.2),)
    aggregators: tuple[tuple, ...] = (("union", None),)
    stopwords: tuple[str, ...] = ()
    source: str = "table"
    similarity: str = "cosine"
    cutters: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if len(self.aggregators) != len(self.levels):
            raise ValueError("one aggregator for each level is needed to reduce a text to one value")


#: The two builds that are offered by default: words of the whole text, and words of its sentences.
PLAIN = Configuration()
HIERARCHY = Configuration(("sentences", "words"), (("non_neutral", 0.75, 0.05),), (("max", ("best", 0.75, 0.05)), ("union", None)))
_CUTTERS = {"words": sensors.words_of, "sentences": sensors.sentences_of}


def apply_filter(scored: Column, how: tuple | None) -> Column:
    """A named filter of scored attributes; None keeps them all."""
    if how is None or how[0] == "none":
        return scored
    name, *thresholds = how
    made = {"large": lambda t: sensors.large_enough(scored, t), "best": lambda t, zero=0.0: sensors.best_score(scored, t, zero), "non_neutral": lambda t, zero=0.0: sensors.non_neutral(scored, t, zero)}
    return made[name](*thresholds)


def tokens_of(texts: DataFrame, configuration: Configuration, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the places of the inner levels (l1, l2, ...), token; an item without a token has one that is null."""
    cutters = _CUTTERS | dict(configuration.cutters)
    out = texts.select(key, F.col(text).alias("token"))
    for i, level in enumerate(configuration.levels, 1):
        kept = [c for c in out.columns if c != "token"]
        out = out.select(*kept, F.posexplode_outer(cutters[level](F.col("token"))).alias(f"l{i}", "token"))
    return out


def annotate(texts: DataFrame, vectors: DataFrame, attributes: Mapping[str, Sequence[float]], configuration: Configuration = PLAIN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and values (sorted attributes) of every text; vectors is a table (word, vector), attributes are few."""
    tokens = tokens_of(texts, configuration, key, text)
    if configuration.stopwords:
        stop = F.array(*map(F.lit, configuration.stopwords))
        tokens = tokens.withColumn("token", F.when(~F.array_contains(stop, F.lower("token")), F.col("token")))
    met = tokens.join(vectors.select(F.col("word").alias("token"), F.col("vector").alias("__v")), "token", "left")
    scored = F.when(F.col("token").isNull(), F.array().cast("array<struct<attr:string,score:double>>")).otherwise(scored_by(configuration.similarity, F.col("__v"), attributes))
    for how in configuration.filters:
        scored = apply_filter(scored, how)
    names, depth = list(attributes), len(configuration.levels)
    items = met.select(key, *[f"l{i}" for i in range(1, depth + 1)], scored.alias("scored"))
    for step, (kind, how) in enumerate(configuration.aggregators):
        keys = [key, *[f"l{i}" for i in range(1, depth - step)]]
        items = sensors.aggregate_items(items, names, kind, keys, attr_filter=(lambda c, h=how: apply_filter(c, h)) if how else None, skip_empty=True)
    return items.select(key, sensors.values_of(F.col("scored")).alias("values"))


# --- the space of configurations -----------------------------------------------------------------------------------------

FILTERS, KINDS = ("large", "best", "non_neutral", "none"), ("count", "max", "sum", "vote", "union")
THRESHOLDS = (0.05, 0.2, 0.5, 0.7, 0.75)


def chosen(choices, stopwords: Sequence[str] = (), sources: Sequence[str] = ("table",)) -> Configuration:
    """A configuration from named choices (:class:`paritas.operators.search.Choices`); a log replays it."""
    def filter_of(prefix: str) -> tuple:
        name = choices.choose(f"{prefix}filter", FILTERS)
        if name == "none":
            return (name,)
        first = choices.choose(f"{prefix}{name}-threshold", THRESHOLDS)
        return (name, first) if name == "large" else (name, first, choices.choose(f"{prefix}{name}-norm", THRESHOLDS))

    levels = ("words",) if choices.choose("plain", (True, False)) else ("sentences", "words")
    left_out = tuple(stopwords) if choices.choose("stopwords", (True, False)) else ()
    filters = (filter_of("token-"),)
    aggregators = tuple((choices.choose(f"aggregator-{i}", KINDS), filter_of(f"aggregator-{i}-")) for i in range(len(levels)))
    return Configuration(levels, filters, aggregators, left_out, choices.choose("source", tuple(sources)))


SENSORS = ("embedding", "coreference", "knowledge", "names")
MERGES = ("union", "intersection", "uniform", "weighted")


def chosen_sensors(choices, forced: Sequence[str] = (), considered: Sequence[str] = SENSORS, force_union: bool = False) -> dict:
    """Which sensors run and how they are merged; forced ones aren't asked for, and one alone needs no merge."""
    names = [n for n in SENSORS if n in forced or n in considered and choices.choose(f"include-{n}", (True, False))]
    out: dict = {"sensors": names, "merge": None}
    if len(names) > 1:
        out["merge"] = "union" if force_union else choices.choose("merge", MERGES)
        if out["merge"] == "weighted":
            out["weights"] = [choices.choose(f"weight-{n}", THRESHOLDS) for n in names]
    return out
