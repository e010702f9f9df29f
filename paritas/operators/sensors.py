"""Annotation of texts with attribute values: filters, aggregators, merges and sensors.

Scored attributes are array<struct<attr, score>> columns, one array per token;
an item's tokens are an array of those.  Filters and aggregators are column
expressions, so a whole pipeline is one projection over the item's row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.text import mentions

DEFAULT_THRESHOLD = 0.05
#: Thresholds of the plain sensor: of the token filter and of the final one.
PLAIN = (0.2, 0.7)


# --- filters: array<struct<attr, score>> -> the same ----------------------------------------------------------------


def large_enough(scored: Column, threshold: float) -> Column:
    return F.filter(scored, lambda s: s["score"] > threshold)


def best_score(scored: Column, threshold: float, zero: float = 0.0) -> Column:
    """Attributes over threshold times the best score, if that is over zero."""
    best = F.array_max(F.transform(scored, lambda s: s["score"]))
    return F.when(best > zero, F.filter(scored, lambda s: s["score"] / best > threshold)).otherwise(F.filter(scored, lambda s: F.lit(False)))


def non_neutral(scored: Column, threshold: float, zero: float = 0.0) -> Column:
    """best_score, but nothing if every attribute survives it."""
    kept = best_score(scored, threshold, zero)
    return F.when(F.size(kept) < F.size(scored), kept).otherwise(F.filter(scored, lambda s: F.lit(False)))


def non_empty_words(words: Column) -> Column:
    return F.filter(words, lambda w: F.btrim(w) != "")


def without_stopwords(words: Column, stopwords: Sequence[str]) -> Column:
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w)))


# --- aggregators: array of tokens' scored attributes -> scored attributes of the item -----------------------------------


def _over(scored: Column, threshold: float | None) -> Column:
    """Attributes over the threshold; 0 means the default, as None does."""
    return F.filter(scored, lambda s: s["score"] > (threshold or DEFAULT_THRESHOLD))


def _by_attr(tokens: Column, attrs: Sequence[str], score) -> Column:
    """A struct for each attribute that some token has."""
    made = []
    for attr in attrs:
        own = F.filter(F.flatten(tokens), _is(attr))
        made.append(F.when(F.size(own) > 0, F.struct(F.lit(attr).alias("attr"), score(own).cast("double").alias("score"))))
    return F.array_compact(F.array(*made))


def _is(attr: str):
    return lambda s: s["attr"] == attr


def _total(own: Column) -> Column:
    return F.aggregate(own, F.lit(0.0), lambda t, s: t + s["score"])


def count_aggregator(tokens: Column, attrs: Sequence[str], threshold: float | None = None) -> Column:
    """Tokens that have the attribute over the greatest such count."""
    counts = _by_attr(tokens, attrs, F.size)
    most = F.array_max(F.transform(counts, lambda s: s["score"]))
    return _over(F.transform(counts, lambda s: F.struct(s["attr"].alias("attr"), (s["score"] / most).alias("score"))), threshold)


def activation_aggregator(tokens: Column, attrs: Sequence[str], activation: str = "max", threshold: float | None = None) -> Column:
    """Scores folded from 0: max, sum, or mult (which stays 0)."""
    fold = {"max": lambda own: F.greatest(F.array_max(F.transform(own, lambda s: s["score"])), F.lit(0.0)), "sum": _total, "mult": lambda own: F.lit(0.0)}[activation]
    return _over(_by_attr(tokens, attrs, fold), threshold)


def union_aggregator(tokens: Column, attrs: Sequence[str]) -> Column:
    """Every attribute that some token has, whatever its score."""
    return _by_attr(tokens, attrs, lambda own: F.array_max(F.transform(own, lambda s: s["score"])))


def sum_aggregator(tokens: Column, attrs: Sequence[str], threshold: float | None = None) -> Column:
    return _over(_by_attr(tokens, attrs, _total), threshold)


def voting_aggregator(tokens: Column, attrs: Sequence[str], threshold: float | None = None) -> Column:
    """Tokens that have the attribute over the number of tokens."""
    return _over(_by_attr(tokens, attrs, lambda own: F.size(own) / F.size(tokens)), threshold)


AGGREGATORS = ("count", "sum", "max", "mult", "vote", "union")


def aggregate_items(tokens: DataFrame, attrs: Sequence[str], kind: str, key: Sequence[str] = ("doc_id",), scored: str = "scored", threshold: float | None = None, attr_filter=None, skip_empty: bool = False) -> DataFrame:
    """key and scored attributes of each item, from a row per token: what the aggregators above give, by partial sums, so that no item's tokens are collected.

    attr_filter takes the place of the threshold; skip_empty leaves tokens without an attribute out of their number.
    """
    if kind not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {kind!r}")
    sums = [(F.count_if(F.size(scored) > 0) if skip_empty else F.count(F.lit(1))).alias("__n")]
    for i, a in enumerate(attrs):
        own = F.filter(scored, _is(a))
        sums += [F.sum(F.size(own)).alias(f"__c{i}"), F.sum(_total(own)).alias(f"__s{i}"), F.max(F.array_max(F.transform(own, lambda x: x["score"]))).alias(f"__m{i}")]
    totals = tokens.groupBy(*key).agg(*sums)
    most = F.greatest(*[F.col(f"__c{i}") for i in range(len(attrs))], F.lit(0))
    made = {
        "count": lambda i: F.col(f"__c{i}") / most, "sum": lambda i: F.col(f"__s{i}"), "max": lambda i: F.greatest(F.col(f"__m{i}"), F.lit(0.0)),
        "mult": lambda i: F.lit(0.0), "vote": lambda i: F.col(f"__c{i}") / F.col("__n"), "union": lambda i: F.col(f"__m{i}"),
    }[kind]
    item = F.array_compact(F.array(*[F.when(F.col(f"__c{i}") > 0, F.struct(F.lit(a).alias("attr"), made(i).cast("double").alias("score"))) for i, a in enumerate(attrs)]))
    kept = attr_filter(item) if attr_filter else item if kind == "union" else _over(item, threshold)
    return totals.select(*key, kept.alias(scored))


# --- merges of several sensors' annotations ------------------------------------------------------------------------------


def values_of(scored: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(scored, lambda s: s["attr"])))


def union_merge(annotations: Sequence[Column]) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*annotations))))


def intersection_merge(annotations: Sequence[Column]) -> Column:
    if not annotations:
        raise ValueError("no annotation to intersect")
    out = annotations[0]
    for other in annotations[1:]:
        out = F.array_intersect(out, other)
    return F.array_sort(F.array_distinct(out))


def uniform_weights(n: int) -> list[float]:
    return [1.0 / n] * n


def parametric_weights(weights: Sequence[float], n: int, normalize: bool = True) -> list[float]:
    """The given weights, one per sensor; normalised unless they sum to 0."""
    if len(weights) != n:
        raise ValueError("one weight per sensor is needed")
    total = sum(weights)
    return [w / total for w in weights] if normalize and total else list(weights)


def weighted_merge(annotations: Sequence[Column], weights: Sequence[float], attrs: Sequence[str], threshold: float | None = None) -> Column:
    """Each sensor's values score its weight; a value stays if its sum is over the threshold."""
    tokens = F.array(*[F.transform(a, _weighted(w)) for a, w in zip(annotations, weights)])
    return values_of(sum_aggregator(tokens, attrs, threshold))


def _weighted(w: float):
    return lambda v: F.struct(v.alias("attr"), F.lit(float(w)).alias("score"))


def to_class_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


# --- sensors ---------------------------------------------------------------------------------------------------------------


def words_of(text: Column, pattern: str = r"\w+") -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U)({pattern})"), F.lit(1))


def sentences_of(text: Column) -> Column:
    """Sentences, cut after closing punctuation and at line ends."""
    return non_empty_words(F.split(text, r"(?<=[.!?])\s+|\R"))


def lexicon_sensor(words: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """The groups that have a word of the item."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, some))), F.lit(g)) for g, some in sorted(lexicon.items())]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 if a vector is missing or zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def similarities(vector: Column, attributes: Mapping[str, Sequence[float]]) -> Column:
    """Absolute similarity of a token's vector to each attribute's; missing vectors score 0."""
    made = [F.struct(F.lit(a).alias("attr"), F.abs(cosine(vector, F.array(*[F.lit(float(x)) for x in v]))).alias("score")) for a, v in attributes.items()]
    return F.array(*made)


def is_person(vector: Column, person: Sequence[float], other: Sequence[float]) -> Column:
    """Whether a vector is more like the anchor of persons than the other one (no vector: neither, so no)."""
    like = lambda anchor: cosine(vector, F.array(*[F.lit(float(x)) for x in anchor]))
    return like(person) > like(other)


def summed_vectors(parts: Column, size: int) -> Column:
    """The sum of the vectors of a token's parts."""
    return F.aggregate(parts, F.array_repeat(F.lit(0.0), size), lambda total, v: F.zip_with(total, v, lambda a, b: a + b.cast("double")))


def embedding_sensor(tokens: DataFrame, attributes: Mapping[str, Sequence[float]], key: Sequence[str] = ("doc_id",), vector: str = "vector", token_filter: float = PLAIN[0], final: float = PLAIN[1]) -> DataFrame:
    """key and values: similarities per token, large ones, their mean vote per item, best ones."""
    attrs = list(attributes)
    scored = tokens.select(*key, large_enough(similarities(F.col(vector), attributes), token_filter).alias("scored"))
    # sums and counts per attribute are partial aggregates: no item's tokens are collected
    sums = [F.sum(F.aggregate(F.filter("scored", _is(a)), F.lit(0.0), lambda t, s: t + s["score"])).alias(f"__s{i}") for i, a in enumerate(attrs)]
    totals = scored.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *sums)
    item = F.filter(F.array(*[F.struct(F.lit(a).alias("attr"), (F.col(f"__s{i}") / F.col("__n")).alias("score")) for i, a in enumerate(attrs)]), lambda s: s["score"] > DEFAULT_THRESHOLD)
    return totals.select(*key, values_of(best_score(item, final)).alias("values"))


def name_sensor(entities: DataFrame, names: DataFrame, attrs: Sequence[str], attention: float = 0.0, threshold: float = 0.75, key: str = "entity_id", words: str = "words") -> DataFrame:
    """Per entity: shares of each attribute among uses of its names (table name, attr, count), weakened by place, best ones kept.

    The n-th token weighs attention ** n; with attention 0 the first alone counts.
    """
    totals = names.groupBy("name").agg(*[F.sum(F.when(F.col("attr") == a, F.col("count")).otherwise(0)).alias(f"__c{i}") for i, a in enumerate(attrs)], F.sum("count").alias("__all"))
    placed = entities.select(key, F.posexplode_outer(words).alias("__p", "name"))
    weight = F.when(F.col("__p") == 0, 1.0).otherwise(F.pow(F.lit(float(attention)), F.col("__p")))
    met = placed.join(totals, "name", "left").groupBy(key).agg(*[F.sum(F.coalesce(F.try_divide(F.col(f"__c{i}"), F.col("__all")), F.lit(0.0)) * weight).alias(f"__s{i}") for i in range(len(attrs))])
    scored = F.array(*[F.struct(F.lit(a).alias("attr"), F.coalesce(f"__s{i}", F.lit(0.0)).alias("score")) for i, a in enumerate(attrs)])
    return met.select(key, values_of(best_score(scored, threshold)).alias("values"))


def coreference_sensor(clusters: DataFrame, pronouns: Mapping[str, str], attrs: Sequence[str], threshold: float | None = None, key: str = "doc_id") -> DataFrame:
    """Per item, from clusters (key, cluster_id, mention): each pronoun mention scores 1 / size of its cluster."""
    known = F.create_map(*[F.lit(x) for pair in pronouns.items() for x in pair])
    per = clusters.groupBy(key, "cluster_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.try_element_at(known, F.lower("mention")) == a).alias(f"__c{i}") for i, a in enumerate(attrs)])
    item = per.groupBy(key).agg(*[F.sum(F.col(f"__c{i}") / F.col("n")).alias(f"__s{i}") for i in range(len(attrs))])
    scored = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"__s{i}").alias("score")) for i, a in enumerate(attrs)])
    return item.select(key, values_of(_over(scored, threshold)).alias("values"))


def handle_sensor(texts: DataFrame, handles: DataFrame, names: DataFrame, attrs: Sequence[str], key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Handles of a text to profile names (table handle, name), names to attributes, united per text."""
    found = texts.select(key, F.explode(mentions(F.col(text))).alias("handle")).join(handles, "handle")
    people = found.select(key, "handle", words_of(F.col("name")).alias("words")).withColumn("entity_id", F.struct(key, "handle"))
    values = name_sensor(people, names, attrs, **options)
    return values.groupBy(F.col(f"entity_id.{key}").alias(key)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))


#: Letters from rare to frequent; any other character counts as rarer.  The order decides what names meet by, not what is found.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "


def _letters(name: Column) -> Column:
    """The characters of a name, rare ones first, each with its number among equal ones, as strings."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    ordered = F.transform(F.array_sort(F.transform(chars, lambda c: F.struct(F.position(c, F.lit(RARE_FIRST)).alias("r"), c.alias("c")))), lambda x: x["c"])
    return F.transform(ordered, lambda c, i: F.concat(c, (i - F.array_position(ordered, c)).cast("string")))


def fuzzy_matches(entities: DataFrame, people: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(entity, person, ratio) of names alike by Ratcliff-Obershelp, at the cutoff or more.

    The ratio is at most 2 * (shared letters) / (both lengths), with letters counted as
    often as both have them.  So a pair at the cutoff has lengths within a bound and
    shares at least need = cutoff * (both lengths) / 2 letters; then the rarest
    (length - need + 1) letters of the two share one.  Names meet by (both lengths, such
    a letter), pairs are counted out by their shared letters, and only the rest reach
    the pandas function.
    """
    reach = (2 - cutoff) / cutoff
    need = lambda a, b: F.ceil(F.lit(cutoff) * (a + b) / 2 - 1e-9).cast("int")

    def posted(names: DataFrame, own: str, mine: str, other: str) -> DataFrame:
        known = names.select(own).distinct().select(own, _letters(F.col(own)).alias(f"{own}_letters"), F.length(own).alias(mine)).where(F.col(mine) > 0)
        lengths = known.select("*", F.explode(F.sequence(F.ceil(F.col(mine) / reach).cast("int"), F.floor(F.col(mine) * reach).cast("int"))).alias(other))
        first = F.slice(f"{own}_letters", 1, F.greatest(F.col(mine) - need(F.col(mine), F.col(other)) + 1, F.lit(0)))
        return lengths.select(own, f"{own}_letters", mine, other, F.explode(first).alias("letter"))

    met = posted(entities, "entity", "m", "n").join(posted(people, "person", "n", "m"), ["m", "n", "letter"])
    shared = F.size(F.array_intersect("entity_letters", "person_letters"))
    pairs = met.where(shared >= need(F.col("m"), F.col("n"))).select("entity", "person").distinct()

    def ratio(entity: pd.Series, person: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, e).ratio() for e, p in zip(entity, person)], dtype="float64")

    score = F.pandas_udf(ratio, "double")
    return pairs.select("entity", "person", score("entity", "person").alias("ratio")).where(F.col("ratio") >= cutoff)


def knowledge_sensor(entities: DataFrame, people: DataFrame, standard: Mapping[str, Sequence[str]], attrs: Sequence[str], cutoff: float = 0.6, threshold: float = 0.9) -> DataFrame:
    """Per entity: values of people (person, property_value) with names like it, standardised, greatest ratio, best ones."""
    known = F.create_map(*[x for value, some in standard.items() for x in (F.lit(value), F.array(*map(F.lit, some)))])
    met = fuzzy_matches(entities, people.select("person"), cutoff).join(people, "person").withColumn("attr", F.explode(F.coalesce(F.try_element_at(known, F.col("property_value")), F.array().cast("array<string>"))))
    best = met.groupBy("entity").agg(*[F.max(F.when(F.col("attr") == a, F.col("ratio"))).alias(f"__s{i}") for i, a in enumerate(attrs)])
    scored = F.filter(F.array(*[F.struct(F.lit(a).alias("attr"), F.coalesce(f"__s{i}", F.lit(0.0)).alias("score")) for i, a in enumerate(attrs)]), lambda s: s["score"] > DEFAULT_THRESHOLD)
    return best.select("entity", values_of(best_score(scored, threshold)).alias("values"))


def constant_sensor(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, sorted(values))) if values else F.array().cast("array<string>")


def random_sensor(id_col: str, drop: Mapping[str, float], seed: int = 0) -> Column:
    """An attribute stays where a seeded number of the id is over its drop probability."""
    at = lambda a: F.pmod(F.xxhash64(F.lit(seed), F.lit(a), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    return F.array_sort(F.array_compact(F.array(*[F.when(at(a) > p, F.lit(a)) for a, p in drop.items()])))


def entity_sensor(entities: DataFrame, labels: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Per item: the values of its entities (key, label, values) of some labels, united."""
    return entities.where(F.col("label").isin(*labels)).select(key, F.explode("values").alias("v")).groupBy(key).agg(F.array_sort(F.collect_set("v")).alias("values"))


def baseline(kind: str, id_col: str, priors: Mapping[str, float], seed: int = 0) -> Column:
    """The named baselines: always-<value>, always-both, always-none, random (a value stays with its prior)."""
    if kind == "random":
        return random_sensor(id_col, {a: 1 - p for a, p in priors.items()}, seed)
    value = kind.removeprefix("always-")
    return constant_sensor(list(priors) if value == "both" else [] if value == "none" else [value])


class SensorHandler:
    """Runs the sensors chosen for an attribute class and merges their annotations.

    A sensor is (name, attribute classes or None for any, function of the DataFrame giving a column), with the
    kind of its input as a fourth part if it isn't for any.
    """

    def __init__(self, sensors, merge=union_merge):
        self.sensors, self.merge = list(sensors), merge

    def select(self, attr_class: str | None, input_kind: str | None = None) -> Iterator[tuple]:
        fits = lambda s: attr_class is None or s[1] is None or attr_class in s[1]
        takes = lambda s: input_kind is None or len(s) < 4 or s[3] == input_kind
        return (s for s in self.sensors if fits(s) and takes(s))

    def annotate(self, df: DataFrame, attr_class: str | None = None, out: str = "values", input_kind: str | None = None) -> DataFrame:
        chosen = list(self.select(attr_class, input_kind))
        if not chosen:
            raise ValueError("no sensor for this attribute")
        return df.withColumn(out, self.merge([s[2](df) for s in chosen]))
