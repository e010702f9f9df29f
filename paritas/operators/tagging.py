"""A tagger: a hidden Markov model of order one, counted from tagged sentences, and Viterbi's best path for others.

Counts are two aggregations over the tagged table.  The model that goes to the workers is bounded: at most MOST_TAGS tags, the
MOST_WORDS most frequent words; other words go by their last letters, as the words that were seen once do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.operators.bias import _written

MOST_TAGS, MOST_WORDS = 256, 200_000
#: Letters at a word's end that stand for a word not known.
ENDING = 3


@dataclass
class Tagger:
    """Tags in order, and the logarithms of their chances: first tag, next tag, last tag, word, ending."""

    tags: list[str]
    first: np.ndarray
    follow: np.ndarray
    last: np.ndarray
    words: dict[str, np.ndarray]
    endings: dict[str, np.ndarray]
    unseen: np.ndarray

    def emission(self, word: str) -> np.ndarray:
        """Of each tag, how likely it gives the word; of a word not known, its ending."""
        known = self.words.get(word)
        return known if known is not None else self.endings.get(ending(word), self.unseen)

    def best(self, words: list[str]) -> list[str]:
        """The most likely tags (Viterbi); of equal paths, the one with the earlier tag at the last place where they differ."""
        if not words:
            return []
        score = self.first + self.emission(words[0])
        back = np.zeros((len(words), len(self.tags)), np.int32)
        for i, word in enumerate(words[1:], 1):
            ways = score[:, None] + self.follow
            back[i] = ways.argmax(axis=0)
            score = ways[back[i], np.arange(len(self.tags))] + self.emission(word)
        at = int((score + self.last).argmax())
        out = [at]
        for i in range(len(words) - 1, 0, -1):
            at = int(back[i, at])
            out.append(at)
        return [self.tags[k] for k in reversed(out)]

    def best_of_many(self, sentences: list[list[str]]) -> list[list[str]]:
        """best() of each, place by place for all sentences at once; the same path, by the same sums."""
        order = sorted((k for k, words in enumerate(sentences) if words), key=lambda k: -len(sentences[k]))
        out: list[list[str]] = [[] for _ in sentences]
        if not order:
            return out
        kinds: dict[str, int] = {}
        codes = np.fromiter((kinds.setdefault(w, len(kinds)) for k in order for w in sentences[k]), np.int64, sum(len(sentences[k]) for k in order))
        emission = np.stack([self.emission(w) for w in kinds])
        lengths = np.array([len(sentences[k]) for k in order])
        starts = np.cumsum(lengths) - lengths
        back = np.zeros((len(codes), len(self.tags)), np.uint16)
        score = self.first + emission[codes[starts]]
        live = len(order)  # sentences that have a word at this place come first
        last = np.empty_like(score)
        for i in range(1, int(lengths[0]) + 1):
            now = int(np.searchsorted(-lengths, -i, side="left"))  # those longer than i
            last[now:live] = score[now:live]
            score, live = score[:now], now
            if not now:
                break
            at = starts[:now] + i
            ways = score[:, :, None] + self.follow
            step = ways.argmax(axis=1)
            back[at] = step
            score = np.take_along_axis(ways, step[:, None, :], 1)[:, 0, :] + emission[codes[at]]
        tag = (last + self.last).argmax(axis=1)
        path = np.empty(len(codes), np.int64)
        path[starts + lengths - 1] = tag
        for i in range(int(lengths[0]) - 1, 0, -1):
            now = int(np.searchsorted(-lengths, -i, side="left"))
            at = starts[:now] + i
            path[at - 1] = back[at, path[at]]
        names = np.array(self.tags, object)[path]
        for k, a, n in zip(order, starts.tolist(), lengths.tolist()):
            out[k] = names[a : a + n].tolist()
        return out

    def score(self, words: list[str], tags: list[str]) -> float:
        """The logarithm of the chance of a path."""
        at = [self.tags.index(t) for t in tags]
        return float(self.first[at[0]] + sum(self.follow[a, b] for a, b in zip(at, at[1:])) + self.last[at[-1]] + sum(self.emission(w)[k] for w, k in zip(words, at)))


def ending(word: str) -> str:
    return word[-ENDING:]


def fit_tagger(tagged: DataFrame, words: str = "words", tags: str = "tags", added: float = 0.1) -> Tagger:
    """A tagger from a table of sentences: two arrays of one length.  Empty, null and unequal ones aren't learned from.

    More than MOST_TAGS tags raise ValueError, and so does a table without any.
    """
    sound = tagged.where((F.size(words) == F.size(tags)) & (F.size(words) > 0) & F.forall(words, lambda w: w.isNotNull()) & F.forall(tags, lambda t: t.isNotNull())).select(F.col(words).alias("w"), F.col(tags).alias("t"))
    edge = F.array(F.lit(None).cast("string"))
    steps = sound.select(F.explode(F.arrays_zip(F.concat(edge, "t").alias("a"), F.concat("t", edge).alias("b"))).alias("s")).select("s.*").toDF("a", "b")
    pairs = _written(steps.groupBy("a", "b").count())  # a row for each pair of tags
    names = [r[0] for r in pairs.where("b is not null").select("b").distinct().orderBy("b").limit(MOST_TAGS + 1).collect()]
    if not 0 < len(names) <= MOST_TAGS:
        raise ValueError(f"{len(names)} tags: there must be 1 to {MOST_TAGS}")
    at = {t: i for i, t in enumerate(names)}
    n = len(names)
    moves = np.zeros((n + 1, n + 1))
    for r in pairs.collect():
        moves[at.get(r["a"], n), at.get(r["b"], n)] += r["count"]
    moves += added
    moves[n, n] = 0  # no sentence is empty
    with np.errstate(divide="ignore"):
        chances = np.log(moves / moves.sum(axis=1, keepdims=True))
    given = sound.select(F.explode(F.arrays_zip("w", "t")).alias("s")).select("s.w", "s.t")
    # a row for each word, read again by each of the sums below
    counts = _written(given.groupBy("w").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("t") == F.lit(t)).alias(f"c{i}") for i, t in enumerate(names)]))
    kinds = counts.count()
    per_tag = np.array(counts.agg(*[F.sum(f"c{i}") for i in range(n)]).first(), float)
    bottom = np.log(per_tag + added * (kinds + 1))

    def logs(row) -> np.ndarray:
        return np.log(np.array([row[f"c{i}"] for i in range(n)], float) + added) - bottom

    known = {r["w"]: logs(r) for r in counts.orderBy(F.desc("n"), "w").limit(MOST_WORDS).collect()}
    rare = counts.where("n = 1").groupBy(F.substring("w", -ENDING, ENDING).alias("e")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)])
    endings = {r["e"]: logs(r) for r in rare.orderBy(F.desc("n"), "e").limit(MOST_WORDS).collect()}
    single = rare.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(n)]).first()
    unseen = np.log(np.array(single, float) + added) - bottom
    return Tagger(names, chances[n, :n], chances[:n, :n], chances[:n, n], known, endings, unseen)


def tag(sentences: DataFrame, tagger: Tagger, words: str = "words", name: str = "tags") -> DataFrame:
    """sentences with their most likely tags; null and empty sentences have none."""
    sent = sentences.sparkSession.sparkContext.broadcast(tagger)
    columns = [F.col(f"`{c}`") for c in sentences.columns]
    packed = sentences.select(F.struct(*columns).alias("row"), F.col(words).alias("__words"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, tags array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = sent.value.best_of_many([[x or "" for x in w or []] for w in batch.column("__words").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best, pa.list_(pa.string()))], names=["row", "tags"])

    out = packed.mapInArrow(run, schema)
    return out.select("row.*", F.col("tags").alias(name))


def tagged_tokens(words: Column, tags: Column, lemmas: Column | None = None) -> Column:
    """What bias.lexical_tokens takes: structs of text, lower, lemma, pos, gender, definite.

    lemmas is a map from lower-cased word to lemma; a word that isn't there is its own.
    """
    def one(x: Column) -> Column:
        low = F.lower(x["w"])
        lemma = low if lemmas is None else F.coalesce(F.try_element_at(lemmas, low), low)
        none = F.lit(None).cast("string")
        return F.struct(x["w"].alias("text"), low.alias("lower"), lemma.alias("lemma"), x["t"].alias("pos"), none.alias("gender"), none.alias("definite"))

    return F.transform(F.arrays_zip(words.alias("w"), tags.alias("t")), one)
