"""Language identification by string kernels.

The kernel of two texts counts the hashed byte n-grams (one to four bytes, lower
case) that both hold, by presence, not frequency: a blended-spectrum presence
kernel, normalised by the numbers of n-grams held.  Training picks a bounded
sample of labelled documents (``PER_LANGUAGE`` of each language, by the order of a
hash of the id), sends their n-gram presences as bits (2 KB each) to the driver, takes ``LANDMARKS`` of them as Nystroem landmarks, maps every
sample text to  K(x, landmarks) K(landmarks, landmarks)^-1/2  and solves
one-versus-rest ridge regressions there.

A prediction is that of the same map.  Since K(x, landmarks) is a matrix product
of presence vectors, the landmark matrix, the inverse root and the regression
weights are multiplied once on the driver; executors score a batch of texts with
one matrix product of presences and that (n-gram buckets x languages) matrix and
divide by the text's norm.  Its size is fixed by the parameters and the number of
languages; more than ``MOST_LANGUAGES`` raise ValueError rather than be dropped.

Learned from: text and language of labelled documents whose crc32 of the id isn't
held out.  Defined results: null text or text without a letter is ``und`` with
score 0; so is everything if no labelled document can be learned from; texts of any
length are read whole; a null id is neither held out nor learned from; of several
texts of one id and language the one with the least bits is learned from, so two
runs learn the same; equal margins go to the language that sorts first; equal rows
get equal results; an empty table gives no rows; other columns aren't read (by
:func:`with_language` carried), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm.common import arrow_schema, batches_out, small_batches, stored, text_batches

UNDETERMINED = "und"
GRAMS, BUCKET_BITS = (1, 2, 3, 4), 14
#: Bounds of the training sample: documents of a language, of all together, landmarks.  Each language has one of both at least.
PER_LANGUAGE, SAMPLE, LANDMARKS = 200, 12_800, 240
#: Languages that a model tells apart: the weights take 64 KB for each, on the driver and in each worker.
MOST_LANGUAGES = 1000
#: Candidates for a place in the sample, for each place.
SPARE = 4
RIDGE = 1e-3
#: How far under its border the best margin of a text lies that no language takes (all margins lie at about -1 then).
REJECTED = 0.5
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_MULT = np.uint32(0x9E3779B1)


def presence(text: str) -> np.ndarray:
    """Which n-gram buckets a text holds."""
    held = np.zeros(1 << BUCKET_BITS, bool)
    code = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    gram = code
    for n in GRAMS:
        if n > 1:
            gram = (gram[:-1] << np.uint32(8)) | code[n - 1 :]
        if not len(gram):
            break
        held[((gram + np.uint32(n)) * _MULT) >> np.uint32(32 - BUCKET_BITS)] = True
    return held


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets, languages), float32
    bias: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for at in range(0, len(texts), 128):
            rows = [i for i in range(at, min(at + 128, len(texts))) if has_letter(texts[i])]
            if rows:
                held = np.stack([presence(texts[i]) for i in rows]).astype(np.float32)
                margins = held @ self.weights / np.sqrt(held.sum(axis=1))[:, None] + self.bias
                best = margins.argmax(axis=1)
                for k, i in enumerate(rows):
                    names[i] = self.languages[best[k]]
                    scores[i] = float(min(1.0, max(0.0, (margins[k, best[k]] + 1) / 2)))
        return names, scores


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of some texts."""
    usable = [i for i, t in enumerate(texts) if has_letter(t)]
    held = np.stack([presence(texts[i]) for i in usable]) if usable else np.zeros((0, 1 << BUCKET_BITS), bool)
    return fit_presences(held, [labels[i] for i in usable], landmarks, ridge)


def fit_presences(presences: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystroem features and one-versus-rest kernel ridge regression, on the driver, over the sample."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32))
    held = presences.astype(np.float32)
    unit = held / np.sqrt(held.sum(axis=1))[:, None]
    by_language = {name: [k for k, label in enumerate(labels) if label == name] for name in languages}
    each = max(1, landmarks // len(languages))
    marks = unit[[k for name in languages for k in by_language[name][:each]]]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = (unit @ marks.T).astype(np.float64) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    weight = np.array([1.0 / len(by_language[label]) for label in labels])  # each language counts alike
    weight /= weight.sum()
    mean = weight @ mapped
    centre = weight @ target
    x, y = mapped - mean, target - centre
    beta = np.linalg.solve(x.T @ (x * weight[:, None]) + ridge * np.eye(x.shape[1]) / len(labels), x.T @ (y * weight[:, None]))
    return Model(languages, (marks.T @ (root @ beta)).astype(np.float32), (centre - mean @ beta).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[np.ndarray, list[str]]:
    """Presences and labels of the bounded training sample.  Ids and labels are ranked first; texts are read for the chosen only."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    narrow = labelled.select(F.col(id_col).cast("long").alias("__id"), F.col(lang_col).cast("string").alias("__lang"))
    ids = stored(narrow.groupBy("__lang").agg(F.approx_count_distinct("__id").alias("__ids")))  # its size is then known: broadcast if small, so that narrow isn't dealt by language
    if (n := ids.count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages are labelled, {MOST_LANGUAGES} can be learned: give a table without stray labels, or a model")
    each = min(PER_LANGUAGE, max(1, SAMPLE // max(1, n)))
    # of a language's ids those with a small hash, about SPARE times as many as are wanted, so that the ranking is over few rows
    at = F.pmod(F.xxhash64("__id"), F.lit(1 << 40))
    few = narrow.join(ids, "__lang").where(at.cast("double") * F.col("__ids") < F.lit(float(SPARE * each)) * F.lit(float(1 << 40))).select("__id", "__lang").distinct()
    by_hash = Window.partitionBy("__lang").orderBy(at, "__id")
    chosen = [r["__id"] for r in few.withColumn("__n", F.row_number().over(by_hash)).where(F.col("__n") <= each).select("__id").distinct().collect()]
    ddl = "__id long, __lang string, bits binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch, "__text"):
                bits = [np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in texts]
                yield batches_out({"__id": rows.column("__id"), "__lang": rows.column("__lang"), "bits": bits}, schema)

    texts = labelled.where(F.col(id_col).cast("long").isin(chosen)).select(F.col(id_col).cast("long").alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    best = texts.mapInArrow(run, ddl).where(F.col("bits").isNotNull()).groupBy("__id", "__lang").agg(F.min("bits").alias("bits"))
    rows = sorted((r["__lang"], r["__id"], bytes(r["bits"])) for r in best.collect())
    held = np.frombuffer(b"".join(b for _, _, b in rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, 1 << (BUCKET_BITS - 3)), np.uint8)
    return np.unpackbits(held, axis=1).astype(bool), [lang for lang, _, _ in rows]


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or fit_presences(*sample(docs, id_col, text_col, lang_col)))
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch, "__text"):
                names, scores = shared.value.predict(texts)
                yield batches_out({"doc_id": rows.column("__id"), "held_out": rows.column("__held"), "lang_pred": names, "score": scores}, schema)

    return docs.select(docs[id_col].cast("long").alias("__id"), held_out(docs[id_col]).alias("__held"), docs[text_col].alias("__text")).mapInArrow(run, SCHEMA)


def with_language(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs' rows that have a language; a row whose language is null gets the predicted one, a given one stays.

    Texts that are null or have no letter go, and so do those that every one of the model's one-versus-rest regressions
    rejects by REJECTED or more (a score under (1 - REJECTED) / 2).  Where no language could be learned, rows with a letter
    stay as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or fit_presences(*sample(docs, id_col, text_col, lang_col)))
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, at = f"c{docs.columns.index(text_col)}", docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch, text):
                if shared.value.languages:
                    names, scores = shared.value.predict(texts)
                    keep = [n != UNDETERMINED and s >= (1 - REJECTED) / 2 for n, s in zip(names, scores)]
                    field = rows.schema.field(at)
                    rows = rows.set_column(at, field, pa.compute.coalesce(rows.column(at), pa.array(names, pa.string()).cast(field.type)))
                else:
                    keep = [has_letter(t) for t in texts]
                yield rows.filter(pa.array(keep, pa.bool_()))

    return named.mapInArrow(run, named.schema).toDF(*docs.columns)
