"""Word vectors without a bias direction.

The direction is the principal one of pairs of words that differ in the biased property alone (she and he, her and his):
the sum of outer products of each pair's half difference, taken row by row of the matrix in one aggregation, goes to the
driver (dimension squared doubles) and gives its first eigenvector.  Neutralising takes the direction out of every word
but those that are about the property; equalising sets the two words of a pair at the same distance from all neutral
words.  Both are column expressions: no vector leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest vectors whose matrix of products is made.
MOST_DIMENSIONS = 2048


def _doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def _direction(direction: Sequence[float]) -> Column:
    """The direction at length 1, as one literal."""
    import numpy as np

    g = np.asarray(direction, float)
    if not np.linalg.norm(g):
        raise ValueError("a direction of zeros")
    return F.lit(g / np.linalg.norm(g))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def plus(a: Column | str, b: Column | str, times: Column | None = None) -> Column:
    """a + b, or a + times * b."""
    return F.zip_with(a, b, lambda x, y: x + (y if times is None else y * times))


def scaled(a: Column | str, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def with_unit(df: DataFrame, vector: str) -> DataFrame:
    """df with the vector at length 1; a vector of zeros stays.  Step by step, so that no step is computed twice."""
    long = df.withColumn("__n", F.sqrt(dot(vector, vector)))
    return long.withColumn(vector, F.when(F.col("__n") > 0, scaled(vector, 1 / F.col("__n"))).otherwise(F.col(vector))).drop("__n")


def with_neutral(df: DataFrame, vector: str, direction: Sequence[float]) -> DataFrame:
    """df with the vector without its part along the direction, at length 1."""
    g = _direction(direction)
    part = df.withColumn("__part", dot(vector, g))
    return with_unit(part.withColumn(vector, plus(vector, g, -F.col("__part"))).drop("__part"), vector)


def paired(vectors: DataFrame, pairs: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """a, b, x, y: the unit vectors of the pairs (a, b) of which both words are known; one of each where a word is given twice."""
    one = with_unit(vectors.select(F.col(word).alias("__w"), _doubles(F.col(vector)).alias("__v")), "__v")
    known = one.groupBy("__w").agg(F.min("__v").alias("__v"))
    left = known.select(F.col("__w").alias("a"), F.col("__v").alias("x"))
    right = known.select(F.col("__w").alias("b"), F.col("__v").alias("y"))
    return pairs.select("a", "b").distinct().join(left, "a").join(right, "b").where("x is not null and y is not null")


def bias_direction(vectors: DataFrame, pairs: DataFrame, word: str = "word", vector: str = "vector") -> list[float]:
    """The unit vector along which the pairs (a, b) differ most, pointing from b to a."""
    import numpy as np

    met = paired(vectors, pairs, word, vector).select(F.zip_with("x", "y", lambda x, y: (x - y) / 2).alias("d"))
    size = met.agg(F.max(F.size("d"))).first()[0]
    if not size:
        raise ValueError("no pair has vectors for both words")
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    cells = met.select("d", F.posexplode("d").alias("i", "x")).select("i", "x", F.posexplode("d").alias("j", "y"))
    sums = cells.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("c"), F.sum("x").alias("to"))
    matrix, to = np.zeros((size, size)), np.zeros(size)
    for r in sums.collect():  # the matrix of products
        matrix[r["i"], r["j"]], to[r["i"]] = r["c"], r["to"]
    _, directions = np.linalg.eigh(matrix)
    first = directions[:, -1]
    return (first * (1.0 if first @ to >= 0 else -1.0)).tolist()


def debiased(vectors: DataFrame, direction: Sequence[float], specific: DataFrame | None = None, pairs: DataFrame | None = None, word: str = "word", vector: str = "vector") -> DataFrame:
    """vectors at length 1 without the direction.

    Words of ``specific`` (a column of the word's name) keep it; both words of each of ``pairs`` (a, b) are equalised
    whether they are specific or not.  A word in several pairs is equalised in the one that sorts first; a pair without
    both vectors isn't one.  Rows whose vector is null stay as they are.
    """
    g = _direction(direction)
    out = with_unit(vectors.withColumn(vector, _doubles(F.col(vector))), vector)
    if specific is None:
        out = with_neutral(out, vector, direction)
    else:
        kept = specific.select(F.col(word).alias("__kept")).distinct()
        both = with_neutral(out.withColumn("__plain", F.col(vector)), vector, direction).join(kept, F.col(word) == F.col("__kept"), "left")
        out = both.withColumn(vector, F.when(F.col("__kept").isNotNull(), F.col("__plain")).otherwise(F.col(vector))).drop("__kept", "__plain")
    if pairs is not None:
        met = paired(vectors, pairs, word, vector).withColumn("m", F.zip_with("x", "y", lambda x, y: (x + y) / 2))
        met = met.withColumn("along", dot("m", g)).withColumn("apart", dot("x", g) - dot("y", g))
        met = met.withColumn("flat", plus("m", g, -F.col("along")))
        met = met.withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 1 - dot("flat", "flat"))) * F.when(F.col("apart") < 0, -1.0).otherwise(1.0))
        sides = met.select(F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("z").alias("z")), F.struct(F.col("b").alias("w"), (-F.col("z")).alias("z")))).alias("s"), "flat", F.struct("a", "b").alias("at"))
        equal = sides.select(F.col("s.w").alias("__w"), plus("flat", g, F.col("s.z")).alias("__e"), "at").groupBy("__w").agg(F.min_by("__e", "at").alias("__e"))
        out = out.join(equal, F.col(word) == F.col("__w"), "left").withColumn(vector, F.coalesce("__e", vector)).drop("__w", "__e")
    return out.select(*vectors.columns)


def bias_along(vectors: DataFrame, direction: Sequence[float], word: str = "word", vector: str = "vector") -> DataFrame:
    """word, bias: the cosine of each word with the direction."""
    one = with_unit(vectors.select(word, _doubles(F.col(vector)).alias("__v")), "__v")
    return one.select(word, dot("__v", _direction(direction)).alias("bias"))


def subword_vectors(rows: DataFrame, pieces: str = "pieces", tokens: str = "tokens", vectors: str = "vectors", size: int | None = None) -> DataFrame:
    """rows with token_vectors: for each token the sum of the vectors of the pieces that overlap it.

    pieces and tokens are arrays of (start, end) character places, vectors one array for each piece; a piece that lies in two
    tokens counts for both, a token that no piece touches has a vector of zeros.  All of it happens inside the row, by one
    pass over its arrays.
    """
    if size is None:
        size = rows.agg(F.max(F.size(F.get(vectors, F.lit(0))))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0.0), size)
    zipped = F.zip_with(pieces, vectors, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), _doubles(v).alias("v")))

    def of(token: Column) -> Column:
        met = F.filter(zipped, lambda p: (p["start"] < token["end"]) & (p["end"] > token["start"]) & p["v"].isNotNull())
        return F.aggregate(met, zeros, lambda total, p: plus(total, p["v"]))

    return rows.withColumn("token_vectors", F.transform(tokens, of))


def aligned_pieces(tokens: Column, pieces: Column) -> tuple[Column, Column]:
    """(start, end) places of tokens and of sub-word pieces, both of which spell the same text: by running lengths.

    A piece that begins with the mark ## or ▁ continues or begins a word; marks don't count.
    """
    def spans(parts: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        return F.aggregate(
            parts, first,
            lambda done, p: F.struct((done["at"] + F.char_length(p)).alias("at"), F.array_append(done["spans"], F.struct(done["at"].alias("start"), (done["at"] + F.char_length(p)).alias("end"))).alias("spans")),
            lambda done: done["spans"],
        )

    return spans(tokens), spans(F.transform(pieces, lambda p: F.regexp_replace(p, "^(##|▁)", "")))
