"""Line deduplication over a corpus, in DataFrame operations only.

Every text is split at newlines.  A line's key is the line stripped of ASCII
white space with A-Z lower-cased; keys of ``min_chars`` code points or more that
are found in ``min_docs`` documents or more lose all their lines except in the
largest document id that holds them.

Plan: explode the lines once into a stored table of (doc, position, key hash) ->
distinct (doc, hash) before the shuffle -> count per key -> a stored table of the
few frequent keys -> join back to the stored hashes -> positions to drop per
document -> one join with the texts -> reassemble by position.  A key held by a
third of all documents is first dealt by (key, doc), counted in part, and only
partial counts meet; the join back is one that AQE splits.

Defined results: a null or empty text is one empty line; texts of any length are
split whole; an empty table gives no rows.  Rows with a null id aren't counted as
documents and never are the largest holder, so they lose frequent lines.  Rows of
the same id are one document for counting; each row is reassembled by itself, so
repeated rows get equal results.  Other columns are carried in a struct, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import ASCII_SPACE, ascii_lower, stored, wide_hash


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Columns: row (struct of docs' columns), n_lines, n_dropped, kept_text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    lines = base.select("__id", F.xxhash64("__text").alias("__of"), F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
    keyed = lines.select("__id", "__of", "__pos", line_key(F.col("__line")).alias("__key")).where(F.char_length("__key") >= min_chars)
    h1, h2 = wide_hash(F.col("__key"))
    keyed = stored(keyed.select("__id", "__of", "__pos", h1.alias("__h1"), h2.alias("__h2")))

    frequent = keyed.where(F.col("__id").isNotNull()).select("__h1", "__h2", "__id").distinct().groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__keep")).where(F.col("__n") >= min_docs).drop("__n")
    frequent = stored(frequent)  # its size is then known: joined by broadcast if small, else dealt anew, so that AQE can split a hot key
    drops = keyed.join(frequent, ["__h1", "__h2"]).where(~F.col("__id").eqNullSafe(F.col("__keep"))).groupBy(F.col("__id").alias("__did"), F.col("__of").alias("__dof")).agg(F.collect_set("__pos").alias("__drop"))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("__id"), text.alias("__text"))
    met = rows.join(drops, F.col("__id").eqNullSafe(F.col("__did")) & (F.xxhash64("__text") == F.col("__dof")), "left")
    split = F.split("__text", "\n", -1)
    n_lines = F.size(split)
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__drop"))
    rebuilt = F.array_join(F.transform(kept, lambda p: F.get(F.col("__lines"), p)), "\n")
    return (
        met.withColumn("__lines", F.when(F.col("__drop").isNotNull(), split))
        .select(
            "row",
            n_lines.cast("long").alias("n_lines"),
            F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(rebuilt).alias("kept_text"),
        )
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with its own columns; the text is what dedup_lines keeps."""
    out = dedup_lines(docs, id_col, text_col, **how)
    return out.select(*[(F.col("kept_text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
