"""From raw documents to packed token windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.

In every stage null texts count as empty, texts of any length are taken whole, an empty
table gives an empty table, and further columns are carried, whatever their names.
Repeated rows and ties are as the stages say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.llm.common import release, scratch, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; null texts and texts without a letter go.  Equal rows stay or go together."""
    from paritas.llm.language_id import with_language

    return with_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by three documents or more stay in the largest id only; n_chars follows the text.  Rows of one id count as one document, rows without an id as none."""
    from paritas.llm.line_dedup import without_repeated_lines

    return _counted(without_repeated_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more) stays, the one with the smallest id.

    Candidates come from operator 9's byte-position index over SimHash fingerprints, and from bands of MinHash values beyond its reach.
    Each row is judged by its own text; repeated rows of that id stay together, and rows without an id stay if nothing with an id is in their component.
    """
    from paritas.llm.simhash import one_of_each_group

    return one_of_each_group(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that start earlier in the corpus go; a character that is cut through goes whole.  Equal (id, text) rows are one document."""
    from paritas.llm.suffix_dedup import text_without_repeats

    return _counted(text_without_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids; repeated rows are packed once each."""
    import public_tokenizers

    from paritas.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]

#: SQL can't express string kernels, shingle fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as kept:  # what a stage stored on its way goes with its end
            docs = stored(stage(spark, before, sf_dir))
            kept.append(docs)
        if hasattr(before, "_stored_at"):
            release(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
