"""Concatenate and cut: documents to fixed token windows.

First pass: each task tokenises its documents, closes each with an end id and
writes (part, ids before it in the part, ids) to a table in the shared folder.
Second pass: one total per part goes to the driver, whose prefix sums give each
part's global offset; every task then cuts its own documents at the multiples of
the window.  No row is shuffled.  A document that crosses a boundary gives a
piece for each window; the last window alone may be short.

Defined results: null or empty texts are the end id alone; equal rows are packed
once each; null ids are carried; a text of any length is tokenised whole and gives as
many pieces as it needs; an empty table gives no rows.  The order of documents is that
of the input's partitions, which ties and repeated ids don't change.  Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import arrow_schema, batches_out, small_batches, stored, text_batches
from paritas.llm.word_ids import encoder

WINDOW, END_ID = 2048, 1
TOKENISED = "part int, local_start long, doc_id long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, as a stored table."""
    small_batches(docs.sparkSession)
    schema = arrow_schema(TOKENISED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in text_batches(batch, "__text"):
                ids = [x + end for x in words.encode(texts)]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield batches_out({"part": [part] * len(ids), "local_start": starts, "doc_id": rows.column("__id"), "n_tokens": counts, "ids": ids}, schema)

    return stored(docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text")).mapInArrow(run, TOKENISED))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece; sequence_id and offset place it, ids (if asked for) are its own."""
    table = tokenised(docs, tokenizer, end_id, id_col, text_col)
    base, total = {}, 0
    for row in sorted(table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[row["part"]] = total
        total += row["n"]
    ddl = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            for part, local, doc_id, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "doc_id", "n_tokens", "ids"))):
                at = base[part] + local
                done = 0
                while done < n:
                    length = min(n - done, window - (at + done) % window)
                    piece = ids[4 * done : 4 * (done + length)]
                    row = (doc_id, done, length, zlib.crc32(piece), n, (at + done) // window, (at + done) % window, piece)
                    for name, value in zip(schema.names, row):
                        out[name].append(value)
                    done += length
            yield batches_out(out, schema)

    return table.mapInArrow(run, ddl)
