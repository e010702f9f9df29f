"""Token ids in files of patched frame-of-reference blocks.

File: magic, header of 8 little-endian int64 (part, sequence number in the part,
ids before it in the part, documents, ids, blocks, bytes of the document table,
bytes of the block data), document table (doc ids, flags of null ids, lengths;
zlib), block index (start of each block in the data, uint64), block data.

Block of ``BLOCK`` ids: minimum (uint32), width (uint8), exceptions (uint16), the
differences to the minimum packed at the smallest width that holds
``PERCENTILE`` percent of them, then the exceptions' places (uint8) and their
bits beyond the width (uint32).  The index lets any block be read alone.

Defined results: null or empty texts are the end id alone; null ids come first and are
read back as null; equal ids follow each other by text, equal rows are written once
each; a text of any length is whole in one file; an empty table gives no files and no
rows.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.llm.common import arrow_schema, batches_out, partitions, shared_folder, small_batches, stored, text_batches
from paritas.llm.word_ids import encoder

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENTILE = 90
#: Ids of one file: what a worker holds at once (a longer document makes a longer file).
FILE_IDS = 1_000_000
_HEAD = struct.Struct("<8q")
_BLOCK_HEAD = 7


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks and their bytes."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), b""
    starts: list[np.ndarray] = []
    parts: list[bytes] = []
    base = 0
    for a in range(0, n, 1024):
        chunk = ids[a * BLOCK : (a + 1024) * BLOCK].astype(np.uint32)
        m = -(-len(chunk) // BLOCK)
        full = np.full(m * BLOCK, chunk[-1], np.uint32)
        full[: len(chunk)] = chunk
        full = full.reshape(m, BLOCK)
        low = full.min(axis=1)
        over = full - low[:, None]
        level = np.partition(over, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]
        width = np.ceil(np.log2(level.astype(np.float64) + 1)).astype(np.int64)
        excess = over >> width[:, None].astype(np.uint32)
        excess[width >= 32] = 0
        out = excess > 0
        counts = out.sum(axis=1)
        packed: list[bytes] = [b""] * m
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                bits = ((over[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
                data = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
                for r, d in zip(rows.tolist(), data):
                    packed[r] = d.tobytes()
        sizes = _BLOCK_HEAD + np.array([len(p) for p in packed]) + 5 * counts
        starts.append(base + np.concatenate(([0], np.cumsum(sizes)[:-1])))
        base += int(sizes.sum())
        at_rows, at = np.nonzero(out)
        values = excess[at_rows, at]
        edges = np.concatenate(([0], np.cumsum(counts)))
        for r in range(m):
            x = slice(edges[r], edges[r + 1])
            parts.append(struct.pack("<IBH", int(low[r]), int(width[r]), int(counts[r])) + packed[r] + at[x].astype(np.uint8).tobytes() + values[x].astype("<u4").tobytes())
    return np.concatenate(starts).astype(np.uint64), b"".join(parts)


def decode_blocks(data: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of all blocks, blocks of one width together."""
    raw = np.frombuffer(data, np.uint8)
    m = len(starts)
    if not m:
        return np.zeros(0, np.uint32)
    at = starts.astype(np.int64)
    low = raw[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width = raw[at + 4].astype(np.int64)
    counts = raw[at[:, None] + np.arange(5, 7)].copy().view("<u2").ravel().astype(np.int64)
    out = np.zeros((m, BLOCK), np.uint32)
    padded = data + bytes(8)
    words = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes at each place
    for w in np.unique(width[width > 0]).tolist():
        bits = np.arange(BLOCK, dtype=np.int64) * w
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 512)):
            got = words[at[part][:, None] + (_BLOCK_HEAD + (bits >> 3))] >> (bits & 7).astype(np.uint64)
            out[part] = got & np.uint64((1 << w) - 1)
    if counts.any():
        rows = np.repeat(np.arange(m), counts)
        k = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = at + _BLOCK_HEAD + BLOCK * width // 8
        where = raw[places[rows] + k]
        values = raw[(places[rows] + counts[rows] + 4 * k)[:, None] + np.arange(4)].copy().view("<u4").ravel()
        out[rows, where] |= values << width[rows].astype(np.uint32)
    return (out + low[:, None]).ravel()[:n_ids]


def to_file(part: int, seq: int, before: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    known = np.array([x is not None for x in doc_ids], np.uint8)
    docs = zlib.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<i8").tobytes(), 1)
    starts, data = encode_blocks(ids)
    return MAGIC + _HEAD.pack(part, seq, before, len(doc_ids), len(ids), len(starts), len(docs), len(data)) + docs + starts.astype("<u8").tobytes() + data


def from_file(blob: bytes) -> tuple[int, int, int, list[int | None], np.ndarray, np.ndarray]:
    """part, sequence number, ids before it in its part, doc ids, lengths, ids."""
    if blob[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    part, seq, before, n_docs, n_ids, n_blocks, n_table, n_data = _HEAD.unpack_from(blob, 8)
    at = 8 + _HEAD.size
    table = zlib.decompress(blob[at : at + n_table])
    ids = np.frombuffer(table, "<i8", n_docs).tolist()
    known = np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
    lengths = np.frombuffer(table, "<i8", n_docs, 9 * n_docs)
    at += n_table
    starts = np.frombuffer(blob, "<u8", n_blocks, at)
    at += 8 * n_blocks
    return part, seq, before, [x if k else None for x, k in zip(ids, known)], lengths, decode_blocks(blob[at : at + n_data], starts, n_ids)


def put_file(folder: str, name: str, blob: bytes) -> None:
    """Write under another name, then rename: a task that is run again leaves the same file."""
    import uuid

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    aside = f"{path}/_{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as f:
        f.write(blob)
    store.move(aside, f"{path}/{name}")


def get_file(uri: str) -> bytes:
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


WRITTEN = "part int, seq int, n_docs long, n_ids long, n_bytes long"
READ = "doc_id long, part int, local_start long, n_tokens long, ids binary"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs' ids, each document closed by end_id, in ascending id order.

    One range of ids per task, each sorted by (id, text) and cut into files of about
    FILE_IDS ids; files are named by part and number, which is their order.  Null
    ids come first, null texts are empty, equal ids follow each other by text.
    Returns what was written, a row a file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = arrow_schema(WRITTEN)
    parts = partitions(docs)
    ranged = docs.select(docs[id_col].cast("long").alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("__text")).repartitionByRange(parts, "__id").sortWithinPartitions("__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seq = before = held = 0
        doc_ids: list[int | None] = []
        blobs: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held, doc_ids, blobs
            blob = to_file(part, seq, before, doc_ids, [len(b) // 4 for b in blobs], np.frombuffer(b"".join(blobs), "<u4"))
            put_file(folder, f"part-{part:06d}-{seq:06d}.pfor", blob)
            row = batches_out({"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [held], "n_bytes": [len(blob)]}, schema)
            seq, before, held, doc_ids, blobs = seq + 1, before + held, 0, [], []
            return row

        for batch in batches:
            for rows, texts in text_batches(batch, "__text"):
                for doc_id, ids in zip(rows.column("__id").to_pylist(), words.encode(texts)):
                    if blobs and held + len(ids) // 4 >= FILE_IDS:
                        yield flush()
                    doc_ids.append(doc_id)
                    blobs.append(ids + end)
                    held += len(ids) // 4 + 1
        if blobs:
            yield flush()

    return stored(ranged.mapInArrow(run, WRITTEN))


def _read(spark: SparkSession, folder: str, ddl: str, rows) -> DataFrame:
    """What rows(part, ids before, doc ids, lengths, ids) gives for each file.

    Spark lists the files and deals them to tasks by size; a task opens one after
    another, so contents don't pass through the executor's JVM.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                part, _, before, doc_ids, lengths, ids = from_file(get_file(path))
                for columns in rows(part, before, doc_ids, lengths, memoryview(ids.astype("<u4")).cast("B")):
                    yield batches_out(dict(zip(schema.names, columns)), schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path").mapInArrow(run, ddl)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of the files: id, part, ids before it in its part, number of ids, ids."""

    def rows(part, before, doc_ids, lengths, raw):
        edges = np.concatenate(([0], np.cumsum(lengths)))
        for a in range(0, len(doc_ids), 2000):
            b = min(a + 2000, len(doc_ids))
            cut = [bytes(raw[4 * x : 4 * y]) for x, y in zip(edges[a:b].tolist(), edges[a + 1 : b + 1].tolist())]
            yield doc_ids[a:b], [part] * (b - a), before + edges[a:b], lengths[a:b], cut

    return _read(spark, folder, READ, rows)


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, **columns) -> DataFrame:
    """Write, read back, and digest each document: start counts the ids of all documents before it.

    The starts of the parts are prefix sums of one total per part, on the driver;
    starts within a part are in the files.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ids"
    written = write_token_files(docs, folder, tokenizer, end_id, **columns)
    totals = written.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, total = {}, 0
    for row in sorted(totals):
        base[row["part"]] = total
        total += row["n"]
    if not totals:
        return spark.createDataFrame([], DIGEST)

    def rows(part, before, doc_ids, lengths, raw):
        edges = np.concatenate(([0], np.cumsum(lengths)))
        crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
        yield doc_ids, base[part] + before + edges[:-1], lengths, crcs

    return _read(spark, folder, DIGEST, rows)
