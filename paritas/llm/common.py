"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words and that are stripped from lines.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch that reach a Python worker at once.
BATCH_ROWS = 1000


#: Option of a Parquet reader: columns are read one after another.  Vectored reads hand column chunks to a pool of threads
#: with buffers outside the heap, the suspected cause of executors that outgrew their memory.
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}

#: Bytes of input for each partition of a shuffle whose number of partitions is set by hand.
PART_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**PLAIN_READS).parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """For a shuffle of about the bytes of df: the session's number of partitions, or more where the input is large."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, 1, -(-size // PART_BYTES) if size < 1 << 50 else 0)  # Spark's word for an unknown size is a larger one


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of this session's Arrow batches: texts may be very long, and plans that run later read the setting too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the jobs that run inside: for rows of known, small size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_root(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, with its file system named.

    It is deleted when the driver's JVM ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paritas-")
        sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    named = store.makeQualified(path).toString()
    if named.startswith("file:/") and not named.startswith("file://"):
        named = "file://" + named.removeprefix("file:")
    root = f"{named.rstrip('/')}/paritas-{sc.applicationId}"
    if root not in _roots:
        own = sc._jvm.org.apache.hadoop.fs.Path(root)
        store.mkdirs(own)
        store.deleteOnExit(own)
        _roots.add(root)
    return root


_roots: set[str] = set()
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path below it."""
    _made.append(f"{shared_root(spark)}/{uuid.uuid4().hex}")
    return _made[-1]


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """On leaving, delete what was stored inside, but for the tables added to the list that is given."""
    at, kept = len(_made), []
    yield kept
    for path in _made[at:]:
        if path not in {t._stored_at for t in kept}:
            _delete(spark, path)
    _made[at:] = [t._stored_at for t in kept]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it.

    The shuffle files of the write go when it is done.
    """
    path, conf, key = shared_folder(df.sparkSession), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.set(key, before)
    out = df.sparkSession.read.options(**PLAIN_READS).schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that are no longer read."""
    for t in tables:
        _delete(spark, t._stored_at)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a simple 'name type, ...' list."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def batches_out(rows: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def text_batches(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with their texts (null: empty), each of about most_bytes at most or one row."""
    import numpy as np

    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    cuts = [0]
    total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most_bytes:
            cuts.append(i)
            total = 0
        total += n
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part, [x or "" for x in part.column(column).to_pylist()]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does that alone where every character is one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def wide_hash(c: Column) -> tuple[Column, Column]:
    """128 bits of a string as two longs: XXH64 under two seeds."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)
