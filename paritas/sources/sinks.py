"""Writers of score tables, annotations and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions import text as T


#: Rows of a nested summary at most.
MOST_ROWS = 100_000


def write_scores(scores: DataFrame, path: str, score: str = "log_score", ties: Sequence[str] = ()) -> None:
    """CSV in ascending order of the score, equal scores in that of the columns ties."""
    flat = scores.select(*[F.concat_ws("|", c).alias(c) if t.startswith("array") else F.col(c) for c, t in scores.dtypes])
    flat.orderBy(score, *ties).write.mode("overwrite").csv(path, header=True)


def write_sibling(df: DataFrame, path: str, suffix: str) -> str:
    """CSV beside a table, with a suffix before the name's extension."""
    stem, dot, ending = path.rpartition(".")
    to = f"{stem}.{suffix}.{ending}" if dot else f"{path}.{suffix}"
    df.write.mode("overwrite").csv(to, header=True)
    return to


def write_annotations(df: DataFrame, path: str, groups: Sequence[str]) -> None:
    df.withColumns({c: T.join_groups(F.col(c)) for c in groups}).write.mode("overwrite").csv(path, header=True)


def write_indicators(df: DataFrame, path: str, groups: str, values: Sequence[str], prefix: str) -> None:
    """Semicolon CSV with a 0/1 column per group value."""
    df.withColumns({f"{prefix}_{v}": F.array_contains(groups, v).cast("int") for v in values}).drop(groups).write.mode("overwrite").csv(path, sep=";", header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def in_order(key: str):
    return lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)


def nested_summary(df: DataFrame, keys: Sequence[str] = ("model", "language", "theme", "subtheme")) -> DataFrame:
    """One row, one column json: keys nested in their order around the other columns.

    A report that people read: more than MOST_ROWS rows are refused.
    """
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"a nested summary is one value; it takes {MOST_ROWS} rows at most")
    values = [c for c in df.columns if c not in keys]
    out = df.select(*keys, F.struct(*values).alias("v"))
    for i in range(len(keys) - 1, -1, -1):
        pair = F.map_from_entries(F.array_sort(F.collect_list(F.struct(keys[i], "v")), in_order(keys[i]))).alias("v")
        out = out.groupBy(*keys[:i]).agg(pair)
    return out.select(F.to_json("v").alias("json"))


def score_key(mode: str, groups: Sequence[str]) -> str:
    """The key of a score in a stored summary."""
    return f"## {mode} [{' then '.join(groups)}]"


def keyed_summary(summary: DataFrame, groups: Sequence[str], mode: str = "mode") -> DataFrame:
    """One row, one column json: mean and deviation of each mode under its key, from a row a mode."""
    key = F.concat(F.lit("## "), F.col(mode), F.lit(f" [{' then '.join(groups)}]"))
    pairs = F.sort_array(F.collect_list(F.struct(key.alias("key"), F.struct(*[c for c in summary.columns if c != mode]).alias("value"))))
    return summary.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def append_log(rows: DataFrame, path: str, fitness: str = "fitness", under: float | None = None) -> None:
    """Solutions of a search as text lines, added to those that are there; under: only those whose components after the first stay at or under it."""
    from paritas.operators.reports import fitness_under

    kept = rows if under is None else rows.where(fitness_under(F.col(fitness), under))
    kept.select(F.to_json(F.struct(*kept.columns)).alias("value")).write.mode("append").text(path)


def folder(spark, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); in local mode a temporary one.

    What is written there is deleted when the driver's JVM ends.
    """
    import tempfile
    import uuid

    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    own = f"{base.rstrip('/')}/paritas-{sc.applicationId}-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(own)
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{own}/{name}"
