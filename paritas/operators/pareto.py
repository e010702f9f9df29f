"""Pareto fronts of a table of objectives.

A point's front is one more than the last front of the points that dominate it.  Points are reduced to distinct ones and
dealt, in descending lexicographic order, to blocks of bounded size, so that only points of the same or earlier blocks can
dominate one.  Block after block, all tasks look through the earlier, already ranked points for the highest front that
dominates each point of the block (a block's points are broadcast), then one task ranks the block's own points from
there.  So no task holds more than a block, and a table that fits in one block is ranked at once.

For the first front alone, each partition first drops the points that its own dominate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dominates(a: str, b: str, objectives: Sequence[str], maximize: Sequence[bool]) -> Column:
    """Row a is no worse than b in any objective and better in one."""
    no_worse, better = F.lit(True), F.lit(False)
    for name, up in zip(objectives, maximize):
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        no_worse, better = no_worse & (x >= y if up else x <= y), better | (x > y if up else x < y)
    return no_worse & better


def best_points(points: np.ndarray) -> np.ndarray:
    """The distinct rows that no row dominates (all objectives maximised), in descending lexicographic order."""
    points = np.unique(points, axis=0)[::-1]
    if points.shape[1] == 2:
        before = np.concatenate(([-np.inf], np.maximum.accumulate(points[:, 1])[:-1]))
        return points[points[:, 1] > before]
    kept = points[:0]
    for p in points:  # only rows before it can dominate a row
        if not (kept >= p).all(axis=1).any():
            kept = np.vstack((kept, p))
    return kept


def chained(points: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The front of each point, in descending lexicographic order without repeats; base is the least that earlier blocks leave it."""
    rank = base.copy()
    rest = points[:, 1:]
    if points.shape[1] <= 2:  # highest[r]: the greatest second objective of a point in front r or later
        highest = np.full(int(base.max(initial=0)) + len(points) + 2, -np.inf)
        top = 0
        for i, y in enumerate(rest[:, 0] if points.shape[1] == 2 else np.zeros(len(points))):
            # fronts up to top - 1 that hold a point no worse: highest falls, so they come first
            over = int(np.searchsorted(-highest[:top], -y, side="right"))
            rank[i] = max(rank[i], over)
            np.maximum(highest[: rank[i] + 1], y, out=highest[: rank[i] + 1])
            top = max(top, int(rank[i]) + 1)
        return rank
    for i in range(1, len(points)):
        over = (rest[:i] >= rest[i]).all(axis=1)
        if over.any():
            rank[i] = max(rank[i], int(rank[:i][over].max()) + 1)
    return rank


def least_fronts(points: np.ndarray, ranked: np.ndarray, fronts: np.ndarray) -> np.ndarray:
    """For each point one more than the last front of ranked points, all lexicographically before it, that dominate it; else 0."""
    out = np.zeros(len(points), np.int64)
    order = np.argsort(-fronts, kind="stable")
    ranked, fronts = ranked[order], fronts[order]
    for a in range(0, len(ranked), 256):
        some = ranked[a : a + 256]
        open_ = np.flatnonzero(out == 0)  # fronts fall, so the first that dominates is the last front
        if not len(open_):
            break
        over = (some[None, :, 1:] >= points[open_, None, 1:]).all(axis=2)
        hit = over.any(axis=1)
        out[open_[hit]] = fronts[a + over[hit].argmax(axis=1)] + 1
    return out


def _points(df: DataFrame, objectives: Sequence[str], maximize: Sequence[bool]) -> DataFrame:
    """Objectives as doubles to maximise, in columns x0, x1, ..., without rows that lack one."""
    cols = [(F.col(o) if up else -F.col(o)).cast("double").alias(f"x{i}") for i, (o, up) in enumerate(zip(objectives, maximize))]
    return df.select(*cols).dropna()


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]) if batch.num_rows else np.zeros((0, n))


def _met(df: DataFrame, found: DataFrame, objectives: Sequence[str], maximize: Sequence[bool]) -> DataFrame:
    condition = F.lit(True)
    for i, (o, up) in enumerate(zip(objectives, maximize)):
        condition = condition & ((F.col(o) if up else -F.col(o)).cast("double") == F.col(f"__x{i}"))
    n = len(objectives)
    return df.join(found.withColumnsRenamed({f"x{i}": f"__x{i}" for i in range(n)}), condition).drop(*[f"__x{i}" for i in range(n)])


#: Points of a block, with two objectives and with more.
BLOCK_OF_TWO, BLOCK = 1 << 18, 1 << 14


def _ranked(points: DataFrame, n: int, first_only: bool = False) -> DataFrame:
    """x0, ..., front of distinct points."""
    from paritas.sources import sinks

    spark, names = points.sparkSession, [f"x{i}" for i in range(n)]
    ddl = ", ".join([*(f"{c} double" for c in names), "front int"])
    base = sinks.folder(spark, "points")
    points.write.parquet(f"{base}/distinct")
    held = spark.read.schema(points.schema).parquet(f"{base}/distinct")
    blocks = max(1, -(-held.count() // (BLOCK_OF_TWO if n <= 2 else BLOCK)))
    down = [F.desc(c) for c in names]

    def solve(rows: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = chained(rows, least)
        kept = at == 0 if first_only else at >= 0
        yield pa.RecordBatch.from_arrays([*[pa.array(rows[kept, i]) for i in range(n)], pa.array(at[kept], pa.int32())], names=[*names, "front"])

    if blocks == 1:
        def whole(key: tuple, group: pa.Table) -> pa.Table:
            rows = np.column_stack([group.column(c).to_numpy() for c in names])
            rows = rows[np.lexsort([-rows[:, i] for i in range(n - 1, -1, -1)])]
            return pa.Table.from_batches(list(solve(rows, np.zeros(len(rows), np.int64))))

        return held.withColumn("block", F.lit(0)).groupBy("block").applyInArrow(whole, ddl)
    held.repartitionByRange(blocks, *down).withColumn("block", F.spark_partition_id()).write.parquet(f"{base}/dealt")  # stored, as ranges are sampled
    dealt = spark.read.schema(", ".join([*(f"{c} double" for c in names), "block int"])).parquet(f"{base}/dealt")
    solved = None
    for block in sorted(r[0] for r in dealt.select("block").distinct().collect()):
        rows = dealt.where(F.col("block") == block).orderBy(*down).select(*names).toArrow()  # a block
        own = np.column_stack([rows.column(c).to_numpy() for c in names])
        least = np.zeros(len(own), np.int64)
        sent = spark.sparkContext.broadcast(own)
        if solved is not None:
            def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                out = np.zeros(len(sent.value), np.int64)
                for batch in batches:
                    if batch.num_rows:
                        out = np.maximum(out, least_fronts(sent.value, _matrix(batch, n), batch.column(n).to_numpy()))
                hit = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(out[hit])], names=["i", "front"])

            for r in solved.mapInArrow(look, "i long, front long").groupBy("i").agg(F.max("front").alias("front")).collect():  # a row for each point of the block
                least[r["i"]] = r["front"]
        sent_least = spark.sparkContext.broadcast(least)
        one = spark.range(1, numPartitions=1)
        made = one.mapInArrow(lambda batches, sent=sent, sent_least=sent_least: (x for batch in batches if batch.num_rows for x in solve(sent.value, sent_least.value)), ddl)
        made.write.mode("append").parquet(f"{base}/ranked")
        solved = spark.read.schema(ddl).parquet(f"{base}/ranked")
    return solved


def front(df: DataFrame, objectives: Sequence[str], maximize: Sequence[bool]) -> DataFrame:
    """The rows that no row dominates; equal rows stay together, rows with a null objective aren't ranked."""
    n = len(objectives)
    ddl = ", ".join(f"x{i} double" for i in range(n))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, n))
        for batch in batches:
            kept = best_points(np.vstack((kept, _matrix(batch, n))))
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(n)], names=[f"x{i}" for i in range(n)])

    local = _points(df, objectives, maximize).mapInArrow(reduce, ddl).distinct()
    return _met(df, _ranked(local, n, True).drop("front"), objectives, maximize)


def fronts(df: DataFrame, objectives: Sequence[str], maximize: Sequence[bool], most: int | None = None) -> DataFrame:
    """df with front (from 0), every front by default.

    Rows with a null objective can't be ranked and have a null front; equal rows share
    theirs.  `most` is an explicit limit of a report: rows beyond so many fronts are left
    out.  The work grows with the square of the distinct points, a table of configurations.
    """
    found = _ranked(_points(df, objectives, maximize).distinct(), len(objectives))
    null = F.lit(False)
    for name in objectives:
        null = null | F.col(name).isNull()
    ranked = _met(df.where(~null), found if most is None else found.where(F.col("front") < most), objectives, maximize)
    return ranked.select(*df.columns, "front").unionByName(df.where(null).withColumn("front", F.lit(None).cast("int")))
