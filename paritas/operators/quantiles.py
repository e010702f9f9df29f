"""Exact quantiles of groups of any size, by selection in counted slices.

A group's wanted ranks start with its range of values.  Each round cuts what is left of every range into SLICES, counts the
values in each (sums by group and slice, so a group of any size is spread over all tasks) and keeps the slice that holds the
rank.  A range of equal values is done; one of at most FEW values is read, sorted and done.  No task gathers a group.
Slices are of equal width in one round and of equal ratio in the next, so that few rounds do for values of very different
sizes as well.  What is open after a round is a small table in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.sources import sinks

SLICES, FEW = 1024, 1024


def _along(x: Column, by_ratio: bool) -> Column:
    """A number that rises with x, of at most half of its size."""
    return F.signum(x) * F.log1p(F.abs(x)) / 2 if by_ratio else x / 2


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """keys, n, low, high and quantiles (an array in the order of shares) of the finite values of each group.

    Quantiles are interpolated between the two nearest values, as percentile() does.  Groups without a finite value have no
    row; null keys are a group.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie between 0 and 1")
    spark, x = df.sparkSession, F.col(value).cast("double")
    names, base = [f"__k{i}" for i in range(len(keys))], sinks.folder(df.sparkSession, "ranks")
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], x.alias("__x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    met = rows.withColumnsRenamed({n: f"__r{i}" for i, n in enumerate(names)})

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{base}/{name}")
        return spark.read.schema(table.schema).parquet(f"{base}/{name}")

    spans = kept(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high")), "spans")
    place = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)])) if shares else F.array().cast("array<bigint>")
    # a row for each wanted rank: at is its place among the values between a and b, both included, left how many these are
    open_ = spans.select(*names, F.explode(ranks).alias("rank"), F.col("low").alias("a"), F.col("high").alias("b"), F.col("n").alias("left")).withColumn("at", F.col("rank"))
    round_ = 0
    while True:
        few = open_.where(f"a < b and left <= {FEW}")
        listed = few.join(met, _same_group(few, names) & F.col("__x").between(F.col("a"), F.col("b"))).groupBy(*names, "rank", "at").agg(F.sort_array(F.collect_list("__x")).alias("s"))  # FEW values
        found = open_.where("a = b").select(*names, "rank", F.col("a").alias("x")).unionByName(listed.select(*names, "rank", F.get("s", F.col("at").cast("int")).alias("x")))
        found.write.mode("append").parquet(f"{base}/found")
        wide = open_.where(f"a < b and left > {FEW}")
        if wide.isEmpty():
            break
        inside = wide.join(met, _same_group(wide, names) & F.col("__x").between(F.col("a"), F.col("b")))
        v, a, b = (_along(F.col(c), round_ % 2 == 1) for c in ("__x", "a", "b"))
        part = F.when(b > a, F.floor((v - a) / (b - a) * SLICES)).otherwise(F.when(F.col("__x") > F.col("a"), SLICES - 1).otherwise(0))
        counted = inside.groupBy(*names, "rank", "at", F.least(F.greatest(part, F.lit(0)), F.lit(SLICES - 1)).alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("__x").alias("a"), F.max("__x").alias("b"))
        order = Window.partitionBy(*names, "rank").orderBy("part")  # SLICES rows
        before = counted.withColumn("before", F.sum("c").over(order) - F.col("c"))
        chosen = before.where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("c")))
        round_ += 1
        open_ = kept(chosen.select(*names, "rank", "a", "b", F.col("c").alias("left"), (F.col("at") - F.col("before")).alias("at")), f"open-{round_}")
    done = spark.read.schema(found.schema).parquet(f"{base}/found")
    by_rank = done.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("__at"))
    left = spans.withColumnsRenamed({n: f"__r{i}" for i, n in enumerate(names)})
    out = by_rank.join(left, _same_group(by_rank, names)) if shares else spans

    def quantile(p: Column) -> Column:
        low, high = F.floor(p), F.ceil(p)
        a, b = F.col("__at")[low], F.col("__at")[high]
        return F.when(low == high, a).otherwise(a * (high - p) + b * (p - low))

    made = F.array(*[quantile(p) for p in place]) if shares else F.array().cast("array<double>")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n", "low", "high", made.alias("quantiles"))


def _same_group(left: DataFrame, names: Sequence[str]) -> Column:
    """The keys of the right side are called __r0, __r1, ..."""
    on = F.lit(True)
    for i, n in enumerate(names):
        on = on & left[n].eqNullSafe(F.col(f"__r{i}"))
    return on
