"""Seeded splits and samples.  Order comes from a hash of (id, seed), so a run can be repeated anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_share(id_col: str, seed: int = 0) -> Column:
    """A number in [0, 1) per id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)


def split(df: DataFrame, id_col: str, share: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(training, test): about share of the rows are test; no shuffle."""
    at = hash_share(id_col, seed)
    return df.where(at >= share), df.where(at < share)


def _first(df: DataFrame, id_col: str, strata: Sequence[str], seed: int, sized) -> DataFrame:
    """df with __in: whether the row is one of its stratum's first __size, in hash order.

    A stratum is dealt by slices of the hash, whose rows are counted first; sized adds __size to that table (strata, __n: the stratum's rows),
    or drops strata.  A slice lies wholly before or after the size but for one in each stratum: only that one's rows are shuffled and ranked.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_col))).withColumn("__slice", F.shiftright("__h", 64 - SLICE_BITS))
    counts = hashed.groupBy(*strata, "__slice").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*strata)
    slices = sized(counts.select(*strata, "__slice", (F.sum("__c").over(w.orderBy("__slice")) - F.col("__c")).alias("__before"), "__c", F.sum("__c").over(w).alias("__n")))
    slices = slices.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(strata)], F.col("__slice").alias("__s"), (F.col("__size") - F.col("__before")).alias("__left"), "__c")
    same = F.col("__slice") == F.col("__s")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    cut = (F.col("__left") > 0) & (F.col("__left") < F.col("__c"))
    whole = hashed.join(slices.where(~cut), same).select(*df.columns, (F.col("__left") > 0).alias("__in"))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("__h", id_col))
    return whole.unionByName(hashed.join(slices.where(cut), same).select(*df.columns, (place <= F.col("__left")).alias("__in")))


#: Bits of the hash that deal a stratum.
SLICE_BITS = 12


def stratified_split(df: DataFrame, id_col: str, strata: Sequence[str], share: float = 0.3, seed: int = 0) -> DataFrame:
    """df with split: the first rounded share of each stratum, in hash order, is test."""
    placed = _first(df, id_col, strata, seed, lambda slices: slices.withColumn("__size", F.bround(F.col("__n") * share)))
    return placed.withColumn("split", F.when(F.col("__in"), "test").otherwise("train")).select(*df.columns, "split")


def stratified_sample(df: DataFrame, id_col: str, strata: Sequence[str], sizes: DataFrame, seed: int = 0) -> DataFrame:
    """The first `size` rows of each stratum in hash order; sizes: a size for some of the strata's columns."""
    keys = [c for c in sizes.columns if c != "size"]
    return _first(df, id_col, strata, seed, lambda slices: slices.join(sizes.withColumnRenamed("size", "__size"), keys)).where("__in").select(*df.columns)


def same_data(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The split that trains and tests on all rows."""
    return df, df


def group_sizes(df: DataFrame, label: str, category: str) -> DataFrame:
    """Per category: the smallest of its counts over the labels."""
    return df.groupBy(label, category).agg(F.count(F.lit(1)).alias("n")).groupBy(category).agg(F.min("n").alias("size"))


def balanced_sizes(df: DataFrame, label: str, groups: str) -> DataFrame:
    """Sizes by the number of groups listed (0, 1, 2); none is capped by size 1 plus half of size 2."""
    by_size = group_sizes(df.withColumn("n_groups", F.size(groups)), label, "n_groups")
    caps = by_size.agg(F.coalesce(F.max(F.when(F.col("n_groups") == 1, F.col("size"))), F.lit(0)).alias("one"), F.coalesce(F.max(F.when(F.col("n_groups") == 2, F.col("size"))), F.lit(0)).alias("two"))
    cap = (F.col("one") + F.floor(F.col("two") / 2)).cast("long")
    return by_size.crossJoin(F.broadcast(caps)).select("n_groups", F.when(F.col("n_groups") == 0, F.least("size", cap)).otherwise(F.col("size")).alias("size"))  # caps is one row


def debiased_sizes(df: DataFrame, label: str, groups: str) -> DataFrame:
    """Sizes by the exact set of groups, joined with ' & '."""
    return group_sizes(df.withColumn("group_set", F.concat_ws(" & ", F.array_sort(groups))), label, "group_set")
