"""Connected components of a link table, by alternating large-star and small-star.

Each round is two aggregations and two joins on node ids, written to the shared
folder; hubs are split by AQE's skew join, minima are taken in part before the
shuffle.  Rounds end as soon as all components are stars.  The driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import release, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether all components are stars already: no node has two neighbours that are smaller, or one while it is one itself."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("x")).select("x.*")
    degrees = sides.groupBy("node").agg(F.sum("up").alias("up"), F.count_if(F.col("up") == 0).alias("down"))
    return degrees.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs: (node, root) for every node that isn't its component's smallest.

    Self-links and repeats are ignored; no links give no rows.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _flat(edges):
        large = stored(_large_star(edges))
        before, edges = edges, stored(_small_star(large))
        release(edges.sparkSession, before, large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of roots (node, root, as components() gives them) and further links: only components that the links touch are looked at again."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"__{c}"))
    met = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"))
    above = stored(components(met))
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("__to")), "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
    return moved.union(above)
