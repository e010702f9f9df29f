"""Report tables: bias categories, alignment, roles, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score of each alignment.
ALIGNMENT_SCORES = {"stereotypical": 1.0, "female-biased": -0.5, "male-biased": 0.5, "neutral": 0.0, "counter": -1.0}


def observed_by_log(mean: Column, threshold: float) -> Column:
    return F.when(F.abs(mean) < threshold, "neutral").when(mean > 0, "male").otherwise("female")


def observed_by_counts(male: Column, female: Column, threshold: float) -> Column:
    """By the ratio of two counts; a missing side gives the other one."""
    ratio = F.greatest(male, female) / F.least(male, female)
    return F.when(female.isNull() & male.isNotNull(), "male").when(male.isNull(), "female").when(ratio < threshold, "neutral").when(male > female, "male").otherwise("female")


def alignment(expected: Column, observed: Column) -> Column:
    return (
        F.when(observed.isNull(), F.lit(None).cast("string"))
        .when(observed == "neutral", "neutral")
        .when(expected == "neutral", F.when(observed == "male", "male-biased").otherwise("female-biased"))
        .when(expected == observed, "stereotypical")
        .otherwise("counter")
    )


def alignment_score(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIGNMENT_SCORES.items() for x in pair]), category)


def theme_summary(df: DataFrame, keys: Sequence[str], score: str = "score", threshold: float = 0.25) -> DataFrame:
    """Mean alignment per theme and its category."""
    mean = df.groupBy(*keys).agg(F.avg(score).alias("mean_alignment"), F.count(F.lit(1)).alias("n"))
    return mean.withColumn("category", F.when(F.col("mean_alignment") > threshold, "stereotypical").when(F.col("mean_alignment") < -threshold, "counter").otherwise("neutral"))


def category_counts(df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str]) -> DataFrame:
    """Counts of each category, a column each, 0 where there is none."""
    return df.groupBy(*keys).pivot(category, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))


def heat_map(df: DataFrame, row: str, column: str, values: Sequence[str], cell: str) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(cell))


def roles(df: DataFrame, keys: Sequence[str], order: str = "subtheme", most: int = 2) -> DataFrame:
    """role (from 1) of the first rows of each group."""
    return df.withColumn("role", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("role") <= most)


def score_summary(stats: DataFrame, confidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stats (keys, mean) with the mean and margin of confidence (keys, conf_mean, margin) where it has them, else margin 0."""
    return stats.join(confidence, list(keys), "left").select(*keys, F.coalesce("conf_mean", "mean").alias("mean"), F.coalesce("margin", F.lit(0.0)).alias("margin"))


def named_themes(scores: DataFrame, names: DataFrame, theme: str = "theme", subtheme: str = "subtheme", expected: str = "expected") -> DataFrame:
    """scores (model, theme, subtheme, ...) with the keys that a summary shows and the expected group.

    names (model, theme, theme_name, subtheme, subtheme_name, expected) may lack any of them: a theme without a name is its
    id alone, else 'id [name]'; a subtheme that isn't listed is expected to be neutral.  Of several rows of an id the name
    that sorts last counts.
    """
    def last(key: str, value: str, name: str) -> DataFrame:
        given = names.where(F.col(key).isNotNull()).groupBy(F.col("model").alias("__m"), F.col(key).alias("__k"))
        return given.agg(F.max(F.when(F.col(value) != "", F.col(value))).alias(name))

    def shown(key: str, name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.concat(key, F.lit(" ["), name, F.lit("]"))).otherwise(F.col(key))

    out = scores
    for key, value, name in ((theme, "theme_name", "__theme"), (subtheme, "subtheme_name", "__subtheme"), (subtheme, "expected", "__expected")):
        table = last("theme" if key == theme else "subtheme", value, name)
        out = out.join(table, (out["model"] == table["__m"]) & (out[key] == table["__k"]), "left").drop("__m", "__k")
    kept = [c for c in scores.columns if c != expected]
    return out.select(*kept, shown(theme, "__theme").alias("theme_key"), shown(subtheme, "__subtheme").alias("subtheme_key"), F.coalesce("__expected", F.lit("neutral")).alias(expected))


def neutral_category(df: DataFrame, keys: Sequence[str], order: str = "subtheme", expected: str = "expected", observed: str = "observed") -> DataFrame:
    """keys and the category of the first row, in order, of those that are expected to be neutral."""
    first = df.where(F.col(expected) == "neutral").groupBy(*keys).agg(F.min_by(observed, order).alias("__o"))
    return first.select(*keys, F.when(F.col("__o") == "neutral", "neutral").when(F.col("__o") == "male", "male-biased").otherwise("female-biased").alias("category"))


def expected_in(df: DataFrame, values: Sequence[str], expected: str = "expected") -> DataFrame:
    return df.where(F.col(expected).isin(*values))


def quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least, quartiles (interpolated) and greatest value per group, for box plots."""
    from paritas.operators.quantiles import quantiles

    found = quantiles(df, keys, value, [0.25, 0.5, 0.75])
    return found.select(*keys, "low", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "high")


def feasible(df: DataFrame, accuracy: str = "accuracy", gap: str = "gap", least: float = 0.7, most: float = 0.15) -> DataFrame:
    """Points of a Pareto frame that are accurate and fair enough."""
    return df.where((F.col(accuracy) >= least) & (F.col(gap) < most))


def best_model(df: DataFrame, score: str, order: str, maximize: bool = True) -> DataFrame:
    """The row with the best score; the first in order on ties."""
    key = F.struct((F.col(score) if maximize else -F.col(score)).alias("s"), (-F.col(order)).alias("o"))
    return df.agg(F.max_by(F.struct("*"), key).alias("best")).select("best.*")


def flatten_scores(files: DataFrame, text: str = "value") -> DataFrame:
    """From nested JSON model -> language -> theme -> subtheme -> metric -> value: a row per leaf."""
    kind = "map<string,map<string,map<string,map<string,map<string,double>>>>>"
    out = files.select(F.from_json(text, kind).alias("m"))
    for name in ("model", "language", "theme", "subtheme", "metric"):
        kept = [c for c in out.columns if c != "m"]
        out = out.select(*kept, F.explode("m").alias(name, "m"))
    return out.withColumnRenamed("m", "value")


def parse_log(text: DataFrame, column: str = "value", scenario: str = "TESTING") -> DataFrame:
    """ensemble, score, fscore (an array) of the top ensembles in experiment logs read as whole texts."""
    pattern = F.lit(r"TOP-ENSEMBLE-(\d+) @ " + scenario + r" #\nScore: (.+)\nFScore: (.+)\n")
    parts = [F.regexp_extract_all(column, pattern, F.lit(i)).alias(n) for i, n in ((1, "k"), (2, "s"), (3, "f"))]
    found = text.select(F.explode(F.arrays_zip(*parts)).alias("p"))
    return found.select(F.col("p.k").cast("int").alias("ensemble"), F.col("p.s").cast("double").alias("score"), F.from_json(F.col("p.f"), "array<double>").alias("fscore"))


def fitness_under(fitness: Column, limit: float) -> Column:
    """Whether every component after the first is at most limit."""
    return ~F.exists(F.slice(fitness, 2, F.greatest(F.size(fitness) - 1, F.lit(0))), lambda x: x > limit)
