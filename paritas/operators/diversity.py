"""Oracle signs and pairwise diversity of classifiers.

The prediction matrix is an array column; for n classifiers the pairwise sums are
n * n conditional aggregates of one pass, without a self-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_weights(weights: Sequence[float] | None, n: int) -> None:
    if weights is not None and (len(weights) != n or abs(sum(weights) - 1) > 1e-9 or min(weights) < 0):
        raise ValueError("weights must be one per classifier, at least 0, and sum to 1")


def oracle_signs(preds: Column, gold: Column, weights: Sequence[float] | None = None) -> Column:
    """+1 where a classifier is right, else -1, times its weight if there are weights."""
    signs = F.transform(preds, lambda p: F.when(p == gold, 1.0).otherwise(-1.0))
    if weights is None:
        return signs
    return F.zip_with(signs, F.array(*[F.lit(float(w)) for w in weights]), lambda s, w: s * w)


def pairwise(df: DataFrame, n: int, preds: str = "preds", gold: str = "gold", weights: Sequence[float] | None = None) -> DataFrame:
    """i, j (from 0), disagreement, double_fault, double_fault_inverse, kohavi_wolpert."""
    check_weights(weights, n)
    signs = df.select(oracle_signs(F.col(preds), F.col(gold), weights).alias("s"))
    pairs = []
    for i in range(n):
        for j in range(n):
            a, b = F.col("s")[i], F.col("s")[j]
            wrong = ((a < 0).cast("double") + (b < 0).cast("double")) / 2
            pairs.append(
                F.struct(
                    F.lit(i).alias("i"),
                    F.lit(j).alias("j"),
                    F.avg((F.signum(a) != F.signum(b)).cast("double")).alias("disagreement"),
                    F.avg(((a < 0) & (a == b)).cast("double")).alias("double_fault"),
                    F.avg(wrong * (1 - wrong)).alias("kohavi_wolpert"),
                )
            )
    out = signs.agg(F.array(*pairs).alias("pairs")).select(F.explode("pairs").alias("p")).select("p.*")
    return out.select("i", "j", "disagreement", "double_fault", (1 - F.col("double_fault")).alias("double_fault_inverse"), "kohavi_wolpert")


def greedy_rank(scores: Sequence[float | None], diversity: dict[tuple[int, int], float], top_cut: int | None = None, maximize: bool = True) -> list[float]:
    """Ranks by greedy diversity: the best model first, then whoever adds most diversity to those chosen.

    The first gets n, the next n - 1, and so on; failed models (score None) get -1;
    raw scores come back if top_cut models or fewer, or less than three, are valid.
    Ties go to the lowest index.  Driver side: n is the number of classifiers.
    """
    valid = [i for i, s in enumerate(scores) if s is not None]
    if (top_cut is not None and len(valid) <= top_cut) or len(valid) < 3:
        return [-1.0 if s is None else s for s in scores]
    sign = 1 if maximize else -1
    out = [-1.0] * len(scores)
    left, chosen = list(valid), []
    for place in range(len(valid), 0, -1):
        best = max(left, key=lambda i: (sum(diversity[j, i] for j in chosen) if chosen else sign * scores[i], -i))
        left.remove(best)
        chosen.append(best)
        out[best] = float(place)
    return out


def best_performance_rank(scores: Sequence[float | None], maximize: bool = True) -> list[float]:
    """0 for the worst of the valid models up to n - 1 for the best; among equal ones the later index ranks higher; failed models get -1."""
    sign = 1 if maximize else -1
    order = sorted((i for i, s in enumerate(scores) if s is not None), key=lambda i: (sign * scores[i], i))
    out = [-1.0] * len(scores)
    for place, i in enumerate(order):
        out[i] = float(place)
    return out


def random_rank(scores: Sequence[float | None], seed: int = 0, keep_best: bool = False, maximize: bool = True) -> list[float]:
    """A seeded random order of the valid models as ranks; keep_best gives the best one (the last of equal ones) the highest."""
    import random

    valid = [i for i, s in enumerate(scores) if s is not None]
    order = valid[:]
    random.Random(seed).shuffle(order)
    if keep_best and valid:
        best = int(max(valid, key=lambda i: ((1 if maximize else -1) * scores[i], i)))
        order = [best, *[i for i in order if i != best]]
    out = [-1.0] * len(scores)
    for place, i in enumerate(order):
        out[i] = float(len(order) - place)
    return out
