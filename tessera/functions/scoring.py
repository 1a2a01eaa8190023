"""Scores of ratios, the weighted score, and the decision."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Column names and weights, in the order in which they are added.
WEIGHTS = {"fluency_score": 0.3, "naturalness_score": 0.25, "ratio_score": 0.2, "socio_cultural_score": 0.25}


def target_percent(target: Column) -> Column:
    """Number of a target like ``30%``; null if it is none."""
    return F.rtrim(target, F.lit("%")).try_cast("double")


def linear_score(actual: Column, target: Column, max_points: int = 10) -> Column:
    """Half a point less for each percentage point of difference; half of all points for an unreadable target."""
    goal = target_percent(target)
    score = F.greatest(F.lit(0.0), F.lit(float(max_points)) - F.abs(actual - goal) * 0.5)
    return F.when(goal.isNull(), F.lit(max_points / 2)).when(F.isnan(goal), F.lit(0.0)).otherwise(score)


def step_score(actual: Column, target: Column) -> Column:
    """Two points less for each five percentage points of difference; an unreadable target counts as 0."""
    diff = F.abs(actual - F.coalesce(F.trim(F.replace(target, F.lit("%"), F.lit(""))).try_cast("double"), F.lit(0.0)))
    return F.when(diff <= 5, 10.0).when(diff <= 10, 8.0).when(diff <= 15, 6.0).when(diff <= 20, 4.0).when(diff <= 25, 2.0).otherwise(0.0)


def weighted_score(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Sum of the score columns by their weights; doubles are added in the order given."""
    return reduce(lambda a, b: a + b, (F.col(name).cast("double") * F.lit(float(w)) for name, w in weights.items()))


def contributions(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Array of (dimension, score, weight, contribution) of a row."""
    return F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(n).cast("double").alias("score"), F.lit(float(w)).alias("weight"), (F.col(n).cast("double") * F.lit(float(w))).alias("contribution")) for n, w in weights.items()))


def decision(score: Column, refine_count: Column, threshold: float = 8.0, max_refine: int = 1, least: Column | None = None, least_needed: float = 5.0) -> Column:
    """``REFINE`` below the threshold while refinements are left, else ``ACCEPT``.

    With ``least``, a row's lowest score, one below ``least_needed`` is refined as well.
    """
    low = score < threshold if least is None else (score < threshold) | (least < least_needed)
    return F.when(low & (refine_count < max_refine), "REFINE").otherwise("ACCEPT")
