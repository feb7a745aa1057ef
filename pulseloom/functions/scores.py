"""Arithmetic of engagement and score normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulseloom import settings
from pulseloom.functions.moments import age_days, age_hours


def engagement(source: Column, score: Column, comments: Column, created: Column, as_of: Column) -> Column:
    """Log-compressed activity that decays with age."""
    votes, talk = score.cast("double"), comments.cast("double")
    base = (
        F.when(source.isin("reddit", "hackerNews"), votes + talk * 2.0)
        .when(source == "youtube", votes * 0.02 + talk * 2.0)
        .otherwise(votes + talk)
    )
    decay = F.exp(F.lit(-settings.DECAY_PER_DAY) * age_days(created, as_of))
    return F.round(F.log1p(F.greatest(F.lit(0.0), base)) * decay, 4)


def engagement_velocity(likes: Column, comments: Column, taken: Column, as_of: Column) -> Column:
    hours = F.greatest(F.coalesce(age_hours(taken, as_of), F.lit(0.0)), F.lit(1.0))
    total = F.coalesce(likes, F.lit(0)) + F.coalesce(comments, F.lit(0))
    return F.round(total / hours, 2)


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def min_max(x: Column, lowest: Column, highest: Column) -> Column:
    """Scaled to [0, 1]; a constant column stays as it is."""
    return F.when(highest > lowest, (x - lowest) / (highest - lowest)).otherwise(x)


def share_of_max(x: Column, highest: Column) -> Column:
    return F.when(highest > 0, x / highest).otherwise(F.lit(0.0))


def with_extent(df, keys: list[str], **columns: str):
    """Add per-group ``<name>_min`` / ``<name>_max`` of columns.

    The extents come from a partial aggregation joined back, not from an unordered window: a window would
    bring a whole group, however large, into one task.
    """
    aggs = []
    for name, column in columns.items():
        aggs += [F.min(column).alias(f"{name}_min"), F.max(column).alias(f"{name}_max")]
    return df.join(df.groupBy(*keys).agg(*aggs), keys)
