"""Session store: listings, resume points, run states, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom import settings
from pulseloom.operators.sets import patch


def listing(df: DataFrame, order: list[Column | str], **equal) -> DataFrame:
    """Rows with the given key values, in the given order."""
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df.orderBy(*order)


def resume_points(runs: DataFrame, stages: list[str] = settings.RUN_STAGES) -> DataFrame:
    """Index of the stage each session goes on with: one past the furthest completed one."""
    index = F.lit(0)
    for i, stage in enumerate(stages):
        index = F.when((F.col("stage") == stage) & (F.col("status") == "completed"), F.lit(i + 1)).otherwise(index)
    return runs.groupBy("session_id").agg(F.max(index).alias("next_stage"))


def finish_runs(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Apply (id, completed_at, error, result_summary) outcomes: an error means failed, else completed."""
    changes = outcomes.select("id", F.when(F.col("error").isNotNull(), "failed").otherwise("completed").alias("status"),
                              "completed_at", "error", "result_summary")
    return patch(runs, changes, ["id"])


def usage_events(events: DataFrame) -> DataFrame:
    """Token usage out of trace events: only successful calls that report usage; missing counts are 0."""
    kept = events.filter((F.col("phase") == "ok") & F.col("usage").isNotNull() & F.col("session_id").isNotNull())
    count = lambda name: F.coalesce(F.col(f"usage.{name}"), F.lit(0).cast("bigint"))
    return kept.select("session_id", F.col("scope").alias("stage"), F.coalesce("model", F.lit(settings.DEFAULT_MODEL)).alias("model"),
                       count("promptTokenCount").alias("prompt_tokens"), count("candidatesTokenCount").alias("output_tokens"),
                       count("totalTokenCount").alias("total_tokens"))


def session_summary(sessions: DataFrame, **per_session: DataFrame) -> DataFrame:
    """One row per session joined with tables that have one row per session at most."""
    for table in per_session.values():
        sessions = sessions.join(table, "session_id", "left")
    return sessions
