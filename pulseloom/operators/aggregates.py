"""Totals, tallies and per-cluster aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.functions import text as tx
from pulseloom.operators.ranking import top_n

TOKENS = ["prompt_tokens", "output_tokens", "total_tokens"]


def _token_sums() -> list[Column]:
    return [F.sum(F.coalesce(c, F.lit(0).cast("bigint"))).alias(c) for c in TOKENS]


def token_totals(usage: DataFrame, *by: str) -> DataFrame:
    return usage.groupBy("session_id", *by).agg(*_token_sums())


def token_report(usage: DataFrame) -> DataFrame:
    """Totals by model, by stage, and overall in one pass; ``level`` tells which."""
    wide = usage.groupingSets([["session_id", "model"], ["session_id", "stage"], ["session_id"]], "session_id", "stage", "model").agg(
        *_token_sums(), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 2, "model").when(F.col("_g") == 1, "stage").otherwise("TOTAL")
    return wide.withColumn("level", level).drop("_g")


def candidate_counts(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by source and kind with their sub-totals, and how many are rising."""
    return (candidates.cube(*keys, "source", "kind")
            .agg(F.count("*").alias("n"), F.count_if(F.col("trend_signal") == "rising").alias("rising"), F.grouping_id().alias("_g"))
            .filter(F.col("_g") < 4).drop("_g"))


def harvest_counts(harvest: DataFrame) -> DataFrame:
    return harvest.groupBy("session_id", "query", "platform").agg(F.sum("result_count").alias("items"))


def cluster_summary(posts: DataFrame, *, keys: list[str], source: str = "source") -> DataFrame:
    """Size, distinct sources and means per cluster. Members stay rows: a cluster may be of any size."""
    return posts.groupBy(*keys).agg(
        F.count("*").alias("evidence_count"), F.sort_array(F.collect_set(source)).alias("sources"),
        F.avg("relevance_score").alias("avg_relevance"), F.avg("engagement").alias("avg_engagement"))


def cluster_quotes(posts: DataFrame, n: int = 5, limit: int = 280, *, keys: list[str], ordinal: str) -> DataFrame:
    """The first ``n`` posts of every cluster by relevance, cut to quotes, in order."""
    best = top_n(posts, n, keys, [F.desc(F.greatest("rerank_score", "relevance_score")), F.col(ordinal)])
    quoted = best.select(*keys, "rank", tx.quote(F.col("text"), limit).alias("quote"))
    return quoted.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quote"))),
                                                 lambda q: q["quote"]).alias("quotes"))


def outcome_tally(runs: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """Successes, failures, and failures whose message speaks of a rate limit."""
    failed = F.col(error).isNotNull()
    limited = F.coalesce(F.contains(F.lower(F.col(error)), F.lit("rate limit")) | F.col(error).rlike(r"\b429\b"), F.lit(False))
    return runs.groupBy(*keys).agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"),
                                   F.count_if(limited).alias("rate_limited"), F.count("*").alias("total"))


def mean_words(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(tx.word_count(F.col(text))).alias("mean_words"))


def cluster_sizes(posts: DataFrame, keys: list[str]) -> DataFrame:
    return posts.groupBy(*keys, "cluster_id").agg(F.count("*").alias("size")).withColumn("is_noise", F.col("cluster_id") == -1)


def majority(df: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """The most frequent non-empty value per group; of equally frequent ones the first seen."""
    counted = df.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(
        F.count("*").alias("_n"), F.min(ordinal).alias("_first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", (-F.col("_first")).alias("_f"))).alias(value))
