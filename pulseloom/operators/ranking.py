"""Ranks and top lists. A task never sorts a whole group: each keeps its own top rows before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom import settings


def top_n(df: DataFrame, n: int, keys: list[str], order: list[Column | str], rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group. Up to 1000, Spark limits groups before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= n)
    return ranked.withColumn(rank_col, F.col(rank_col).cast("bigint"))


def placed(df: DataFrame, keys: list[str], order: list[Column | str], rank_col: str = "rank") -> DataFrame:
    """Every row with its place in its group."""
    return df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def harvest_rank(df: DataFrame, keys: list[str], page: str, position: str, limit: int) -> DataFrame:
    """One rank running over the pages of a query, up to the limit."""
    return top_n(df, limit, keys, [page, position])


def harvest_rank_distinct(df: DataFrame, keys: list[str], id_col: str, page: str, position: str, limit: int) -> DataFrame:
    """The same, each id counted where it first appears."""
    first = top_n(df, 1, keys + [id_col], [page, position], "_first").drop("_first")
    return harvest_rank(first, keys, page, position, limit)


def threshold_or_floor(df: DataFrame, threshold: float = settings.RELEVANCE_THRESHOLD,
                       floor: int = settings.RELEVANCE_FLOOR, *, keys: list[str], score: str, ordinal: str) -> DataFrame:
    """Everything at or over the threshold, and the best ``floor`` rows of a group in any case.

    Rows over the threshold need no rank, so only the floor is ranked, and that is limited per task.
    """
    over = df.filter(F.col(score) >= threshold)
    best = top_n(df, floor, keys, [F.desc(score), ordinal], "_rank").filter(F.col(score) < threshold).drop("_rank")
    return over.unionByName(best)


def top_per_cluster(df: DataFrame, n: int = settings.DOCS_PER_CLUSTER, *, keys: list[str], ordinal: str) -> DataFrame:
    best = F.greatest("rerank_score", "relevance_score")
    return top_n(df, n, keys, [F.desc(best), F.col(ordinal)])


def rerank(df: DataFrame, scorer=None, n: int = settings.RERANK_TOP_N, *, keys: list[str], query: str, text: str,
           ordinal: str) -> DataFrame:
    """Score (query, text) pairs with a vectorised UDF and keep the best. Without a scorer nothing changes."""
    if scorer is None:
        return df.withColumn("rerank_score", F.lit(0.0))
    scored = df.withColumn("rerank_score", scorer(F.col(query), F.col(text)))
    return top_n(scored, n, keys, [F.desc("rerank_score"), F.col(ordinal)], "_rank").drop("_rank")


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The newest row of every group: replacing writes leave one row per key."""
    return top_n(df, 1, keys, order, "_rank").drop("_rank")
