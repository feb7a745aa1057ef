"""Query expansion: candidates from suggestion tables, scored and thinned."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom import settings
from pulseloom.functions import text as tx
from pulseloom.functions.documents import subtopic_reply
from pulseloom.functions.once import bind
from pulseloom.functions.scores import clamp01
from pulseloom.functions.vectors import cosine
from pulseloom.operators.grouping import near_duplicates
from pulseloom.operators.ranking import top_n
from pulseloom.operators.sets import distinct_ignoring_case
from pulseloom.operators.similarity import peer_support
from pulseloom.session import cut


def kind_of(source: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, value in settings.KIND_OF_SOURCE.items():
        kind = F.when(source == name, F.lit(value)).otherwise(kind)
    return kind


def trends_suggestions(related: DataFrame) -> DataFrame:
    """Rising queries before top ones, without empty ones and the topic itself. ``related``: topic, list, pos, query."""
    kept = related.filter((F.coalesce("query", F.lit("")) != "") & (F.lower("query") != F.lower("topic")))
    list_ord = F.when(F.col("list") == "rising", 0).otherwise(1)
    return kept.select("topic", "query", F.lit("trends").alias("source"), F.col("list").alias("trend_signal"),
                       list_ord.alias("list_ord"), "pos")


def expand_breadth(seeds: DataFrame, suggestions: DataFrame, depth: int = 1) -> DataFrame:
    """Suggestions of suggestions, ``depth`` levels deep, each text once per session.

    ``seeds``: session_id, query. ``suggestions``: query, pos, suggestion. Result: session_id, query, level, path, where
    ``path`` (positions from the seed down) orders the finds.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    table = suggestions.select(F.lower("query").alias("_key"), F.col("pos").cast("int").alias("_pos"), "suggestion").filter(
        (F.coalesce("suggestion", F.lit("")) != "") & (F.lower("suggestion") != F.col("_key")))
    # of a suggestion that comes again, only the first place can be kept
    table = table.groupBy("_key", F.lower("suggestion").alias("_low")).agg(F.min(F.struct("_pos", "suggestion")).alias("_s")).select(
        "_key", "_s._pos", "_s.suggestion")
    frontier = seeds.select("session_id", F.lower("query").alias("_key"), F.array().cast("array<int>").alias("path"))
    seen = None
    for level in range(1, depth + 1):
        found = frontier.join(table, "_key").select(
            "session_id", F.col("suggestion").alias("query"), F.lower("suggestion").alias("_key"),
            F.concat("path", F.array("_pos")).alias("path"), F.lit(level).alias("level"))
        fresh = top_n(found, 1, ["session_id", "_key"], ["path"], "_rank").drop("_rank")
        if seen is not None:
            fresh = fresh.join(seen.select("session_id", "_key"), ["session_id", "_key"], "left_anti")
        fresh = cut(fresh)
        seen = fresh if seen is None else seen.unionByName(fresh)
        frontier = fresh.select("session_id", "_key", "path")
    return seen.drop("_key")


def subtopic_prompts(topics: DataFrame, siblings: str = "topics") -> DataFrame:
    """Context lines for a subtopic request: question, topic, classification and the topics beside it."""
    beside = F.filter(siblings, lambda x: F.lower(x) != F.lower("topic"))
    lines = F.concat_ws(
        "\n", F.concat(F.lit('Original question: "'), "original_query", F.lit('"')),
        F.concat(F.lit('Topic to expand: "'), "topic", F.lit('"')),
        F.concat(F.lit("Intent: "), "intent", F.lit("; Category: "), "category"),
        F.when(F.size(beside) > 0, F.concat(F.lit("Related topics: "), F.array_join(beside, ", "))))
    return topics.withColumn("prompt", lines)


def subtopic_candidates(replies: DataFrame) -> DataFrame:
    """Replies (topic, reply) as suggestion rows, the topic itself left out."""
    listed = replies.select("topic", F.posexplode(subtopic_reply(F.col("reply"))).alias("pos", "query"))
    return listed.filter((F.col("query") != "") & (F.lower("query") != F.lower("topic"))).withColumn("source", F.lit("llm"))


def merge_candidates(found: DataFrame, order: list[str]) -> DataFrame:
    """All expanders' finds, each query once per session whatever its case, with the kind of its source."""
    return distinct_ignoring_case(found, "query", order, ["session_id"]).withColumn("kind", kind_of(F.col("source")))


def score_candidates(candidates: DataFrame, seeds: DataFrame, *, peer_threshold: float = settings.PEER_THRESHOLD,
                     id_col: str = "ord", vec_col: str = "vec", block_rows: int = settings.BLOCK_ROWS) -> DataFrame:
    """Global, relative and blended score per candidate; of equal texts the first stays.

    ``candidates``: session_id, ord, query, source, kind, trend_signal, vec. ``seeds``: session_id, seed_vec.
    """
    keys = ["session_id"]
    support = peer_support(candidates, peer_threshold, keys=keys, id_col=id_col, vec_col=vec_col, source_col="source",
                           block_rows=block_rows)
    per_session = candidates.groupBy(*keys).agg((F.min("source") != F.max("source")).alias("_peers"))
    joined = (candidates.join(seeds.select(*keys, "seed_vec"), keys).join(per_session, keys)
              .join(support, keys + [id_col], "left"))
    raw = joined.withColumn("_global", clamp01(cosine(F.col(vec_col).cast("array<double>"), F.col("seed_vec").cast("array<double>")))).withColumn(
        "_raw", F.when(F.col("peer_matches") > 0, F.col("peer_sum") / F.col("peer_matches")).otherwise(0.0))
    top = support.groupBy(*keys).agg(F.max(F.col("peer_sum") / F.col("peer_matches")).alias("_top"))
    related = raw.join(top, keys, "left").withColumn(
        "_relative", F.col("_raw") / F.greatest(F.coalesce("_top", F.lit(0.0)), F.lit(sys.float_info.epsilon)))
    first = distinct_ignoring_case(related, "query", [id_col], keys, trimmed=True)
    return first.select(*candidates.columns, F.round(blended_score(), 4).alias("semantic_score"),
                        F.round("_global", 4).alias("global_score"), F.round("_relative", 4).alias("relative_score"))


def blended_score() -> Column:
    base = clamp01(F.when(F.col("_peers"), F.col("_global") * settings.GLOBAL_WEIGHT + F.col("_relative") * settings.PEER_WEIGHT)
                   .otherwise(F.col("_global")))
    boost = (F.when(F.col("trend_signal") == "rising", settings.RISING_BOOST).when(F.col("trend_signal") == "top", settings.TOP_BOOST)
             .otherwise(1.0) * F.when(F.col("kind") == "demand", settings.DEMAND_BOOST).otherwise(1.0))
    # a boost past 1 takes its share of the room that is left, so that high scores stay apart
    return bind(base, lambda b: clamp01(F.when(b * boost > 1, b + (1 - b) * (boost - 1)).otherwise(b * boost)))


def thin_candidates(scored: DataFrame, threshold: float = settings.DUPLICATE_THRESHOLD, *, id_col: str = "ord",
                    vec_col: str = "vec", block_rows: int = settings.BLOCK_ROWS) -> DataFrame:
    """Best first, candidates too similar to a better one are dropped."""
    groups = near_duplicates(scored, threshold, keys=["session_id"], id_col=id_col, vec_col=vec_col,
                             priority_col="semantic_score", ordinal_col=id_col, block_rows=block_rows)
    kept = groups.filter(F.col(id_col) == F.col("leader_id")).select("session_id", id_col)
    return scored.join(kept, ["session_id", id_col], "left_semi")


def fallback_questions(topic: Column) -> Column:
    parts = [template.split("{}") for template in settings.FALLBACK_QUESTIONS]
    return F.array(*[F.concat(F.lit(before), topic, F.lit(after)) for before, after in parts])


def topics_or_query(topics: Column, query: Column) -> Column:
    """The normalised query when no topic was extracted."""
    return F.when(F.size(F.coalesce(topics, F.array().cast("array<string>"))) == 0,
                  F.array(tx.collapse_blanks(F.lower(query)))).otherwise(topics)
