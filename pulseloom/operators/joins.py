"""Joins of posts with what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseloom.functions import text as tx
from pulseloom.operators.projections import filled, first_filled


def topics_by_platform_id(topics: DataFrame, platform_ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """Topics found through a platform's own id; ``wanted`` lists (platform, platform_id)."""
    hashed = wanted.select(tx.platform_hash(F.col("platform"), F.col("platform_id")).alias("hashed_id")).distinct()
    links = platform_ids.join(hashed, "hashed_id", "left_semi").select(F.col("topic_id").alias("id"), "hashed_id")
    return topics.join(links, "id")


def evidence_posts(owners: DataFrame, posts: DataFrame, *, owner: list[str], ids: str, post_id: str) -> DataFrame:
    """The posts behind id lists, with their place in the list; ids without a post are dropped."""
    listed = owners.select(*owner, F.posexplode(ids).alias("place", post_id))
    return listed.join(posts, [c for c in owner if c in posts.columns] + [post_id])


def with_transcripts(posts: DataFrame, transcripts: DataFrame, url: str = "url") -> DataFrame:
    """Caption, counts, names and time from the media record of the same URL where it has them; transcript or ''."""
    t = transcripts.select(url, F.col("transcript").alias("_transcript"),
                           *[F.col(f"meta.{c}").alias(f"_{c}") for c in
                             ("description", "like_count", "comment_count", "channel", "uploader", "timestamp")])
    j = posts.join(t, url, "left")
    zero = F.lit(0).cast("bigint")
    return (j.withColumn("caption", first_filled(F.col("_description"), F.col("caption")))
            .withColumn("like_count", F.coalesce("_like_count", "like_count", zero))
            .withColumn("comment_count", F.coalesce("_comment_count", "comment_count", zero))
            .withColumn("username", first_filled(F.col("_channel"), F.col("username")))
            .withColumn("full_name", first_filled(F.col("_uploader"), F.col("full_name")))
            .withColumn("taken_at", F.coalesce(F.nullif("_timestamp", zero), F.nullif("taken_at", zero), zero))
            .withColumn("transcript", first_filled(F.col("_transcript")))
            .select(*posts.columns, "transcript"))


def with_details(videos: DataFrame, details: DataFrame, id_col: str = "id") -> DataFrame:
    """Title and description of the detail record where it has them."""
    d = details.select(id_col, F.col("title").alias("_title"), F.col("shortDescription").alias("_description"))
    j = videos.join(d, id_col, "left")
    return (j.withColumn("title", F.coalesce(filled(F.col("_title")), F.col("title")))
            .withColumn("description", F.coalesce(filled(F.col("_description")), F.col("description")))
            .select(*videos.columns))


def new_only(batch: DataFrame, store: DataFrame, id_col: str = "id") -> DataFrame:
    return batch.join(store.select(id_col), id_col, "left_anti")


def expand_topics(topics: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Every topic with every source's suggestions for it; a source that failed has none.

    ``topics``: session_id, topic, topic_ord. ``suggestions``: topic, source, source_ord, pos, query, trend_signal.
    """
    return topics.join(suggestions, "topic")
