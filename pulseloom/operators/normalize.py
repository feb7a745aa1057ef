"""Posts of four platforms into one shape, junk dropped, first occurrence kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom import settings
from pulseloom.functions import text as tx
from pulseloom.functions.once import with_once
from pulseloom.functions.moments import from_epoch_seconds, parse_moment
from pulseloom.functions.scores import engagement
from pulseloom.operators.filters import enough_views, enough_words, in_language, not_a_bot, not_deleted
from pulseloom.operators.projections import default_url, first_filled

CONTEXT = ["session_id", "query", "query_ord", "platform_ord", "pos"]
POST_COLUMNS = ["session_id", "id", "source", "query", "query_ord", "platform_ord", "pos", "text", "title", "author",
                "score", "num_comments", "created_at", "url", "subreddit", "channel", "engagement"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))


def _landed(df: DataFrame, source: str, id_prefix: str, *, title: Column, body: Column, author: Column, score: Column, comments: Column,
            created: Column, url: Column, native: str, subreddit: Column | None = None, channel: Column | None = None) -> DataFrame:
    """The posts of one platform in the common shape, their texts not yet cleaned."""
    empty = F.lit("")
    return df.select(
        *CONTEXT, F.concat(F.lit(id_prefix), F.col(native)).alias("id"), F.lit(source).alias("source"), title.alias("_title"), body.alias("_body"),
        author.alias("author"), score.alias("score"), comments.alias("num_comments"), created.alias("created_at"), url.alias("url"),
        (empty if subreddit is None else subreddit).alias("subreddit"), (empty if channel is None else channel).alias("channel"))


def landed_reddit(df: DataFrame, as_of: Column) -> DataFrame:
    return _landed(df.filter(not_a_bot(F.col("author"))), "reddit", "reddit_", native="postId", title=F.col("title"), body=F.col("body"),
                   author=_text("author"), score=_number("score"), comments=_number("comments"),
                   created=parse_moment(F.col("createdIso"), as_of), url=_text("permalink"), subreddit=_text("subreddit"))


def landed_youtube(df: DataFrame, as_of: Column) -> DataFrame:
    popular = df.withColumn("_views", tx.digits(_text("viewsText"))).filter(enough_views(F.col("_views")))
    return _landed(popular, "youtube", "youtube_", native="id", title=F.col("title"), body=F.col("description"), author=_text("channelName"),
                   score=F.col("_views"), comments=F.lit(0).cast("bigint"), created=parse_moment(F.col("publishedText"), as_of),
                   url=_text("url"), channel=_text("channelName"))


def landed_hackernews(df: DataFrame, as_of: Column) -> DataFrame:
    return _landed(df, "hackerNews", "hackernews_", native="id", title=F.col("title"), body=F.col("text"), author=_text("author"),
                   score=_number("points"), comments=_number("comments"), created=parse_moment(F.col("createdAt"), as_of),
                   url=default_url(F.col("url"), F.col("id")))


def landed_instagram(df: DataFrame, as_of: Column) -> DataFrame:
    return _landed(df, "instagram", "instagram_", native="pk", title=F.col("caption"), body=F.col("transcript"),
                   author=first_filled(F.col("username"), F.col("full_name")), score=_number("like_count"), comments=_number("comment_count"),
                   created=from_epoch_seconds(F.col("taken_at").cast("bigint"), as_of), url=_text("url"))


def readable_posts(landed: DataFrame, as_of: Column) -> DataFrame:
    """Cleaned posts of all platforms at once; the junk of each dropped. Cheap tests first: the language is only looked up
    for texts that are long enough."""
    clean = with_once(landed, _t=tx.clean_text(F.col("_title")), _b=tx.clean_text(F.col("_body"))).drop("_title", "_body")
    there = ~F.col("source").isin("reddit", "hackerNews") | not_deleted(F.col("_t"), F.col("_b"))
    composed = with_once(clean.filter(there), text=tx.compose(F.col("_t"), F.col("_b")))
    kept = composed.filter(enough_words(F.col("text")) & in_language(F.col("text")))
    title = F.when(F.col("source") == "instagram", tx.truncate(F.col("_t"), 100)).otherwise(F.col("_t"))
    return kept.withColumn("title", title).withColumn("engagement", engagement(
        F.col("source"), F.col("score"), F.col("num_comments"), F.col("created_at"), as_of)).select(*POST_COLUMNS)


LANDED = {"reddit": landed_reddit, "youtube": landed_youtube, "hackerNews": landed_hackernews, "instagram": landed_instagram}


def _normalizer(name: str):
    return lambda df, as_of: readable_posts(LANDED[name](df, as_of), as_of)


NORMALIZERS = {name: _normalizer(name) for name in LANDED}


def first_occurrence(posts: DataFrame) -> DataFrame:
    """Per session and id the earliest by query, platform and position.

    Every task first keeps one row per id of its own input, so an id that fills a third of the table is no hot key.
    """
    order = Window.partitionBy("session_id", "id").orderBy("query_ord", "platform_ord", "pos")
    return posts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")


def normalize(platforms: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Union of the given platforms' posts, junk dropped before repeats are."""
    parts = [LANDED[name](platforms[name], as_of) for name in settings.PLATFORMS if name in platforms]
    return first_occurrence(readable_posts(reduce(DataFrame.unionByName, parts), as_of))
