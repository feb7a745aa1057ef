"""Search payloads of the news-discussion platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HIT = ("struct<objectID:string, title:string, story_text:string, comment_text:string, url:string, author:string, created_at:string, points:bigint, "
       "num_comments:bigint, _tags:array<string>, story_id:string, parent_id:string>")
SEARCH = f"hits array<{HIT}>, page int, nbPages int, hitsPerPage int"
# Kinds by precedence; a story has none of these tags.
KINDS = ["comment", "poll", "pollopt", "job"]


def parse(pages: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    return pages.select(*keys, F.from_json(payload, SEARCH).alias("_page"))


def posts(parsed: DataFrame, keys: list[str], as_of_iso: str) -> DataFrame:
    h = parsed.select(*keys, F.posexplode("_page.hits").alias("pos", "h")).select(*keys, "pos", "h.*")
    tags = F.coalesce("_tags", F.array().cast("array<string>"))
    kind = F.lit("story")
    for name in reversed(KINDS):
        kind = F.when(F.array_contains(tags, name), F.lit(name)).otherwise(kind)
    zero = F.lit(0).cast("bigint")
    return h.select(*keys, "pos", F.col("objectID").alias("id"), kind.alias("type"), "title",
                    F.coalesce(F.nullif("story_text", F.lit("")), "comment_text").alias("text"), "url", "author",
                    F.coalesce(F.nullif("created_at", F.lit("")), F.lit(as_of_iso)).alias("createdAt"), F.coalesce("points", zero).alias("points"),
                    F.coalesce("num_comments", zero).alias("comments"), tags.alias("tags"), F.col("story_id").alias("storyId"), F.col("parent_id").alias("parentId"))


def page_facts(parsed: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda name: F.coalesce(F.col(f"_page.{name}"), F.lit(0))
    return parsed.select(*keys, n("page").alias("page"), n("nbPages").alias("total_pages"), n("hitsPerPage").alias("hits_per_page"),
                         (n("page") < n("nbPages") - 1).alias("has_next"))
