"""Harvest maps, search payloads and media records of the photo platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.functions.scores import engagement_velocity

HARVEST = "results map<string,array<string>>"
MEDIA = ("id string, title string, description string, channel string, uploader string, uploader_id string, timestamp bigint, like_count bigint, "
         "comment_count bigint")
ITEM = ("struct<pk:string, code:string, media_type:int, user:struct<username:string,full_name:string>, original_width:int, original_height:int, "
        "caption:struct<text:string>, like_count:bigint, comment_count:bigint, view_count:bigint, taken_at:bigint>")
SEARCH = f"data struct<xdt_fbsearch__top_serp_graphql:struct<edges:array<struct<node:struct<items:array<{ITEM}>>>>>>"


def post_code(url: Column) -> Column:
    found = F.regexp_extract(url, r"/(?:p|reel)/([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found)


def harvested_posts(harvests: DataFrame, keys: list[str], taken_at: int, payload: str = "payload") -> DataFrame:
    """Minimal posts of a harvest map; links without a post code are left out, ranks run on over its queries."""
    entries = F.map_entries(F.from_json(payload, HARVEST)["results"])
    links = F.flatten(F.transform(entries, lambda e: F.transform(
        F.filter(e["value"], lambda u: post_code(u).isNotNull()), lambda u: F.struct(e["key"].alias("query"), u.alias("url")))))
    rows = harvests.select(*keys, F.posexplode(links).alias("pos", "_l"))
    code = post_code(F.col("_l.url"))
    return rows.select(*keys, code.alias("pk"), code.alias("code"), "_l.query", "_l.url", F.lit(taken_at).cast("bigint").alias("taken_at"),
                       (F.col("pos") + 1).alias("rank"))


def media_record(stdout: Column) -> Column:
    """The record a downloader printed as its last line."""
    return F.from_json(F.element_at(F.split(F.trim(F.regexp_replace(stdout, r"\s+$", "")), "\n"), -1), MEDIA)


def search_posts(pages: DataFrame, keys: list[str], as_of: Column, payload: str = "payload") -> DataFrame:
    """Posts of nested search payloads with likes-and-comments per hour."""
    p = pages.select(*keys, F.from_json(payload, SEARCH)["data"]["xdt_fbsearch__top_serp_graphql"]["edges"].alias("_edges"))
    edges = p.select(*keys, F.posexplode("_edges").alias("edge", "_e"))
    i = edges.select(*keys, "edge", F.posexplode("_e.node.items").alias("pos", "i"))
    zero = F.lit(0).cast("bigint")
    n = lambda name: F.coalesce(F.col(f"i.{name}"), zero)
    return i.select(*keys, "edge", "pos", "i.pk", "i.code", "i.media_type", "i.user.username", "i.user.full_name", F.col("i.original_width").alias("width"),
                    F.col("i.original_height").alias("height"), F.col("i.caption.text").alias("caption"), n("like_count").alias("like_count"),
                    n("comment_count").alias("comment_count"), n("view_count").alias("view_count"), "i.taken_at",
                    engagement_velocity(n("like_count"), n("comment_count"), F.timestamp_seconds(F.nullif("i.taken_at", zero)), as_of).alias("engagement_velocity"),
                    F.concat(F.lit("https://www.instagram.com/p/"), "i.code", F.lit("/")).alias("url"))


def most_liked_first(posts: DataFrame) -> DataFrame:
    return posts.orderBy(F.desc("like_count"), "edge", "pos")
