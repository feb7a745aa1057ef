"""Views and URL forms of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.functions import text as tx

# Base addresses and the host prefixes that may be cut off a post link.
BASE_URL = "https://old.reddit.com"
ITEM_URL = "https://news.ycombinator.com/item?id="
POST_HOST = "https://www.instagram.com"
HOST_PREFIX = r"^https?://(?:www\.)?instagram\.com"


def filled(x: Column) -> Column:
    """Null for the empty string: the JavaScript-style 'or' treats both as missing."""
    return F.nullif(x, F.lit(""))


def first_filled(*options: Column) -> Column:
    return F.coalesce(*[filled(o) for o in options], F.lit(""))


def post_view(df: DataFrame) -> DataFrame:
    """One shape for display out of the platforms' different field names; absent columns count as null."""
    col = lambda name, kind: (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
    text, number = (lambda n: col(n, "string")), (lambda n: col(n, "bigint"))
    views_text = F.when(filled(text("views_text")).isNotNull(), tx.digits(text("views_text")))
    return df.select(
        text("id").alias("id"), text("platform").alias("source"),
        first_filled(text("url"), text("permalink")).alias("url"),
        first_filled(text("body"), text("description"), text("text"), text("title"), text("caption")).alias("text"),
        filled(text("transcript")).alias("transcript"),
        F.coalesce(number("score"), number("points")).alias("score"),
        F.coalesce(number("views"), number("view_count"), views_text).alias("views"),
        F.coalesce(number("comments"), number("num_comments"), number("comment_count")).alias("comments"),
        F.coalesce(number("likes"), number("like_count")).alias("likes"),
        number("shares").alias("shares"),
    )


def absolute_url(path: Column, base: str = BASE_URL) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", None).when(path.startswith("http"), path).otherwise(
        F.concat(F.lit(base), path))


def canonical_post_url(href: Column, host: str = POST_HOST, host_prefix: str = HOST_PREFIX,
                       kinds: str = "p|reel") -> Column:
    """Absolute post URL without query and fragment; null unless it is a link to a post on the host."""
    path = F.regexp_replace(F.trim(href), r"[?#].*$", "")
    outside = path.rlike(r"^https?://") & ~path.rlike(host_prefix)
    local = F.regexp_replace(path, host_prefix, "")
    local = F.when(local.startswith("/"), local).otherwise(F.concat(F.lit("/"), local))
    shaped = F.concat(F.lit(host), F.regexp_replace(local, r"/+$", ""), F.lit("/"))
    return F.when(~outside & local.rlike(f"^/({kinds})/"), shaped)


def default_url(url: Column, native_id: Column, base: str = ITEM_URL) -> Column:
    return F.coalesce(filled(url), F.concat(F.lit(base), native_id))
