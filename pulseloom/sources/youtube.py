"""Pages and search payloads of the video platform."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.functions.documents import field, text_field
from pulseloom.functions.pages import parsed

# Where a page keeps its data, tried in this order.
PAGE_DATA = [
    r"(?s)var ytInitialData\s*=\s*(\{.+?\});</script>",
    r'(?s)ytInitialData"\]\s*=\s*(\{.+?\});',
    r"(?s)ytInitialData\s*=\s*(\{.+?\})\s*;\s*</script>",
]


def page_data(html: Column) -> Column:
    """The page's embedded JSON text: of the first pattern whose match can be read. Null when there is none."""
    found = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in PAGE_DATA]
    return F.coalesce(*[F.when(F.try_parse_json(f).isNotNull(), f) for f in found])


def _walk(node, wanted: tuple[str, ...]) -> Iterator[tuple[str, object]]:
    """Objects under the wanted keys at any depth, each before what it contains."""
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, list):
            stack.extend(reversed(at))
        elif isinstance(at, dict):
            yield from ((k, at[k]) for k in wanted if at.get(k))
            stack.extend(v for v in reversed(list(at.values())) if isinstance(v, (dict, list)))


def find_renderers(pages: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """Video and continuation records of JSON trees: keys, kind, pos, record (JSON text). JSON paths cannot search at any depth."""
    names = ("videoRenderer", "continuationItemRenderer")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*keys).schema] + ["kind string", "pos int", "record string"])

    def found(key, text):
        try:
            tree = json.loads(text)
        except (TypeError, ValueError):
            return
        for i, (kind, record) in enumerate(_walk(tree, names)):
            yield (*key, kind, i, json.dumps(record, ensure_ascii=False))

    return parsed(pages, keys, data, schema, found)


def run_text(doc: Column, path: str) -> Column:
    """A text node: its simple text, else its runs joined."""
    runs = field(doc, f"{path}.runs", "array<variant>")
    joined = F.array_join(F.transform(runs, lambda r: text_field(r, "$.text")), "")
    return F.coalesce(field(doc, f"{path}.simpleText"), joined, F.lit(""))


def videos(renderers: DataFrame, keys: list[str]) -> DataFrame:
    """Video rows out of video records; records without an id are left out."""
    df = renderers.filter("kind = 'videoRenderer'").select(*keys, "pos", F.try_parse_json("record").alias("v"))
    v = F.col("v")
    some = lambda x: F.nullif(x, F.lit(""))
    vid = some(field(v, "$.videoId"))
    end = "navigationEndpoint.browseEndpoint"
    channel_id = text_field(v, f"$.ownerText.runs[0].{end}.browseId")
    canonical = F.coalesce(field(v, f"$.ownerText.runs[0].{end}.canonicalBaseUrl"), field(v, f"$.longBylineText.runs[0].{end}.canonicalBaseUrl"))
    thumbs = field(v, "$.thumbnail.thumbnails", "array<variant>")
    badges = F.transform(field(v, "$.badges", "array<variant>"), lambda b: text_field(b, "$.metadataBadgeRenderer.label"))
    owner = F.exists(field(v, "$.ownerBadges", "array<variant>"), lambda b: F.contains(text_field(b, "$.metadataBadgeRenderer.style"), F.lit("VERIFIED")))
    site = F.lit("https://www.youtube.com")
    return df.filter(vid.isNotNull()).select(
        *keys, "pos", vid.alias("id"), run_text(v, "$.title").alias("title"), some(run_text(v, "$.detailedMetadataSnippets[0].snippetText")).alias("description"),
        channel_id.alias("channelId"), F.coalesce(some(run_text(v, "$.ownerText")), run_text(v, "$.longBylineText")).alias("channelName"),
        run_text(v, "$.publishedTimeText").alias("publishedText"), some(run_text(v, "$.lengthText")).alias("duration"), run_text(v, "$.viewCountText").alias("viewsText"),
        F.coalesce(text_field(F.try_element_at(thumbs, F.lit(-1)), "$.url"), F.lit("")).alias("thumbnail"),
        F.coalesce(F.filter(badges, lambda b: b != ""), F.array().cast("array<string>")).alias("badges"), F.coalesce(owner, F.lit(False)).alias("verified"),
        F.concat(site, F.lit("/watch?v="), vid).alias("url"), F.concat(F.lit("https://youtu.be/"), vid).alias("shortUrl"), F.concat(site, F.lit("/embed/"), vid).alias("embedUrl"),
        F.when(canonical.isNotNull(), F.concat(site, canonical)).when(channel_id != "", F.concat(site, F.lit("/channel/"), channel_id)).otherwise("").alias("channelUrl"))


def continuations(renderers: DataFrame, keys: list[str]) -> DataFrame:
    """The last continuation token of every page."""
    token = F.nullif(field(F.try_parse_json("record"), "$.continuationEndpoint.continuationCommand.token"), F.lit(""))
    found = renderers.filter("kind = 'continuationItemRenderer'").select(*keys, "pos", token.alias("token")).filter("token is not null")
    return found.groupBy(*keys).agg(F.max_by("token", "pos").alias("continuation"))
