"""Search-interest payloads: one method, one payload, one error at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOPIC = "struct<mid:string, title:string, type:string>"
KEYWORD = f"struct<query:string, topic:{TOPIC}, value:bigint, formattedValue:string, link:string, hasData:boolean>"
POINT = "struct<time:string, formattedTime:string, formattedAxisTime:string, value:array<bigint>, hasData:array<boolean>>"
REGION = "struct<geoCode:string, geoName:string, value:array<bigint>, maxValueIndex:int, formattedValue:array<string>>"
ARTICLE = "struct<title:string, url:string, source:string, snippet:string>"
SEARCH = f"struct<title:struct<query:string>, formattedTraffic:string, relatedQueries:array<struct<query:string>>, shareUrl:string, articles:array<{ARTICLE}>>"
# The part of a payload each method reads.
SHAPES = {
    "autoComplete": f"default struct<topics:array<{TOPIC}>>",
    "interestOverTime": f"default struct<timelineData:array<{POINT}>, averages:array<bigint>>",
    "interestByRegion": f"default struct<geoMapData:array<{REGION}>>",
    "relatedQueries": f"default struct<rankedList:array<struct<rankedKeyword:array<{KEYWORD}>>>>",
    "relatedTopics": f"default struct<rankedList:array<struct<rankedKeyword:array<{KEYWORD}>>>>",
    "dailyTrends": f"default struct<trendingSearchesDays:array<struct<trendingSearches:array<{SEARCH}>>>>",
}


def body(raw: Column) -> Column:
    """The payload from its first bracket on: some begin with a guard against hijacking."""
    return F.regexp_replace(raw, r"^(?s)[^\[{]*(?=[\[{])", "")


def payload_error(method: Column, raw: Column) -> Column:
    """Why a payload gives no data, null when it does."""
    head = F.substring(raw, 1, 500)
    return (F.when(head.rlike(r"(?i)Error 429|rate.?limit"), "rate limited (HTTP 429)").when(raw.rlike(r"^\s*<"), "unexpected HTML response")
            .when(F.try_parse_json(body(raw)).isNull(), "failed to parse response").when(~method.isin(list(SHAPES)), "unknown method"))


def guard(payloads: DataFrame, method: str = "method", raw: str = "raw") -> DataFrame:
    return payloads.withColumn("error", payload_error(F.col(method), F.col(raw)))


def _read(payloads: DataFrame, keys: list[str], method: str) -> DataFrame:
    good = guard(payloads).filter(F.col("error").isNull() & (F.col("method") == method))
    return good.select(*keys, F.from_json(body(F.col("raw")), SHAPES[method])["default"].alias("d"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name.split(".")[-1])


def auto_complete(payloads: DataFrame, keys: list[str]) -> DataFrame:
    rows = _read(payloads, keys, "autoComplete").select(*keys, F.posexplode("d.topics").alias("pos", "t"))
    return rows.select(*keys, "pos", _text("t.mid"), _text("t.title"), _text("t.type"))


def interest_over_time(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """A time series row per keyword and point."""
    points = _read(payloads, keys, "interestOverTime").select(*keys, F.explode("d.timelineData").alias("p"))
    rows = points.select(*keys, "p", F.posexplode("p.value").alias("keyword_pos", "value"))
    return rows.select(*keys, "keyword_pos", F.timestamp_seconds(F.col("p.time").try_cast("bigint")).alias("ts"), _text("p.formattedTime"), "value",
                       F.get("p.hasData", F.col("keyword_pos")).alias("has_data"))



def interest_by_region(payloads: DataFrame, keys: list[str]) -> DataFrame:
    rows = _read(payloads, keys, "interestByRegion").select(*keys, F.posexplode("d.geoMapData").alias("pos", "r"))
    return rows.select(*keys, "pos", _text("r.geoCode"), _text("r.geoName"), F.coalesce("r.value", F.array().cast("array<bigint>")).alias("value"),
                       F.coalesce("r.maxValueIndex", F.lit(0)).alias("max_value_index"), F.coalesce("r.formattedValue", F.array().cast("array<string>")).alias("formatted_value"))


def ranked_keywords(payloads: DataFrame, keys: list[str], method: str = "relatedQueries") -> DataFrame:
    """Keywords of list 0 (top) and list 1 (rising)."""
    lists = _read(payloads, keys, method).select(*keys, F.posexplode("d.rankedList").alias("n", "l")).filter("n < 2")
    rows = lists.select(*keys, F.when(F.col("n") == 0, "top").otherwise("rising").alias("list"), F.posexplode("l.rankedKeyword").alias("pos", "k"))
    return rows.select(*keys, "list", "pos", "k.query", "k.topic", F.coalesce("k.value", F.lit(0).cast("bigint")).alias("value"), _text("k.formattedValue"),
                       "k.link", "k.hasData")


def daily_trends(payloads: DataFrame, keys: list[str]) -> DataFrame:
    from pulseloom.functions.text import digits
    days = _read(payloads, keys, "dailyTrends").select(*keys, F.posexplode("d.trendingSearchesDays").alias("day", "y"))
    rows = days.select(*keys, "day", F.posexplode("y.trendingSearches").alias("pos", "s"))
    none = F.array().cast("array<string>")
    return rows.select(*keys, "day", "pos", F.coalesce("s.title.query", F.lit("")).alias("title"), _text("s.formattedTraffic"),
                       digits(F.coalesce("s.formattedTraffic", F.lit(""))).alias("traffic"),
                       F.coalesce(F.transform("s.relatedQueries", lambda q: q["query"]), none).alias("related_queries"), "s.shareUrl",
                       F.coalesce("s.articles", F.from_json(F.lit("[]"), f"array<{ARTICLE}>")).alias("articles"))
