"""Nested collection documents and stored harvest rows as flat post rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseloom import schemas, settings
from pulseloom.operators.ranking import top_n


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """One row per collection file, named by its session (the file's name)."""
    df = spark.read.schema(schemas.COLLECTION).option("multiLine", True).json(path)
    return df.withColumn("session_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1))


def parse_collection(text: Column) -> Column:
    return F.from_json(text, schemas.COLLECTION)


def with_defaults(df: DataFrame, fields: str) -> DataFrame:
    """Every field present: empty text, zero, false or an empty list where the input has none."""
    empty = {"string": F.lit(""), "bigint": F.lit(0).cast("bigint"), "int": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False),
             "array<string>": F.array().cast("array<string>")}
    for part in schemas._split(fields):
        name, kind = part.strip().split(" ", 1)
        value = F.coalesce(F.col(name), empty[kind]) if name in df.columns else empty[kind]
        df = df.withColumn(name, value)
    return df


def flatten(collections: DataFrame) -> dict[str, DataFrame]:
    """Posts per platform with their query, its place, the platform's place and their own place."""
    results = collections.select("session_id", F.posexplode("results").alias("query_ord", "_r"))
    out = {}
    for ordinal, platform in enumerate(settings.PLATFORMS):
        posts = results.select("session_id", F.col("_r.query").alias("query"), "query_ord", F.lit(ordinal).alias("platform_ord"),
                               F.posexplode(f"_r.{platform}").alias("pos", "_p"))
        flat = posts.select("session_id", "query", "query_ord", "platform_ord", "pos", "_p.*")
        out[platform] = with_defaults(flat, schemas.PLATFORM_POSTS[platform])
    return out


def session_harvest(harvest: DataFrame, session_id) -> DataFrame:
    return harvest.filter(F.col("session_id") == session_id).orderBy("collected_at")


def json_rows(df: DataFrame, column: str, element: str) -> DataFrame:
    """A JSON text column as typed rows; ``element`` is the type of one array element."""
    return df.withColumn("_items", F.from_json(column, f"array<{element}>")).select(
        *[c for c in df.columns if c != column], F.posexplode("_items").alias("pos", "item"))


def regroup(harvest: DataFrame, *, platforms: list[str] = settings.PLATFORMS, tie: str = "id") -> DataFrame:
    """One row per session and query with the last harvested JSON text of each platform."""
    last = F.max_by("result_json", F.struct("collected_at", tie))
    return harvest.groupBy("session_id", "query").pivot("platform", platforms).agg(last)


def regroup_appended(harvest: DataFrame, element: str) -> DataFrame:
    """The same with every harvest kept: the items of a session, query and platform as rows, in harvest order.

    They stay rows; what a query has gathered on a platform over time may be too much for one value.
    """
    items = json_rows(harvest.select("session_id", "query", "platform", "collected_at", "id", "result_json"), "result_json", element)
    return items.withColumnRenamed("pos", "place")


def store_harvest(found: DataFrame, tag: Column, url: Column, order: list[str]) -> DataFrame:
    """Usable URLs per tag, each where it was first seen."""
    rows = found.withColumn("_tag", tag).withColumn("_url", url).filter(F.col("_url").isNotNull())
    return top_n(rows, 1, ["_tag", "_url"], order, "_rank").select(F.col("_tag").alias("tag"), F.col("_url").alias("url"), *order)


def harvest_summary(stored: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: tags, stored and distinct URLs, and the failed tags (a short list by nature: one entry per tag asked for)."""
    totals = stored.groupBy("tag").agg(F.count("*").alias("_n")).agg(F.count("*").alias("total_hashtags"), F.sum("_n").alias("total_posts"))
    distinct = stored.select("url").distinct().agg(F.count("*").alias("unique_posts"))
    lost = failed.agg(F.sort_array(F.collect_set("tag")).alias("failed_hashtags"))
    return totals.withColumn("_k", F.lit(1)).join(distinct.withColumn("_k", F.lit(1)), "_k").join(lost.withColumn("_k", F.lit(1)), "_k").drop("_k")
