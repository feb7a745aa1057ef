"""JSON replies and payload fragments, read leniently with the variant type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulseloom.functions.scores import clamp01

# Intents a reply may carry.
VALID_INTENTS = ["topic", "shopping", "news", "learning", "brand"]
NUMERIC_TYPES = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def field(doc: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, path, kind)


def text_field(doc: Column, path: str, default: str = "") -> Column:
    return F.coalesce(field(doc, path), F.lit(default))


def kind_of(doc: Column, path: str = "$") -> Column:
    """Upper-case type name of a fragment, null when absent."""
    return F.schema_of_variant(field(doc, path, "variant"))


def unfence(reply: Column) -> Column:
    """The inside of the first code fence, or the whole trimmed reply."""
    fence = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
    inside = F.trim(F.regexp_extract(reply, fence, 1))
    return F.when(reply.rlike(fence), inside).otherwise(F.trim(reply))


def reply_document(reply: Column) -> Column:
    """The reply's JSON; of a list its first element, of an empty list an empty object; null if unreadable."""
    body = unfence(reply)
    doc = F.try_parse_json(body)
    first = F.coalesce(field(doc, "$[0]", "variant"), F.parse_json(F.lit("{}")))
    return F.when(kind_of(doc).startswith("ARRAY"), first).otherwise(doc)


def braces(reply: Column) -> Column:
    """From the first '{' to the last '}'."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def string_list(doc: Column, path: str) -> Column:
    """The strings of a JSON array; other elements are left out, a missing array is empty."""
    items = field(doc, path, "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: v.cast("string")), F.array().cast("array<string>"))


def intent_reply(reply: Column, query: Column, intents: list[str] = VALID_INTENTS) -> Column:
    """Validated intent record; the fallback record when the reply cannot be read."""
    doc = F.try_parse_json(braces(reply))
    intent, category = field(doc, "$.intent"), F.trim(field(doc, "$.category"))
    confidence = F.when(kind_of(doc, "$.confidence").rlike(NUMERIC_TYPES), field(doc, "$.confidence", "double"))
    read = F.struct(
        query.alias("original_query"),
        F.when((kind_of(doc, "$.category") == "STRING") & (category != ""), category)
        .otherwise("General").alias("category"),
        F.when(intent.isin(intents), intent).otherwise("topic").alias("intent"),
        F.coalesce(clamp01(confidence), F.lit(0.5)).alias("confidence"),
    )
    fallback = F.struct(query.alias("original_query"), F.lit("General").alias("category"),
                        F.lit("topic").alias("intent"), F.lit(0.3).alias("confidence"))
    return F.when(doc.isNotNull(), read).otherwise(fallback)


def subtopic_reply(reply: Column) -> Column:
    return string_list(F.try_parse_json(braces(reply)), "$.subtopics")


def topics_reply(reply: Column) -> Column:
    return string_list(F.try_parse_json(braces(reply)), "$.topics")
