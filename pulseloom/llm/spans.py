"""Places of regular-expression matches in texts, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from pulseloom.functions.once import bind

CHUNK = 64  # values that are accumulated at once


def accumulated(values: Column, combine: Callable[[Column, Column], Column] = lambda a, x: a + x, levels: int = 3) -> Column:
    """Of an array of integers, for each place what ``combine`` (associative) makes of all values up to there.

    An array grows by copies, so long ones are accumulated in chunks, and the chunks' ends in the same way: the work is in
    proportion to the length up to millions of values.
    """
    none = F.expr("cast(array() as array<int>)")

    def step(acc, x):
        now = F.when(acc["at"].isNull(), x).otherwise(combine(acc["at"], x)).cast("int")
        return F.struct(now.alias("at"), F.concat(acc["list"], F.array(now)).alias("list"))

    plain = lambda v: F.aggregate(v, F.struct(F.lit(None).cast("int").alias("at"), none.alias("list")), step, lambda acc: acc["list"])
    if not levels:
        return plain(values)

    def in_chunks(v):
        chunk = lambda c: plain(F.transform(F.sequence(c * CHUNK, F.least(F.size(v), (c + 1) * CHUNK) - 1), lambda i: F.get(v, i)))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), chunk)
        return bind(chunks, lambda parts: bind(
            accumulated(F.transform(parts, lambda p: F.element_at(p, -1)), combine, levels - 1),
            lambda ends: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(
                F.transform(p, lambda x: combine(F.get(ends, k - 1), x).cast("int")))))))

    return bind(values, lambda v: F.when(F.size(v) <= CHUNK, plain(v)).otherwise(in_chunks(v)))


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, end, value, before, after>>``.

    Places count code points, the end is exclusive; ``before`` and ``after`` are the texts between a match and its
    neighbours. ``pattern`` must not match the empty text. A text without a match (or null) gives an empty array, after
    a single look at it.
    """
    place = "struct<start:int,end:int,value:string,before:string,after:string>"
    none = F.expr(f"cast(array() as array<{place}>)")

    def places(gaps, matches):
        ends = accumulated(F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))
        return bind(ends, lambda e: F.transform(matches, lambda m, i: F.struct(
            (F.get(e, i) - F.length(m)).cast("int").alias("start"), F.get(e, i).alias("end"), m.alias("value"),
            F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))))

    all_ = bind(F.split(text, pattern, -1), lambda gaps: bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: places(gaps, matches)))
    return F.when(text.rlike(pattern), all_).otherwise(none)


def of_kind(places: Column, kind: str) -> Column:
    return F.transform(places, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def written(spans: Column) -> Column:
    """``kind:start:end`` for each of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, kinds: list[str], by_start: bool) -> Column:
    """Spans by start, then kind as listed (or the other way round)."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(
        (s["start"] if by_start else rank(s).cast("int")).alias("a"), (rank(s).cast("int") if by_start else s["start"]).alias("b"),
        s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])
