"""Predicates and orderings over post tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom import settings
from pulseloom.functions import text as tx
from pulseloom.functions.language import detect_language
from pulseloom.functions.moments import duration_seconds

# Seconds of the relative time windows ("all" has none).
WINDOW_SECONDS = {"hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
# Presets as (tag, least points, least comments, newest first).
PRESETS = {
    "stories": ("story", None, None, False),
    "comments": ("comment", None, None, False),
    "ask": ("ask_hn", None, None, False),
    "show": ("show_hn", None, None, False),
    "latest": ("story", None, None, True),
    "high_engagement": ("story", 100, 50, False),
}


def within(df: DataFrame, column: str, lowest=None, highest=None) -> DataFrame:
    """Inclusive range; an open end is not checked."""
    if lowest is not None:
        df = df.filter(F.col(column) >= lowest)
    if highest is not None:
        df = df.filter(F.col(column) <= highest)
    return df


def by_author(df: DataFrame, author: str, column: str = "author") -> DataFrame:
    return df.filter(F.col(column) == author)


def between_moments(df: DataFrame, after_s: float | None, before_s: float | None, column: str = "created_s") -> DataFrame:
    """Both bounds are whole epoch seconds and excluded."""
    if after_s is not None:
        df = df.filter(F.col(column) > int(after_s // 1))
    if before_s is not None:
        df = df.filter(F.col(column) < int(before_s // 1))
    return df


def mentions(term: str, attributes: list[str]) -> Column:
    """The term occurs in any of the attributes, whatever the case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(term.lower())) for c in attributes])


def text_query(query: str, attributes: list[str], exact: bool = False) -> Column:
    """All words must occur, unless the query joins them with AND / OR itself."""
    if exact:
        return mentions(query, attributes)
    either = re.split(r"\s+OR\s+", query.strip(), flags=re.IGNORECASE)
    groups = [[w for w in part.split() if w.upper() != "AND"] for part in either]
    every = [reduce(lambda a, b: a & b, [mentions(w, attributes) for w in words]) for words in groups if words]
    return reduce(lambda a, b: a | b, every) if every else F.lit(True)


def with_all_tags(tags: list[str], column: str = "tags") -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(column, t) for t in tags], F.lit(True))


def preset_test(name: str, query: str | None = None, attributes: list[str] | None = None,
                points: str = "points", comments: str = "comments") -> Column:
    """A preset as a condition, so that several can be told in one pass."""
    tag, least_points, least_comments, _ = PRESETS[name]
    test = with_all_tags([tag])
    for column, least in ((points, least_points), (comments, least_comments)):
        if least is not None:
            test = test & (F.col(column) >= least)
    return test & text_query(query, attributes or ["title"]) if query else test


def preset(df: DataFrame, name: str, query: str | None = None, attributes: list[str] | None = None,
           points: str = "points", comments: str = "comments", created: str = "created_s", id_col: str = "id") -> DataFrame:
    kept = df.filter(preset_test(name, query, attributes, points, comments))
    return kept.orderBy(F.desc(created), id_col) if PRESETS[name][3] else kept


def sort_order(mode: str, id_col: str = "id") -> list[Column]:
    """Modes relevance, hot, top, new (or date) and comments; ties go to the smaller id."""
    column = {"relevance": "relevance_score", "hot": "engagement", "top": "score", "new": "created_s",
              "date": "created_s", "comments": "comments"}[mode]
    return [F.desc(column), F.col(id_col)]


def sort_posts(df: DataFrame, mode: str, id_col: str = "id") -> DataFrame:
    return df.orderBy(*sort_order(mode, id_col))


def in_window(window: str, as_of_s: int, column: str = "created_s") -> Column:
    return F.lit(True) if window == "all" else F.col(column) >= as_of_s - WINDOW_SECONDS[window]


def recent(df: DataFrame, window: str, as_of_s: int, column: str = "created_s") -> DataFrame:
    return df.filter(in_window(window, as_of_s, column))


def duration_bucket(duration: Column) -> Column:
    seconds = duration_seconds(duration)
    return (F.when(seconds < 240, "Under 4 minutes").when(seconds <= 1200, "4 - 20 minutes")
            .when(seconds > 1200, "Over 20 minutes"))


def default_harvest(df: DataFrame, as_of_s: int, days: int = 30, least_points: int = 2, points: str = "score") -> DataFrame:
    return within(between_moments(df, as_of_s - days * 86400, None), points, least_points)


def not_a_bot(author: Column) -> Column:
    return ~F.coalesce(author, F.lit("")).isin(settings.BOT_AUTHORS)


def not_deleted(*texts: Column) -> Column:
    return reduce(lambda a, b: a & b, [~t.isin(settings.DELETED_MARKERS) for t in texts])


def enough_words(text: Column, least: int = settings.MIN_WORDS) -> Column:
    return tx.has_words(text, least)


def enough_views(views: Column, least: int = settings.MIN_VIDEO_VIEWS) -> Column:
    return views >= least


def in_language(text: Column, language: str = settings.TARGET_LANGUAGE) -> Column:
    return F.coalesce(detect_language(text) == language, F.lit(False))


def score_or_anomaly(score: Column, anomaly: Column, least: float, exempt: bool = True) -> Column:
    """A least score of zero or below keeps everything."""
    if least <= 0:
        return F.lit(True)
    return (score >= least) | anomaly if exempt else score >= least


def keep_entries(entries: str, least: float, exempt: bool = True) -> Column:
    """The same rule for an array of entries with ``score`` and ``is_anomaly``."""
    return F.filter(entries, lambda e: score_or_anomaly(e["score"], e["is_anomaly"], least, exempt))


def known_ids(df: DataFrame, store: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id the store already has."""
    return df.join(store.select(id_col).distinct(), id_col, "left_semi")


def where_select(df: DataFrame, condition: Column | str, columns: list[str] | None = None) -> DataFrame:
    kept = df.filter(condition)
    return kept.select(*columns) if columns else kept
