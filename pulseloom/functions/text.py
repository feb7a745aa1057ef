"""Text cleaning and shaping as column expressions."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from pulseloom import settings
from pulseloom.functions.once import bind

# Patterns in Java regex dialect.
TAG = r"<[^>]+>"
BOILERPLATE = (
    r"(?iU)edit\s*:\s*thanks?\s*(for|to)\s*(the\s+)?(awards?|gold|silver|platinum)"
    r"|\[deleted\]|\[removed\]|https?://\S+"
)
EMOJI = (
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{FE0F}]+"
)
# the same, met with the range that holds all of it: one comparison rules out a letter
RANGED_EMOJI = r"[\x{2190}-\x{1FAFF}&&" + EMOJI[:-1] + "]+"
# the first bytes in UTF-8 of all that EMOJI matches
EMOJI_BYTES = (b"\xf0\x9f", b"\xe2", b"\xef\xb8\x8f")
TAG_WORD = r"(?U)^\w+"
REPEATED_MARK = r"[!?.]+([!?.])"
BLANK = r"(?U)[\s\x1c-\x1f]+"
# the same for texts of single-byte characters, where a plain character class will do; the second pattern matches what is
# not yet a single blank, of which most texts hold little
PLAIN_BLANK = r"[\s\x1c-\x1f]+"
PLAIN_UNEVEN_BLANK = r"[\s\x1c-\x1f]{2,}|[\t-\r\x1c-\x1f]"
# so many words, the last of them cut; read no further than that
WORDS_BEFORE = r"(?U)\A[\s\x1c-\x1f]*+(?:[^\s\x1c-\x1f]++[\s\x1c-\x1f]++){%d}[^\s\x1c-\x1f]"


@pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_entities(text: Column) -> Column:
    """HTML5 entity decoding. Only rows holding ``&`` travel to Python; the others pass as null."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def is_plain(text: Column) -> Column:
    """As many bytes as characters: ASCII only."""
    return F.octet_length(text) == F.length(text)


def strip_tags(text: Column) -> Column:
    return bind(text, lambda t: F.when(F.contains(t, F.lit("<")), F.regexp_replace(t, TAG, " ")).otherwise(t))


def strip_boilerplate(text: Column) -> Column:
    def found(low: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(mark)) for mark in ("http", "edit", "[deleted]", "[removed]")])

    # every form holds a colon or a bracket; most texts have neither, and are not lower-cased
    marked = lambda t: F.contains(t, F.lit(":")) | F.contains(t, F.lit("["))
    return bind(text, lambda t: F.when(marked(t) & bind(F.lower(t), found), F.regexp_replace(t, BOILERPLATE, " ")).otherwise(t))


def strip_emoji(text: Column) -> Column:
    def found(raw: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(raw, F.lit(first)) for first in EMOJI_BYTES])

    return bind(text, lambda t: F.when(~is_plain(t) & bind(t.cast("binary"), found), F.regexp_replace(t, RANGED_EMOJI, " ")).otherwise(t))


def spell_hashtags(text: Column) -> Column:
    """``#AICodingTools`` becomes ``A I Coding Tools``; a ``#`` before anything but a word stays."""
    def spell(part: Column) -> Column:
        word = F.regexp_extract(part, TAG_WORD, 0)
        return F.when(word == "", F.concat(F.lit("#"), part)).otherwise(
            F.concat(F.regexp_replace(word, r"(?!^)(?=[A-Z])", " "), F.substr(part, F.length(word) + 1)))

    def joined(parts: Column) -> Column:
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), spell), ""))

    return bind(text, lambda t: F.when(F.contains(t, F.lit("#")), bind(F.split(t, "#"), joined)).otherwise(t))


def collapse_marks(text: Column) -> Column:
    return F.regexp_replace(text, REPEATED_MARK, "$1")


def collapse_blanks(text: Column) -> Column:
    return bind(text, lambda t: F.trim(F.when(is_plain(t), F.regexp_replace(t, PLAIN_UNEVEN_BLANK, " ")).otherwise(
        F.regexp_replace(t, BLANK, " "))))


def clean_text(raw: Column) -> Column:
    """All cleaning steps in their fixed order; null gives the empty string."""
    text = unescape_entities(F.coalesce(raw, F.lit("")))
    for step in (strip_tags, strip_boilerplate, strip_emoji, spell_hashtags, collapse_marks, collapse_blanks):
        text = step(text)
    return text


def compose(title: Column, body: Column) -> Column:
    return F.trim(F.concat(title, F.lit(". "), body))


def truncate(text: Column, limit: int, mark: str = "...") -> Column:
    return bind(text, lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(mark))).otherwise(t))


def quote(text: Column, limit: int = 280) -> Column:
    """A quote is cut, trimmed, and marked only when something was cut off."""
    cut = F.trim(F.substring(text, 1, limit))
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("..."))).otherwise(cut)


def words(text: Column) -> Column:
    return bind(text, lambda t: F.filter(F.when(is_plain(t), F.split(t, PLAIN_BLANK)).otherwise(F.split(t, BLANK)), lambda w: w != ""))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def has_words(text: Column, least: int) -> Column:
    """Whether a text has at least so many words, read no further than that."""
    return text.rlike(WORDS_BEFORE % (least - 1)) if least > 0 else text.isNotNull()


def digits(text: Column) -> Column:
    """The number formed by all digits of a text, 0 when there is none."""
    return F.coalesce(F.regexp_replace(text, r"[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def chunk_words(text: Column, size: int = 180, overlap: int = 30) -> Column:
    """Overlapping word chunks; a short text is its own single chunk, an empty one gives none."""
    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - overlap - 1, F.lit(0)), F.lit(size - overlap))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(F.size(w) <= size, F.array(text)).otherwise(pieces)

    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(bind(words(text), cut))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def embedding_input(title: Column, text: Column, limit: int | None = None) -> Column:
    """Title and text for an embedder; ``limit`` cuts them for one that takes no more characters."""
    has_title = F.coalesce(title, F.lit("")) != ""
    whole = F.when(has_title, F.concat_ws("\n", title, text)).otherwise(text)
    return whole if limit is None else F.substring(whole, 1, limit)


def post_line(index: Column, source: Column, subreddit: Column, channel: Column, score: Column,
              comments: Column, text: Column) -> Column:
    """One post of a prompt: its number, where it is from, and at most 500 characters of text."""
    as_text = lambda c: c.cast("string")
    where = (
        F.when(source == "reddit", F.concat(F.lit("[reddit] r/"), subreddit, F.lit(" | ↑"), as_text(score),
                                            F.lit(" | "), as_text(comments), F.lit(" comments")))
        .when(source == "youtube", F.concat(F.lit("[youtube] "), channel, F.lit(" | "), as_text(score),
                                            F.lit(" views")))
        .otherwise(F.concat(F.lit("["), source, F.lit("]")))
    )
    return F.concat(F.lit("Post "), as_text(index), F.lit(" "), where, F.lit(":\n"), truncate(text, 500), F.lit("\n"))


def normalize_topics(topics: Column, limit: int | None = None) -> Column:
    """Lower-case, collapse blanks, drop empties, keep the first of equals; the cap applies to the input."""
    kept = F.filter(topics, lambda t: F.trim(F.regexp_replace(t, BLANK, " ")) != "")
    if limit is not None:
        kept = F.slice(kept, 1, limit)
    return F.array_distinct(F.transform(kept, lambda t: collapse_blanks(F.lower(t))))


def clean_tag(tag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(tag, r"^#+", ""), r"(?U)^\s+|\s+$", "")


def normalize_tags(tags: Column) -> Column:
    """Tag list without leading '#', blanks, empties and repeats, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: clean_tag(t)), lambda t: t != ""))


def split_tags(csv: Column) -> Column:
    return normalize_tags(F.transform(F.split(csv, ","), lambda t: F.trim(t)))


def signal_text(entity: Column, pain: Column, request: Column, summary: Column) -> Column:
    filled = F.concat_ws(" | ", *[F.when(c != "", c) for c in (entity, pain, request, summary)])
    return F.when(filled == "", F.lit("unknown signal")).otherwise(filled)


def signal_id(text: Column) -> Column:
    return F.concat(F.lit("sig_"), F.substring(F.sha2(text, 256), 1, 12))


def topic_id(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(text)), 256)


def platform_hash(platform: Column, platform_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", platform, platform_id), 256)


def author_id(css_classes: Column) -> Column:
    found = F.regexp_extract(css_classes, r"id-(t2_[A-Za-z0-9]+)", 1)
    return F.when(found != "", found)


def bare_post_id(fullname: Column) -> Column:
    return F.regexp_replace(fullname, r"^t3_", "")


def bare_subreddit(label: Column) -> Column:
    return F.regexp_replace(label, r"^r/", "")
