"""Search pages and listing payloads of the link-sharing platform."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.functions import text as tx
from pulseloom.functions.pages import parsed
from pulseloom.operators.projections import absolute_url

VOID = {"img", "br", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
# The classes a search page marks its parts with.
POST, GROUP, LABEL, NEXT = "search-result-link", "search-result-group", "search-header-label", "nextprev"
FIRST_TEXT = {"search-title": "title", "search-subreddit-link": "subreddit", "linkflairlabel": "flair"}
ALL_TEXT = {"search-score": "score", "search-comments": "comments", "search-result-body": "body", "duration-overlay": "duration"}
RAW = ["fullname", "title", "title_href", "author", "author_href", "author_class", "subreddit", "subreddit_href", "score", "comments", "time",
       "time_text", "body", "flair", "flair_title", "flair_style", "thumb", "thumb_class", "src", "width", "height", "duration"]


class SearchPage(HTMLParser):
    """Marked parts of one search page: raw texts and attributes per post, and the link to the next page of posts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.posts: list[dict] = []
        self.next_href: str | None = None
        self._open: list[tuple[str, set]] = []
        self._taking: list[tuple[int, dict, str]] = []   # (depth, target, field) that text goes to
        self._post: tuple[int, dict] | None = None
        self._group: tuple[int, dict] | None = None

    def _inside(self, name: str) -> bool:
        return any(name in classes for _, classes in self._open)

    def _take(self, target: dict, field: str, void: bool) -> None:
        target.setdefault(field, "")
        if not void:
            self._taking.append((len(self._open), target, field))

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        void = tag in VOID
        if GROUP in classes and self._group is None:
            self._group = (len(self._open), {})
        if POST in classes and self._post is None:
            post = {"fullname": a.get("data-fullname")}
            self.posts.append(post)
            self._post = (len(self._open), post)
        elif self._post is not None:
            self._part(self._post[1], tag, a, classes, void)
        if self._group is not None:
            group = self._group[1]
            if LABEL in classes and "label" not in group:
                self._take(group, "label", void)
            if tag == "a" and a.get("rel") == "nofollow next" and self._inside(NEXT) and "next" not in group:
                group["next"] = a.get("href")
        if not void:
            self._open.append((tag, classes))

    def _part(self, post, tag, a, classes, void):
        for name, field in FIRST_TEXT.items():
            if name in classes and field not in post:
                self._take(post, field, void)
                post[f"{field}_href"], post[f"{field}_title"], post[f"{field}_style"] = a.get("href"), a.get("title"), a.get("style")
        for name, field in ALL_TEXT.items():
            if name in classes and (field != "duration" or self._inside("thumbnail")):
                self._take(post, field, void)
        if tag == "a" and "author" not in post and self._inside("search-author"):
            self._take(post, "author", void)
            post["author_href"], post["author_class"] = a.get("href"), a.get("class")
        if tag == "time" and "time_text" not in post:
            self._take(post, "time_text", void)
            post["time"] = a.get("datetime")
        if "thumbnail" in classes and "thumb" not in post:
            post["thumb"], post["thumb_class"] = "1", a.get("class")
        if tag == "img" and "src" not in post and self._inside("thumbnail"):
            post["src"], post["width"], post["height"] = a.get("src"), a.get("width"), a.get("height")

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i][0] == tag), None)
        if depth is None:
            return
        del self._open[depth:]
        self._taking = [t for t in self._taking if t[0] < depth]
        if self._post and depth <= self._post[0]:
            self._post = None
        if self._group and depth <= self._group[0]:
            group, self._group = self._group[1], None
            label = re.sub(r"\s+", " ", group.get("label", "")).strip().lower()
            if label == "posts" and self.next_href is None:
                self.next_href = group.get("next") or ""

    def handle_data(self, data):
        for _, target, field in self._taking:
            target[field] += data


def _pages(df: DataFrame, keys: list[str], html: str, fields: list[str], rows_of) -> DataFrame:
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema] + [f"{c} string" for c in fields] + ["rank int"])

    def found(key, text):
        page = SearchPage()
        page.feed(text or "")
        page.close()
        return ((*key, *[row.get(c) for c in fields], i + 1) for i, row in enumerate(rows_of(page)))

    return parsed(df, keys, html, schema, found)


def search_posts(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Post rows of landed search pages, ranked within each page. Python only cuts the page; the fields are shaped here."""
    c = F.col
    raw = _pages(pages, keys, html, RAW, lambda page: page.posts)
    tidy = lambda name: tx.collapse_blanks(F.coalesce(name, F.lit("")))
    given = lambda name: F.nullif(F.trim(c(name)), F.lit(""))
    url = lambda name: absolute_url(F.trim(c(name)))
    size = lambda name: F.nullif(c(name).try_cast("int"), F.lit(0))
    return raw.select(
        *keys, "rank", F.coalesce(given("fullname"), F.lit("")).alias("fullname"),
        tx.bare_post_id(F.coalesce(given("fullname"), F.lit(""))).alias("postId"), tidy("title").alias("title"), tidy("body").alias("body"),
        F.coalesce(url("title_href"), F.lit("")).alias("permalink"), tidy("author").alias("author"), url("author_href").alias("authorUrl"),
        tx.author_id(c("author_class")).alias("authorId"), tx.bare_subreddit(tidy("subreddit")).alias("subreddit"),
        url("subreddit_href").alias("subredditUrl"), tx.digits(tidy("score")).alias("score"), tx.digits(tidy("comments")).alias("comments"),
        given("time").alias("createdIso"), tidy("time_text").alias("createdText"), tidy("flair").alias("flair"), given("flair_title").alias("flairTitle"),
        given("flair_style").alias("flairStyle"), given("src").alias("thumbnail"), size("width").alias("thumbnailWidth"), size("height").alias("thumbnailHeight"),
        F.nullif(tidy("duration"), F.lit("")).alias("duration"), c("thumb").isNotNull().alias("hasThumbnail"), c("flair").isNotNull().alias("hasFlair"),
        F.coalesce(c("thumb_class").rlike(r"(^|\s)self(\s|$)"), F.lit(False)).alias("isSelf"))


def url_parameter(url: Column, name: str) -> Column:
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def cursor(href: Column) -> list[Column]:
    """``after``, ``count`` and whether there is a next page, from a next-page link."""
    full = absolute_url(href)
    after = url_parameter(full, "after")
    return [after.alias("after"), url_parameter(full, "count").try_cast("bigint").alias("count"),
            (F.coalesce(after, F.lit("")) != "").alias("has_next")]


def next_pages(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    found = _pages(pages, keys, html, ["href"], lambda page: [{"href": page.next_href}])
    return found.select(*keys, *cursor(F.col("href")))


LISTING = "data struct<after:string, children:array<struct<data:struct<id:string, title:string, body:string, author:string, score:bigint>>>>"


def listing_rows(pages: DataFrame, keys: list[str], kind: str, payload: str = "payload") -> DataFrame:
    """Children of listing pages; ``kind`` names what they are (post, comment)."""
    parsed = pages.select(*keys, F.from_json(payload, LISTING).alias("_p"))
    return parsed.select(*keys, F.lit(kind).alias("kind"), F.posexplode("_p.data.children").alias("pos", "_c")).select(*keys, "kind", "pos", "_c.data.*")
