"""Queries: parsing landed payloads, storing results. Payloads are made from the given tables, so their content is known."""

from pyspark.sql import functions as F

from pulseloom import schemas, settings
from pulseloom.functions import text as tx
from pulseloom.operators.projections import canonical_post_url
from pulseloom.plans.adapters import AS_OF_SECONDS
from pulseloom.plans.q_filters import platform_frames
from pulseloom.plans.q_text import as_of
from pulseloom.plans.registry import query
from pulseloom.session import ensure_checkpoint_dir, stored
from pulseloom.sources import collection as cn, hackernews as hn, instagram as ig, reddit as rd, sinks as sk, trends as tr, youtube as yt

c = F.col


def collections(t):
    """Posts packed as one nested document per session, the way a harvest lands."""
    frames = platform_frames(t.posts)
    rows = None
    for name, df in frames.items():
        fields = [f.strip().split(" ")[0] for f in schemas._split(schemas.PLATFORM_POSTS[name])]
        packed = df.groupBy("session_id", "query", "query_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct(
            "pos", F.struct(*[x for x in fields if x in df.columns]).alias("p")))), lambda x: x["p"]).alias(name))
        rows = packed if rows is None else rows.join(packed, ["session_id", "query", "query_ord"], "full")
    results = F.array_sort(F.collect_list(F.struct("query_ord", F.struct("query", *settings.PLATFORMS).alias("r"))))
    return rows.groupBy("session_id").agg(F.to_json(F.struct(F.lit("seed").alias("seed"), F.transform(results, lambda x: x["r"]).alias("results"))).alias("payload"))


@query("src_01_collection", "select session_id, count(distinct query) as queries, 'seed' as seed from @posts group by session_id")
def collection(t):
    doc = collections(t).select("session_id", cn.parse_collection(c("payload")).alias("d"))
    return doc.select("session_id", F.size("d.results").cast("bigint").alias("queries"), "d.seed")


@query("src_02_defaults", "select concat('d', cast(doc_id as string)) as id, '' as permalink, cast(0 as bigint) as score, false as verified from documents")
def defaults(t):
    bare = t.documents.select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("id"))
    return cn.with_defaults(bare, "id string, permalink string, score bigint, verified boolean")


@query("src_03_flatten", "select session_id, query, platform_ord, native_id, title, score from @posts")
def flatten(t):
    docs = collections(t).select("session_id", cn.parse_collection(c("payload")).alias("d")).select("session_id", "d.results")
    parts = cn.flatten(docs)
    ids = {"reddit": ("postId", "title", c("score")), "youtube": ("id", "title", tx.digits(c("viewsText"))), "hackerNews": ("id", "title", c("points")),
           "instagram": ("pk", "caption", c("like_count"))}
    out = None
    for name, (i, title, score) in ids.items():
        part = parts[name].select("session_id", "query", c("platform_ord").cast("bigint").alias("platform_ord"), c(i).alias("native_id"), c(title).alias("title"), score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("src_04_session_harvest", "select session_id, query, line from @harvest where session_id = 5979")
def session_harvest(t):
    return cn.session_harvest(t.harvest, 5979).select("session_id", "query", "line")


@query("src_05_json_rows", "select event_id, 0 as pos, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_rows(t):
    packed = t.events.select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("result_json"))
    return cn.json_rows(packed, "result_json", "struct<k:bigint>").select("event_id", "pos", "item.k")


def stored_harvest(t):
    return t.harvest.withColumn("id", F.concat_ws("-", *[c(x).cast("string") for x in ("line", "topic_id", "l_suppkey")])).withColumn(
        "result_json", F.to_json(F.array(F.struct(c("topic_id").alias("n")), F.struct(c("line").cast("bigint").alias("n")))))


HARVEST_ID = "concat(cast(line as string), '-', cast(topic_id as string), '-', cast(l_suppkey as string))"


@query("src_06_regroup", f"""
    with h as (select *, row_number() over (partition by session_id, query, platform order by collected_at desc, {HARVEST_ID} desc) as rn from @harvest)
    select session_id, query, max(case when platform = 'reddit' then concat('[{{"n":', topic_id, '}},{{"n":', line, '}}]') end) as reddit,
           max(case when platform = 'youtube' then concat('[{{"n":', topic_id, '}},{{"n":', line, '}}]') end) as youtube,
           max(case when platform = 'hackerNews' then concat('[{{"n":', topic_id, '}},{{"n":', line, '}}]') end) as hackernews
    from h where rn = 1 group by session_id, query""")
def regroup(t):
    return cn.regroup(stored_harvest(t), platforms=["reddit", "youtube", "hackerNews"]).withColumnRenamed("hackerNews", "hackernews")


@query("src_06_regroup_appended", """
    select session_id, query, platform, line, n from (select session_id, query, platform, line, topic_id as n from @harvest union all select session_id, query, platform, line, line from @harvest)""")
def regroup_appended(t):
    rows = cn.regroup_appended(stored_harvest(t), "struct<n:bigint>")
    return rows.select("session_id", "query", "platform", F.split("id", "-")[0].cast("int").alias("line"), "item.n")


def search_pages(t):
    """Search pages of ten documents each."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    s = lambda x: c(x).cast("string")
    post = F.concat(
        F.lit('<div class="thing search-result-link" data-fullname="t3_'), "native_id", F.lit('"><a class="thumbnail self" href="#"><img src="t.png" width="70" height="0"></a>'
              '<header><span class="linkflairlabel" title="Flair">News <b>now</b></span><a href="/r/sub/'), "native_id", F.lit('" class="search-title may-blank">'), esc(c("title")),
        F.lit('</a></header><span class="search-score">'), s("score"), F.lit(' points</span> <a class="search-comments">'), s("comments"),
        F.lit(' comments</a><time datetime="'), "created_day", F.lit('T00:00:00+00:00">ago</time><span class="search-author">by <a class="author id-t2_'), "author",
        F.lit('" href="/user/'), "author", F.lit('">'), "author", F.lit('</a></span><a class="search-subreddit-link" href="/r/sub">r/sub</a><div class="search-result-body"><p>'),
        esc(c("body")), F.lit("</p></div></div>"))
    p = t.posts.withColumn("page", F.floor(c("doc_id") / 10)).select("page", "doc_id", post.alias("post"))
    joined = p.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "post"))), lambda x: x["post"]), "<br>").alias("posts"))
    return joined.select("page", F.concat(
        F.lit('<html><body><div class="search-result-group"><header><span class="search-header-label">communities</span></header><span class="nextprev"><a rel="nofollow next" href="/x?after=no">n</a></span></div>'
              '<div class="search-result-group"><header><span class="search-header-label"> Posts </span></header>'), "posts",
        F.lit('<span class="nextprev"><a rel="nofollow next" href="/search?count='), F.col("page").cast("string"), F.lit('&amp;after=t3_'), F.col("page").cast("string"),
        F.lit('">next</a></span></div></body></html>')).alias("html"))


@query("src_07_search_posts", r"""
    select cast(floor(doc_id / 10) as bigint) as page, native_id as "postId", trim(regexp_replace(title, '\s+', ' ', 'g')) as title, trim(regexp_replace(body, '\s+', ' ', 'g')) as body,
        concat('https://old.reddit.com/r/sub/', native_id) as permalink, author, concat('t2_', author) as "authorId", 'sub' as subreddit, score, comments, 'News now' as flair, true as "isSelf",
        70 as "thumbnailWidth", cast(row_number() over (partition by floor(doc_id / 10) order by doc_id) as integer) as rank from @posts""")
def search_posts(t):
    return rd.search_posts(search_pages(t), ["page"]).select("page", "postId", "title", "body", "permalink", "author", "authorId", "subreddit", "score", "comments",
                                                            "flair", "isSelf", "thumbnailWidth", "rank")


@query("src_08_next_page", "select distinct cast(floor(doc_id / 10) as bigint) as page, concat('t3_', cast(floor(doc_id / 10) as bigint)) as after, cast(floor(doc_id / 10) as bigint) as count, true as has_next from @posts")
def next_page(t):
    return rd.next_pages(search_pages(t), ["page"])


@query("src_08_url_parameters", "select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') as ref from pages")
def url_parameters(t):
    return t.pages.select("page_id", rd.url_parameter(c("url"), "page").alias("page"), rd.url_parameter(c("url"), "ref").alias("ref"))


def video_pages(t):
    d = t.documents
    video = F.struct(F.concat(F.lit("v"), c("doc_id").cast("string")).alias("videoId"), F.struct(F.array(F.struct(F.col("text").alias("text")), F.struct(c("lang").alias("text"))).alias("runs")).alias("title"),
                     F.struct(F.concat(c("n_chars").cast("string"), F.lit(" views")).alias("simpleText")).alias("viewCountText"),
                     F.struct(F.array(F.struct(c("source").alias("text"), F.struct(F.struct(c("lang").alias("browseId")).alias("browseEndpoint")).alias("navigationEndpoint"))).alias("runs")).alias("ownerText"),
                     F.array(F.struct(F.struct(F.when(c("doc_id") % 2 == 0, "BADGE_VERIFIED").otherwise("X").alias("style")).alias("metadataBadgeRenderer"))).alias("ownerBadges"),
                     F.struct(F.array(F.struct(F.lit("a").alias("url")), F.struct(c("source").alias("url"))).alias("thumbnails")).alias("thumbnail"))
    tree = F.struct(F.struct(F.array(F.struct(F.struct(video.alias("videoRenderer")).alias("inner"))).alias("list")).alias("contents"),
                    F.struct(F.struct(F.struct(F.concat(F.lit("tok"), c("doc_id").cast("string")).alias("token")).alias("continuationCommand")).alias("continuationEndpoint")).alias("continuationItemRenderer"))
    data = F.to_json(tree)
    n = c("doc_id") % 3
    page = (F.when(n == 0, F.concat(F.lit("<script>var ytInitialData = "), data, F.lit(";</script>"))).when(n == 1, F.concat(F.lit('<script>window["ytInitialData"] = '), data, F.lit(";\n</script>")))
            .otherwise("<p>none</p>"))
    return d.select("doc_id", page.alias("html"))


@query("src_09_page_data", "select doc_id, doc_id % 3 < 2 as found from documents")
def page_data(t):
    return video_pages(t).select("doc_id", yt.page_data(c("html")).isNotNull().alias("found"))


def renderers(t):
    return yt.find_renderers(video_pages(t).select("doc_id", yt.page_data(c("html")).alias("data")), ["doc_id"])


@query("src_10_continuations", "select doc_id, concat('tok', cast(doc_id as string)) as continuation from documents where doc_id % 3 < 2")
def continuations(t):
    return yt.continuations(renderers(t), ["doc_id"])


@query("src_11_videos", """
    select doc_id, concat('v', cast(doc_id as string)) as id, concat(text, lang) as title, concat(cast(n_chars as string), ' views') as "viewsText", source as "channelName",
           lang as "channelId", source as thumbnail, doc_id % 2 = 0 as verified, concat('https://youtu.be/v', cast(doc_id as string)) as "shortUrl",
           concat('https://www.youtube.com/channel/', lang) as "channelUrl" from documents where doc_id % 3 < 2""")
def videos(t):
    return yt.videos(renderers(t), ["doc_id"]).select("doc_id", "id", "title", "viewsText", "channelName", "channelId", "thumbnail", "verified", "shortUrl", "channelUrl")


def hit_pages(t):
    tags = F.when(c("doc_id") % 4 == 0, F.array(F.lit("comment"), F.lit("job"))).when(c("doc_id") % 4 == 1, F.array(F.lit("poll"))).when(
        c("doc_id") % 4 == 2, F.array(F.lit("story")))
    hit = F.struct(c("native_id").alias("objectID"), "title", F.when(c("doc_id") % 2 == 0, c("body")).alias("story_text"), F.lit("said").alias("comment_text"),
                   F.when(c("doc_id") % 5 != 0, c("score")).alias("points"), c("comments").alias("num_comments"), tags.alias("_tags"), c("doc_id").alias("story_id"))
    p = t.posts.withColumn("page", F.floor(c("doc_id") / 10)).groupBy("page").agg(F.collect_list(hit).alias("hits"))
    return p.select("page", F.to_json(F.struct("hits", c("page").alias("page"), F.lit(60).alias("nbPages"), F.lit(10).alias("hitsPerPage"))).alias("payload"))


@query("src_12_hits", """
    select native_id as id, case doc_id % 4 when 0 then 'comment' when 1 then 'poll' else 'story' end as type, title, case when doc_id % 2 = 0 and body <> '' then body else 'said' end as text,
           case when doc_id % 5 <> 0 then score else 0 end as points, comments, cast(doc_id as string) as "storyId" from @posts""")
def hits(t):
    return hn.posts(hn.parse(hit_pages(t), ["page"]), [], "2024-01-31T00:00:00Z").select("id", "type", "title", "text", "points", "comments", "storyId")


@query("src_13_page_facts", "select distinct cast(floor(doc_id / 10) as integer) as page, 60 as total_pages, 10 as hits_per_page, floor(doc_id / 10) < 59 as has_next from @posts")
def page_facts(t):
    return hn.page_facts(hn.parse(hit_pages(t).select("payload"), []), [])


def trend_payloads(t, method, body):
    """A payload per document, every ninth of which is an error page."""
    n = c("doc_id") % 9
    raw = F.when(n == 7, F.lit("<html>Error 429 too many</html>")).when(n == 8, F.lit("  <p>oops</p>")).when(n == 6, F.lit(")]}' {broken")).otherwise(
        F.concat(F.lit(")]}',\n"), F.to_json(F.struct(body.alias("default")))))
    return t.documents.select("doc_id", F.lit(method).alias("method"), raw.alias("raw"))


GOOD = "doc_id % 9 < 6"


@query("src_14_guard", "select doc_id, case doc_id % 9 when 7 then 'rate limited (HTTP 429)' when 8 then 'unexpected HTML response' when 6 then 'failed to parse response' else case when doc_id % 2 = 0 then 'unknown method' end end as error from documents")
def guard(t):
    p = trend_payloads(t, "autoComplete", F.struct(F.lit(1).alias("x"))).withColumn("method", F.when(c("doc_id") % 2 == 0, "other").otherwise(c("method")))
    return tr.guard(p).select("doc_id", "error")


@query("src_15_auto_complete", f"select doc_id, 0 as pos, lang as mid, source as title, '' as type from documents where {GOOD}")
def auto_complete(t):
    return tr.auto_complete(trend_payloads(t, "autoComplete", F.struct(F.array(F.struct(c("lang").alias("mid"), c("source").alias("title"))).alias("topics"))), ["doc_id"])


@query("src_16_interest_over_time", f"select doc_id, p.k as keyword_pos, 1704067200 + doc_id as at_s, case p.k when 0 then n_chars else doc_id end as value, p.k = 0 as has_data from documents, (values (0), (1)) p(k) where {GOOD}")
def interest_over_time(t):
    point = F.struct((1704067200 + c("doc_id")).cast("string").alias("time"), F.array("n_chars", "doc_id").alias("value"), F.array(F.lit(True), F.lit(False)).alias("hasData"))
    rows = tr.interest_over_time(trend_payloads(t, "interestOverTime", F.struct(F.array(point).alias("timelineData"))), ["doc_id"])
    return rows.select("doc_id", "keyword_pos", F.unix_seconds("ts").alias("at_s"), "value", "has_data")


@query("src_17_interest_by_region", f"select doc_id, lang as geo, n_chars as value, 0 as max_value_index from documents where {GOOD}")
def interest_by_region(t):
    region = F.struct(c("lang").alias("geoCode"), F.array("n_chars").alias("value"))
    rows = tr.interest_by_region(trend_payloads(t, "interestByRegion", F.struct(F.array(region).alias("geoMapData"))), ["doc_id"])
    return rows.select("doc_id", c("geoCode").alias("geo"), c("value")[0].alias("value"), "max_value_index")


@query("src_18_ranked_keywords", f"select doc_id, l.name as list, case l.name when 'top' then lang else source end as query, case l.name when 'top' then n_chars else 0 end as value from documents, (values ('top'), ('rising')) l(name) where {GOOD}")
def ranked_keywords(t):
    kw = lambda q, v: F.struct(F.array(F.struct(c(q).alias("query"), v.alias("value"))).alias("rankedKeyword"))
    lists = F.array(kw("lang", c("n_chars")), kw("source", F.lit(None).cast("bigint")))
    rows = tr.ranked_keywords(trend_payloads(t, "relatedQueries", F.struct(lists.alias("rankedList"))), ["doc_id"])
    return rows.select("doc_id", "list", "query", "value")


@query("src_19_daily_trends", f"select doc_id, d.n as day, lang as title, n_chars as traffic, concat(source, '|', lang) as related, 'u' as url from documents, (values (0), (1)) d(n) where {GOOD}")
def daily_trends(t):
    search = F.struct(F.struct(c("lang").alias("query")).alias("title"), F.concat(c("n_chars").cast("string"), F.lit("K+")).alias("formattedTraffic"),
                      F.array(F.struct(c("source").alias("query")), F.struct(c("lang").alias("query"))).alias("relatedQueries"), F.array(F.struct(F.lit("u").alias("url"))).alias("articles"))
    day = F.struct(F.array(search).alias("trendingSearches"))
    rows = tr.daily_trends(trend_payloads(t, "dailyTrends", F.struct(F.array(day, day).alias("trendingSearchesDays"))), ["doc_id"])
    return rows.select("doc_id", "day", "title", "traffic", F.array_join("related_queries", "|").alias("related"), c("articles")[0]["url"].alias("url"))


@query("src_20_harvested_posts", """
    select doc_id, case p.r when 1 then concat('C-', cast(doc_id as string)) else concat('R_', cast(doc_id as string)) end as code, case p.r when 1 then lang else 'second' end as query, p.r as rank
    from documents, (values (1), (2)) p(r)""")
def harvested_posts(t):
    host = F.lit("https://www.instagram.com")
    n = c("doc_id").cast("string")
    m = F.create_map(c("lang"), F.array(F.concat(host, F.lit("/p/C-"), n, F.lit("/")), F.concat(host, F.lit("/user/x"))), F.lit("second"), F.array(F.concat(host, F.lit("/reel/R_"), n)))
    payload = t.documents.select("doc_id", F.to_json(F.struct(m.alias("results"))).alias("payload"))
    return ig.harvested_posts(payload, ["doc_id"], AS_OF_SECONDS).select("doc_id", "code", "query", "rank")


@query("src_21_media_record", "select doc_id, lang as channel, case when doc_id % 2 = 0 then replace(text, chr(10), ' ') end as description, n_chars as like_count from documents")
def media_record(t):
    rec = F.to_json(F.struct(c("lang").alias("channel"), F.when(c("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(" "))).alias("description"), c("n_chars").alias("like_count")))
    out = t.documents.select("doc_id", F.concat(F.lit("warning: x\n[info] y\n"), rec, F.lit("\n")).alias("stdout"))
    return out.select("doc_id", ig.media_record(c("stdout")).alias("m")).select("doc_id", "m.channel", "m.description", "m.like_count")


@query("src_22_search_payload", f"""
    select native_id as pk, score as like_count, comments as comment_count, author as username, round((score + comments) / greatest(({AS_OF_SECONDS} - created_s) / 3600.0::double, 1), 2) as engagement_velocity,
           concat('https://www.instagram.com/p/', native_id, '/') as url from @posts""")
def search_payload(t):
    item = F.struct(c("native_id").alias("pk"), c("native_id").alias("code"), c("score").alias("like_count"), c("comments").alias("comment_count"), c("created_s").alias("taken_at"),
                    F.struct(c("author").alias("username")).alias("user"))
    edges = t.posts.withColumn("page", F.floor(c("doc_id") / 10)).groupBy("page").agg(F.array(F.struct(F.struct(F.collect_list(item).alias("items")).alias("node"))).alias("edges"))
    pages = edges.select("page", F.to_json(F.struct(F.struct(F.struct("edges").alias("xdt_fbsearch__top_serp_graphql")).alias("data"))).alias("payload"))
    return ig.most_liked_first(ig.search_posts(pages, ["page"], as_of())).select("pk", "like_count", "comment_count", "username", "engagement_velocity", "url")


@query("src_23_listing", "select case when doc_id % 2 = 0 then 'post' else 'comment' end as kind, native_id as id, author, score from @posts")
def listing(t):
    p = t.posts.withColumn("page", F.floor(c("doc_id") / 10)).withColumn("kind", F.when(c("doc_id") % 2 == 0, "post").otherwise("comment"))
    child = F.struct(F.struct(c("native_id").alias("id"), "author", "score").alias("data"))
    pages = p.groupBy("page", "kind").agg(F.to_json(F.struct(F.struct(F.collect_list(child).alias("children")).alias("data"))).alias("payload"))
    out = None
    for kind in ("post", "comment"):
        part = rd.listing_rows(pages.filter(c("kind") == kind), ["page"], kind).select("kind", "id", "author", "score")
        out = part if out is None else out.unionByName(part)
    return out


FOUND = r"""select concat('t', cast(page_id % 5 as string)) as tag, concat('https://site.example/', regexp_extract(url, '^https?://[^/]*\.(com|net|org)/(en|fr|de|es)/', 2), '/', cast(page_id % 60 as string), '/') as url, page_id
    from pages where regexp_matches(url, '^https?://[^/]*\.(com|net|org)/(en|fr|de|es)/')"""


def found_links(t):
    lang = F.regexp_extract("url", r"^https?://[^/]*\.(com|net|org)/(en|fr|de|es)/", 2)
    link = F.concat(F.lit("https://site.example/"), lang, F.lit("/"), (c("page_id") % 60).cast("string"), F.lit("?x=1#top"))
    found = t.pages.select("page_id", F.concat(F.lit("##t"), (c("page_id") % 5).cast("string")).alias("raw_tag"), F.when(lang != "", link).alias("href"))
    return cn.store_harvest(found, tx.clean_tag(c("raw_tag")), canonical_post_url(c("href"), "https://site.example", r"^https?://site\.example", "en|fr|de|es"), ["page_id"])


@query("src_24_store_harvest", f"select tag, url, min(page_id) as page_id from ({FOUND}) group by tag, url")
def store_harvest(t):
    return found_links(t)


@query("src_25_harvest_summary", f"select (select count(distinct tag) from ({FOUND})) as total_hashtags, (select count(*) from (select distinct tag, url from ({FOUND}))) as total_posts, (select count(distinct url) from ({FOUND})) as unique_posts, 't1,t4' as failed")
def harvest_summary(t):
    failed = t.pages.filter("page_id % 5 in (1, 4)").select(F.concat(F.lit("t"), (c("page_id") % 5).cast("string")).alias("tag"))
    s = cn.harvest_summary(found_links(t), failed)
    return s.select("total_hashtags", "total_posts", "unique_posts", F.array_join("failed_hashtags", ",").alias("failed"))


# ---- sinks: written into the checkpoint folder and read back ---------------------------------------------------------

def fresh_folder(t, name):
    import uuid
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("snk_01_documents", "select session_id, count(*) as posts from @posts group by session_id")
def documents(t):
    folder = fresh_folder(t, "documents")
    sk.write_documents(t.posts.groupBy("session_id").agg(F.count("*").alias("posts")), folder)
    return t.spark.read.schema("session_id bigint, posts bigint").json(folder)


@query("snk_02_posts_by_id", "select session_id, native_id as post_id, author, score from @posts")
def posts_by_id(t):
    side = sk.posts_by_id(t.posts.select("session_id", c("native_id").alias("id"), "author", "score"))
    return side.select("session_id", "post_id", "post.author", "post.score")


@query("snk_03_stage_resume", "select session_id, count(*) filter (where score > 1000) as kept from @posts group by session_id having count(*) filter (where score > 1000) > 0")
def stage_resume(t):
    tables = sk.StageTables(t.spark, fresh_folder(t, "stages"))
    stages = {"posts": lambda s: t.posts.select("session_id", "score"), "kept": lambda s: s.read("posts").filter("score > 1000"),
              "counts": lambda s: s.read("kept").groupBy("session_id").agg(F.count("*").alias("kept"))}
    tables.run(stages, end="kept")
    tables.run(stages)
    return tables.read("counts")


# session 3 changes after a first run that knew only half of its rows: it alone is built again, the files of all others stay
@query("snk_03_session_resume", """
    select session_id, count(*) as vectors, count(distinct label) as labels, session_id <> 3 as same_file from @vectors group by session_id""")
def session_resume(t):
    tables = sk.SessionStages(t.spark, fresh_folder(t, "sessions"))
    sessions = t.vectors.select("session_id").distinct()

    def stages(source):
        return {"labelled": lambda s, todo: source.join(todo, "session_id", "left_semi").select("session_id", "vec_id", "label"),
                "counted": lambda s, todo: s.read("labelled", todo).groupBy("session_id", "label").agg(F.count("*").alias("n")),
                "summed": lambda s, todo: s.read("counted", todo).groupBy("session_id").agg(F.sum("n").alias("vectors"), F.count("*").alias("labels"))}

    def listed():
        rows = t.spark.read.parquet(tables.path("summed")).select("session_id", "_run", F.input_file_name().alias("file"))
        return rows.join(tables.done("summed").withColumnRenamed("run", "_run"), ["session_id", "_run"], "left_semi")

    tables.run(stages(t.vectors.filter("session_id <> 3 or vec_id % 2 = 0")), sessions)
    before = stored(listed().select("file").distinct())
    tables.forget(sessions.filter("session_id = 3"), ["labelled"])
    built = tables.run(stages(t.vectors), sessions)
    assert set(built.values()) <= {0, 1}, built
    now = listed().join(before.withColumn("kept", F.lit(True)), "file", "left").select("session_id", F.coalesce("kept", F.lit(False)).alias("same_file"))
    return tables.read("summed").join(now, "session_id").select("session_id", "vectors", "labels", "same_file")


# a full run and a resumed one have the same rows
@query("ses_04_sessions_left", "select distinct session_id, session_id % 4 <> 1 as complete from @vectors")
def sessions_left(t):
    tables = sk.SessionStages(t.spark, fresh_folder(t, "left"))
    sessions = t.vectors.select("session_id").distinct()
    stages = {"rows": lambda s, todo: t.vectors.join(todo, "session_id", "left_semi").select("session_id", "vec_id")}
    tables.run(stages, sessions.filter("session_id % 4 <> 1"))
    return sessions.join(tables.done("rows").withColumn("complete", F.lit(True)), "session_id", "left").select("session_id", F.coalesce("complete", F.lit(False)).alias("complete"))


@query("snk_04_append_vectors", "select vec_id, label from embeddings")
def append_vectors(t):
    folder = fresh_folder(t, "vectors")
    sk.append_vectors(t.embeddings.filter("vec_id % 2 = 0"), folder)
    sk.append_vectors(t.embeddings.filter("vec_id % 2 = 1"), folder)
    return t.spark.read.schema("vec_id bigint, label int").parquet(folder)


@query("snk_05_catcher_vectors", "select doc_id as session_id, concat(lang, ' - ', source) as text, 'topic' as topic, 1.0::double as score, 32 as dims from documents")
def catcher_vectors(t):
    catchers = t.documents.select(c("doc_id").alias("session_id"), F.lit(0).alias("place"), c("lang").alias("trend"), c("source").alias("angle"))
    sessions = t.documents.select(c("doc_id").alias("session_id"), F.lit("topic").alias("seed"))
    v = sk.catcher_vectors(catchers, sessions, dims=32)
    return v.select("session_id", "text", "topic", "score", F.size("vector").alias("dims"))
