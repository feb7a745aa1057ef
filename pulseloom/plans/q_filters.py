"""Queries: filters, projections, per-platform normalisation."""

from pyspark.sql import Window, functions as F

from pulseloom import settings
from pulseloom.functions.scores import engagement
from pulseloom.operators import asked as ak, filters as fl, normalize as nz, projections as pj
from pulseloom.operators.ranking import top_n
from pulseloom.plans.adapters import AS_OF_SECONDS
from pulseloom.plans.q_text import as_of, sql_clean, sql_language, sql_words
from pulseloom.plans.registry import FRAGMENTS, query

IDS = "select doc_id from @posts where "


def ids(df):
    return df.select("doc_id")


@query("flt_01_ranges", IDS + "score between 100 and 3000 and comments between 5 and 60")
def ranges(t):
    return ids(fl.within(fl.within(t.posts, "score", 100, 3000), "comments", 5, 60))


@query("flt_02_author", IDS + "author = 'user7'")
def author(t):
    return ids(fl.by_author(t.posts, "user7"))


@query("flt_03_moments", IDS + "created_s > 1704758400 and created_s < 1706140800")
def moments(t):
    return ids(fl.between_moments(t.posts, 1704758400.9, 1706140800.2))


@query("flt_04_words", "select doc_id, contains(lower(body), 'the') and contains(lower(body), 'with') as both_words, contains(lower(body), 'avec') or (contains(lower(body), 'sich') and contains(lower(body), 'den')) as either from @posts")
def words(t):
    return t.posts.select("doc_id", fl.text_query("The with", ["body"]).alias("both_words"),
                          fl.text_query("avec OR sich AND den", ["body"]).alias("either"))


# a query for each conversation, made of the first words of its opening: all of two words, either, or a mixture
FRAGMENTS["asked"] = r"""
    select conv_id, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: len(w) > 1 and w not in ('and', 'or')) as w
    from (select conv_id, arg_min(text, turn) as text from conversations group by conv_id)"""
ASKED_SQL = """
    select q.conv_id as query_id, p.doc_id as id from @asked q join @posts p on case
        when len(w) < 3 then true
        when q.conv_id % 3 = 0 then contains(lower(p.body), w[1]) and contains(lower(p.body), w[2])
        when q.conv_id % 3 = 1 then contains(lower(p.body), w[1]) or contains(lower(p.body), w[3])
        else (contains(lower(p.body), w[1]) and contains(lower(p.body), w[2])) or contains(lower(p.body), w[3]) end
    where len(w) >= 3 or q.conv_id % 10 = 0"""


@query("flt_04_query_table", ASKED_SQL)
def query_table(t):
    first = t.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: (F.length(x) > 1) & ~x.isin("and", "or"))
    two = lambda a, b, join: F.concat(w[a], F.lit(join), w[b])
    asked = F.when(F.size(w) < 3, F.lit(" and ")).when(F.col("conv_id") % 3 == 0, two(0, 1, " ")).when(F.col("conv_id") % 3 == 1, two(0, 2, " or ")).otherwise(
        F.concat(w[0], F.lit(" AND "), w[1], F.lit(" OR "), w[2]))
    queries = first.filter((F.size(w) >= 3) | (F.col("conv_id") % 10 == 0)).select(F.col("conv_id").alias("query_id"), asked.alias("query"))
    return ak.matching(t.posts, queries, id_col="doc_id", attributes=["body"])


@query("flt_05_phrase", IDS + "contains(lower(body), 'of the')")
def phrase(t):
    return ids(t.posts.filter(fl.text_query("of the", ["body"], exact=True)))


@query("flt_06_attributes", IDS + "contains(lower(title), 'is') or contains(lower(author), 'is')")
def attributes(t):
    return ids(t.posts.filter(fl.text_query("is", ["title", "author"])))


TAGS = """select *, case doc_id % 4 when 0 then ['story', 'ask_hn'] when 1 then ['story', 'show_hn'] when 2 then ['comment'] else ['story'] end as tags from @posts"""
FRAGMENTS["tagged"] = TAGS


def tagged(t):
    lists = [F.array(F.lit("story"), F.lit("ask_hn")), F.array(F.lit("story"), F.lit("show_hn")), F.array(F.lit("comment"))]
    n = F.col("doc_id") % 4
    tags = F.when(n == 0, lists[0]).when(n == 1, lists[1]).when(n == 2, lists[2]).otherwise(F.array(F.lit("story")))
    return t.posts.withColumn("tags", tags)


@query("flt_07_tags", "select doc_id from @tagged where list_contains(tags, 'story') and list_contains(tags, 'ask_hn')")
def all_tags(t):
    return ids(tagged(t).filter(fl.with_all_tags(["story", "ask_hn"])))


@query("flt_08_presets", """
    select 'stories' as preset, doc_id from @tagged where list_contains(tags, 'story') and contains(lower(title), 'the')
    union all select 'comments', doc_id from @tagged where list_contains(tags, 'comment') and contains(lower(title), 'the')
    union all select 'ask', doc_id from @tagged where list_contains(tags, 'ask_hn') and contains(lower(title), 'the')
    union all select 'show', doc_id from @tagged where list_contains(tags, 'show_hn') and contains(lower(title), 'the')
    union all select 'latest', doc_id from @tagged where list_contains(tags, 'story')
    union all select 'high_engagement', doc_id from @tagged where list_contains(tags, 'story') and score >= 100 and comments >= 50""")
def presets(t):
    tests = {name: fl.preset_test(name, None if name in ("latest", "high_engagement") else "the", points="score") for name in fl.PRESETS}
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return tagged(t).select(F.explode(named).alias("preset"), "doc_id")


MODES = {"relevance": "(score * 31 + comments) % 1009", "hot": "engagement", "top": "score", "new": "created_s", "date": "created_s", "comments": "comments"}
SORTED = " union all ".join(
    f"select '{m}' as mode, session_id, doc_id, row_number() over (partition by session_id order by {c} desc, doc_id) as rank from @engagement" for m, c in MODES.items())


@query("flt_09_sort_modes", SORTED)
def sort_modes(t):
    c = F.col
    posts = t.posts.withColumn("engagement", engagement(c("platform"), c("score"), c("comments"), F.timestamp_seconds("created_s"), as_of()))
    posts = posts.withColumn("relevance_score", F.expr(MODES["relevance"]))
    ranks = [F.struct(F.lit(m).alias("mode"), F.row_number().over(Window.partitionBy("session_id").orderBy(*fl.sort_order(m, "doc_id"))).cast("bigint").alias("rank"))
             for m in MODES]
    return posts.select("session_id", "doc_id", F.array(*ranks).alias("_r")).select("session_id", "doc_id", F.inline("_r"))


@query("flt_10_windows", " union all ".join(f"select '{w}' as win, count(*) as n from @posts where created_s >= {AS_OF_SECONDS - s}" for w, s in fl.WINDOW_SECONDS.items())
       + " union all select 'all', count(*) from @posts")
def windows(t):
    names = [*fl.WINDOW_SECONDS, "all"]
    counts = t.posts.agg(*[F.count_if(fl.in_window(w, AS_OF_SECONDS)).alias(w) for w in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(w).alias("win"), F.col(f"`{w}`").alias("n")) for w in names])))


@query("flt_11_duration", """select doc_id, n_chars as seconds, case when n_chars < 240 then 'Under 4 minutes' when n_chars <= 1200 then '4 - 20 minutes' else 'Over 20 minutes' end as bucket from documents""")
def duration(t):
    n = F.col("n_chars")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    shown = F.when(n >= 3600, F.concat(F.floor(n / 3600).cast("string"), F.lit(":"), two(F.floor(n / 60) % 60), F.lit(":"), two(n % 60))) \
        .otherwise(F.concat(F.floor(n / 60).cast("string"), F.lit(":"), two(n % 60)))
    return t.documents.select("doc_id", shown.alias("shown")).select(
        "doc_id", fl.duration_seconds(F.col("shown")).alias("seconds"), fl.duration_bucket(F.col("shown")).alias("bucket"))


@query("flt_12_default_harvest", IDS + f"created_s > {AS_OF_SECONDS - 20 * 86400} and score >= 2")
def default_harvest(t):
    return ids(fl.default_harvest(t.posts, AS_OF_SECONDS, days=20))


@query("flt_13_bots", IDS + "author <> 'AutoModerator'")
def bots(t):
    return ids(t.posts.filter(fl.not_a_bot(F.col("author"))))


@query("flt_14_deleted", IDS + "title not in ('[deleted]', '[removed]', '') and body not in ('[deleted]', '[removed]', '')")
def deleted(t):
    return ids(t.posts.filter(fl.not_deleted(F.col("title"), F.col("body"))))


@query("flt_15_words", f"select doc_id from documents where len({sql_words('text')}) >= 15")
def enough_words(t):
    return ids(t.documents.filter(fl.enough_words(F.col("text"))))


@query("flt_16_views", IDS + "platform = 'youtube' and score >= 2000")
def views(t):
    return ids(t.posts.filter("platform = 'youtube'").filter(fl.enough_views(F.col("score"))))


@query("flt_17_language", f"select doc_id from documents where {sql_language('text')} = 'en'")
def english(t):
    return ids(t.documents.filter(fl.in_language(F.col("text"))))


@query("flt_18_score_or_anomaly", "select cluster_id, avg_relevance >= 0.6 or is_anomaly as kept, avg_relevance >= 0.6 as strict from @signals")
def score_or_anomaly(t):
    score, odd = F.col("avg_relevance"), F.col("is_anomaly")
    entry = F.struct(F.col("avg_relevance").alias("score"), "is_anomaly")
    return t.signals.select("cluster_id", (F.size(fl.keep_entries(F.array(entry), 0.6)) == 1).alias("kept"),
                            fl.score_or_anomaly(score, odd, 0.6, exempt=False).alias("strict"))


@query("flt_19_known_ids", "select native_id as id from @posts where doc_id % 3 = 0")
def known_ids(t):
    posts = t.posts.select(F.col("native_id").alias("id"), "doc_id")
    return fl.known_ids(posts, posts.filter("doc_id % 3 = 0")).select("id")


@query("flt_20_where_select", "select vec_id, label from embeddings where label = 3 and vec_id > 20")
def where_select(t):
    return fl.where_select(t.embeddings, "label = 3 and vec_id > 20", ["vec_id", "label"])


@query("prj_01_post_view", """
    select native_id as id, platform as source, link as url, case when body <> '' then body else title end as text,
           case when platform in ('reddit', 'hackerNews') then score end as score, case when platform = 'youtube' then score end as views,
           comments, case when platform = 'instagram' then score end as likes from @posts""")
def post_view(t):
    on = lambda p, c: F.when(F.col("platform") == p, F.col(c))
    raw = t.posts.select(
        F.col("native_id").alias("id"), "platform", F.col("link").alias("url"), "title", "body",
        on("reddit", "score").alias("score"), on("hackerNews", "score").alias("points"),
        F.when(F.col("platform") == "youtube", F.concat(F.col("score").cast("string"), F.lit(" views"))).alias("views_text"),
        F.when(F.col("platform") == "instagram", F.col("score")).alias("like_count"), F.col("comments").alias("num_comments"))
    return pj.post_view(raw).drop("transcript", "shares")


@query("prj_02_absolute_url", "select doc_id, case when link = '' then null when starts_with(link, 'http') then link else concat('https://old.reddit.com', link) end as url from @posts")
def absolute(t):
    return t.posts.select("doc_id", pj.absolute_url(F.col("link")).alias("url"))


@query("prj_03_canonical_url", r"""
    with p as (select page_id, regexp_replace(url, '[?#].*$', '') as u, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*\.com', '') as local from pages)
    select page_id, case when regexp_matches(u, '^https?://[^/]*\.com/(en|fr)/') then concat('https://site.example', regexp_replace(local, '/+$', ''), '/') end as post_url from p""")
def canonical(t):
    return t.pages.select("page_id", pj.canonical_post_url(F.col("url"), "https://site.example", r"^https?://[^/]*\.com", "en|fr").alias("post_url"))


@query("prj_04_default_url", "select doc_id, case when link <> '' then link else concat('https://news.ycombinator.com/item?id=', native_id) end as url from @posts")
def default_url(t):
    return t.posts.select("doc_id", pj.default_url(F.col("link"), F.col("native_id")).alias("url"))


# ---- normalisation ---------------------------------------------------------------------------------------------------

def platform_frames(posts):
    """Adapted posts in the landed shape of each platform."""
    c, context = F.col, ["session_id", "query", "query_ord", "platform_ord", "pos"]
    of = lambda p: posts.filter(c("platform") == p)
    iso = lambda tail: F.concat("created_day", F.lit(tail))
    grouped = F.when(c("score") >= 1000, F.concat(F.floor(c("score") / 1000).cast("string"), F.lit(","), F.lpad((c("score") % 1000).cast("string"), 3, "0"))) \
        .otherwise(c("score").cast("string"))
    return {
        "reddit": of("reddit").select(*context, c("native_id").alias("postId"), "title", "body", c("link").alias("permalink"), "author",
                                      F.lit("sub").alias("subreddit"), "score", "comments", iso("T00:00:00+00:00").alias("createdIso")),
        "youtube": of("youtube").select(*context, c("native_id").alias("id"), "title", c("body").alias("description"), c("author").alias("channelName"),
                                        F.concat((1 + c("doc_id") % 30).cast("string"), F.lit(" days ago")).alias("publishedText"),
                                        F.concat(grouped, F.lit(" views")).alias("viewsText"), c("link").alias("url")),
        "hackerNews": of("hackerNews").select(*context, c("native_id").alias("id"), "title", c("body").alias("text"), c("link").alias("url"), "author",
                                              iso("T00:00:00.000Z").alias("createdAt"), c("score").alias("points"), "comments"),
        "instagram": of("instagram").select(*context, c("native_id").alias("pk"), c("title").alias("caption"), c("body").alias("transcript"),
                                            F.lit("").alias("username"), c("author").alias("full_name"), c("score").alias("like_count"),
                                            c("comments").alias("comment_count"), c("created_s").alias("taken_at"), c("link").alias("url")),
    }


def _normal_sql(base: str) -> str:
    return f"""
    select c.session_id, c.query_ord, concat(lower(c.platform), '_', c.native_id) as id, c.platform as source, c.query, c.pos, c.text,
           case when c.platform = 'instagram' and length(c.ct) > 100 then concat(substring(c.ct, 1, 100), '...') else c.ct end as title,
           c.author, c.score, case when c.platform = 'youtube' then 0 else c.comments end as num_comments, c.created_s,
           case when c.platform = 'hackerNews' and c.link = '' then concat('https://news.ycombinator.com/item?id=', c.native_id) else c.link end as url,
           round(ln(1 + greatest(0, case when c.platform in ('reddit', 'hackerNews') then c.score + c.comments * 2.0::double
               when c.platform = 'youtube' then c.score * 0.02::double else c.score + c.comments end))
               * exp(-0.05::double * greatest(0, ({AS_OF_SECONDS} - c.created_s) / 86400.0::double)), 4) as engagement
    from (select *, trim(concat(ct, '. ', cb)) as text from {base}) c
    where not (c.platform = 'reddit' and c.author = 'AutoModerator')
      and not (c.platform in ('reddit', 'hackerNews') and (c.ct in ('', '[deleted]', '[removed]') or c.cb in ('', '[deleted]', '[removed]')))
      and not (c.platform = 'youtube' and c.score < 2000)
      and len({sql_words('c.text')}) >= 15 and {sql_language('c.text')} = 'en'"""


FRAGMENTS["normal"] = _normal_sql("@cleaned")
FRAGMENTS["cleaned_repeat"] = f"select *, {sql_clean('title')} as ct, {sql_clean('body')} as cb from @posts_repeat"
FRAGMENTS["normal_repeat"] = _normal_sql("@cleaned_repeat")
NORMAL_COLUMNS = ["id", "session_id", "query", "text", "title", "author", "score", "num_comments", "created_s", "url", "engagement"]


def normal_columns(df):
    return df.withColumn("created_s", F.unix_seconds("created_at")).select(*NORMAL_COLUMNS)


for _n, (_id, _platform) in enumerate((("nrm_01_reddit", "reddit"), ("nrm_02_youtube", "youtube"),
                                       ("nrm_03_hackernews", "hackerNews"), ("nrm_04_instagram", "instagram"))):
    query(_id, f"select {', '.join(NORMAL_COLUMNS)} from @normal where source = '{_platform}'")(
        lambda t, p=_platform: normal_columns(nz.NORMALIZERS[p](platform_frames(t.posts)[p], as_of())))


def normalized(t, repeated=False):
    return nz.normalize(platform_frames(t.posts_repeat if repeated else t.posts), as_of())


@query("nrm_05_normalize", "select id, session_id, min(query_ord) as query_ord from @normal_repeat group by id, session_id")
def normalize_all(t):
    return normalized(t, repeated=True).select("id", "session_id", "query_ord")


@query("nrm_05_top_posts", """
    select session_id, source, rank, id, title, engagement from (
        select *, row_number() over (partition by session_id, source order by engagement desc, pos) as rank from @normal) where rank <= 10""")
def top_posts(t):
    best = top_n(normalized(t, repeated=True), settings.DOCS_PER_CLUSTER, ["session_id", "source"], [F.desc("engagement"), F.col("pos")])
    return best.select("session_id", "source", "rank", "id", "title", "engagement")
