"""Queries: text, date, number, JSON and array functions."""

from pyspark.sql import functions as F, types as T

from pulseloom import settings
from pulseloom.functions import documents as js, moments as mo, scores as sc, text as tx
from pulseloom.functions.language import FUNCTION_WORDS, detect_language
from pulseloom.operators import profiles as pf
from pulseloom.plans.adapters import AS_OF_SECONDS
from pulseloom.plans.registry import FRAGMENTS, query


def as_of():
    return F.timestamp_seconds(F.lit(AS_OF_SECONDS))


EMOJI_SQL = tx.EMOJI
BOILER_SQL = tx.BOILERPLATE.replace("(?iU)", "(?i)")  # DuckDB has no U flag


def sql_clean(x: str) -> str:
    """The cleaning steps as plain SQL; the only entity and hashtag in the adapted texts are written out."""
    x = f"regexp_replace(replace({x}, '&amp;', '&'), '<[^>]+>', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '{BOILER_SQL}', ' ', 'g'), '{EMOJI_SQL}', ' ', 'g')"
    x = f"replace({x}, '#AICodingTools', 'A I Coding Tools')"
    x = rf"regexp_replace({x}, '([!?.]){{2,}}', '\1', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def sql_language(x: str) -> str:
    tokens = rf"string_split_regex(lower({x}), '[^\p{{L}}'']+')"
    hits = {code: f"len(list_filter({tokens}, lambda w: w in ({', '.join(repr(v) if chr(39) not in v else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in words.split())})))"
            for code, words in FUNCTION_WORDS.items()}
    best = "greatest(" + ", ".join(hits.values()) + ")"
    return f"case when {best} = 0 then null " + " ".join(f"when {h} = {best} then '{c}'" for c, h in hits.items()) + " end"


FRAGMENTS["cleaned"] = f"select *, {sql_clean('title')} as ct, {sql_clean('body')} as cb from @posts"


@query("txt_01_entities", "select page_id, replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as decoded from pages")
def entities(t):
    return t.pages.select("page_id", tx.unescape_entities(F.col("html")).alias("decoded"))


@query("txt_02_tags", "select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as stripped from pages")
def tags(t):
    return t.pages.select("page_id", tx.strip_tags(F.col("html")).alias("stripped"))


@query("txt_03_boilerplate", f"select doc_id, regexp_replace(concat('EDIT: thanks for the gold ', body), '{BOILER_SQL}', ' ', 'g') as stripped from @posts")
def boilerplate(t):
    return t.posts.select("doc_id", tx.strip_boilerplate(F.concat(F.lit("EDIT: thanks for the gold "), "body")).alias("stripped"))


@query("txt_04_emoji", f"select doc_id, regexp_replace(body, '{EMOJI_SQL}', ' ', 'g') as stripped from @posts")
def emoji(t):
    return t.posts.select("doc_id", tx.strip_emoji(F.col("body")).alias("stripped"))


@query("txt_05_hashtags", "select doc_id, replace(concat('a#B ', body), 'a#B', 'aB').replace('#AICodingTools', 'A I Coding Tools') as spelled from @posts")
def hashtags(t):
    return t.posts.select("doc_id", tx.spell_hashtags(F.concat(F.lit("a#B "), "body")).alias("spelled"))


@query("txt_06_marks", r"select doc_id, regexp_replace(body, '([!?.]){2,}', '\1', 'g') as collapsed from @posts")
def marks(t):
    return t.posts.select("doc_id", tx.collapse_marks(F.col("body")).alias("collapsed"))


@query("txt_07_blanks", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as collapsed from documents")
def blanks(t):
    return t.documents.select("doc_id", tx.collapse_blanks(F.col("text")).alias("collapsed"))


@query("txt_08_clean", "select doc_id, ct as title, cb as body from @cleaned")
def clean(t):
    return t.posts.select("doc_id", tx.clean_text(F.col("title")).alias("title"), tx.clean_text(F.col("body")).alias("body"))


@query("txt_09_compose", "select doc_id, trim(concat(title, '. ', body)) as text from @posts")
def compose(t):
    return t.posts.select("doc_id", tx.compose(F.col("title"), F.col("body")).alias("text"))


@query("txt_10_truncate", "select doc_id, " + ", ".join(
    f"case when length(text) > {n} then concat(substring(text, 1, {n}), '...') else text end as cut_{n}" for n in (100, 150, 200, 280, 500))
    + ", substring(text, 1, 7000) as cut_hard from documents")
def truncate(t):
    return t.documents.select("doc_id", *[tx.truncate(F.col("text"), n).alias(f"cut_{n}") for n in (100, 150, 200, 280, 500)],
                              F.substring("text", 1, 7000).alias("cut_hard"))


@query("txt_11_digits", "select doc_id, coalesce(try_cast(regexp_replace(concat(cast(n_chars as string), ',', lang, cast(doc_id % 10 as string)), '[^0-9]', '', 'g') as bigint), 0) as number, coalesce(try_cast(regexp_replace(lang, '[^0-9]', '', 'g') as bigint), 0) as none from documents")
def digits(t):
    joined = F.concat(F.col("n_chars").cast("string"), F.lit(","), "lang", (F.col("doc_id") % 10).cast("string"))
    return t.documents.select("doc_id", tx.digits(joined).alias("number"), tx.digits(F.col("lang")).alias("none"))


@query("txt_12_ids", "select doc_id, concat('t2_', native_id) as author_id, native_id as post_id, concat('s', cast(doc_id % 9 as string)) as subreddit from @posts")
def ids(t):
    d = t.posts
    return d.select("doc_id", tx.author_id(F.concat(F.lit("author may-blank id-t2_"), "native_id", F.lit(" x"))).alias("author_id"),
                    tx.bare_post_id(F.concat(F.lit("t3_"), "native_id")).alias("post_id"),
                    tx.bare_subreddit(F.concat(F.lit("r/s"), (F.col("doc_id") % 9).cast("string"))).alias("subreddit"))


@query("txt_13_language", f"select doc_id, {sql_language('text')} as detected from documents")
def language(t):
    return t.documents.select("doc_id", detect_language(F.col("text")).alias("detected"))


# profiles learnt from the texts of even ids are right more often than the word lists are, on all others, in every language
@query("txt_13_profiles", f"""
    select lang, count(*) as n, count(*) filter (where {sql_language('text')} = lang) as by_words, true as more_by_profile, true as mostly_right
    from documents where doc_id % 2 = 1 and lang is not null group by lang""")
def language_profiles(t):
    known = pf.learnt(t.documents.filter("doc_id % 2 = 0"), text_col="text", language_col="lang")
    d = pf.detected(t.documents.filter("doc_id % 2 = 1 and lang is not null").select("lang", "text"), known, text_col="text")
    d = d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(detect_language(F.col("text")) == F.col("lang")).alias("by_words"),
                              F.count_if(F.col("detected") == F.col("lang")).alias("right"))
    return d.select("lang", "n", "by_words", (F.col("right") >= F.col("by_words")).alias("more_by_profile"), (F.col("right") >= 0.9 * F.col("n")).alias("mostly_right"))


# every detected language is one of the labelled ones; texts without letters have none
@query("flt_17_profile", r"""
    select count(*) filter (where len(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) < 3) as without_letters, 0::bigint as of_those_detected from documents""")
def kept_by_profile(t):
    known = pf.learnt(t.documents, text_col="text", language_col="lang")
    bare = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]", "")) < 3
    d = pf.detected(t.documents.select("text", bare.alias("bare")), known, text_col="text")
    return d.agg(F.count_if("bare").alias("without_letters"), F.count_if(F.col("bare") & F.col("detected").isNotNull()).alias("of_those_detected"))


@query("txt_13_accuracy", f"select lang, count(*) as n, count(*) filter (where {sql_language('text')} = lang) as right_ones from documents group by lang")
def language_accuracy(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(detect_language(F.col("text")) == F.col("lang")).alias("right_ones"))


@query("txt_14_chunks", f"""
    with w as (select doc_id, text, {sql_words('text')} as words from documents where text <> ''),
    c as (select doc_id, text, words, unnest(case when len(words) <= 180 then [0] else generate_series(0, len(words) - 31, 150) end) as start from w)
    select doc_id, cast(start / 150 as bigint) as chunk_no,
           case when len(words) <= 180 then text else array_to_string(list_slice(words, start + 1, start + 180), ' ') end as chunk from c""")
def chunks(t):
    return t.documents.select("doc_id", F.posexplode(tx.chunk_words(F.col("text"))).alias("chunk_no", "chunk")).withColumn(
        "chunk_no", F.col("chunk_no").cast("bigint"))


@query("txt_15_token_estimate", "select lang, cast(sum(floor(length(text) / 4)) as bigint) as tokens from documents group by lang")
def token_estimate(t):
    return t.documents.groupBy("lang").agg(F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))


@query("txt_16_embedding_input", "select doc_id, substring(case when doc_id % 3 <> 0 then concat(title, chr(10), body) else body end, 1, 7000) as input from @posts")
def embedding_input(t):
    title = F.when(F.col("doc_id") % 3 != 0, F.col("title"))
    return t.posts.select("doc_id", tx.embedding_input(title, F.col("body"), settings.EMBED_TEXT_CHARS).alias("input"))


@query("txt_17_post_line", """
    select doc_id, concat('Post ', cast(1 + doc_id % 10 as string), ' [', platform, ']',
        case platform when 'reddit' then concat(' r/', author, ' | ↑', cast(score as string), ' | ', cast(comments as string), ' comments')
                      when 'youtube' then concat(' ', author, ' | ', cast(score as string), ' views') else '' end,
        ':', chr(10), case when length(body) > 500 then concat(substring(body, 1, 500), '...') else body end, chr(10)) as line from @posts""")
def post_line(t):
    c = F.col
    return t.posts.select("doc_id", tx.post_line(1 + c("doc_id") % 10, c("platform"), c("author"), c("author"), c("score"),
                                                 c("comments"), c("body")).alias("line"))


@query("txt_18_topics", r"""
    with a as (select doc_id, [concat('  ', text), replace(text, ' ', '  '), '', lang, concat(lang, ' ')] as topics from documents),
    n as (select doc_id, list_slice(list_filter(list_transform(topics, lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> ''), 1, 3) as l from a)
    select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as topics from n""")
def topics(t):
    head = F.col("text")
    raw = F.array(F.concat(F.lit("  "), head), F.replace(head, F.lit(" "), F.lit("  ")), F.lit(""), "lang", F.concat("lang", F.lit(" ")))
    return t.documents.select("doc_id", F.array_join(tx.normalize_topics(raw, 3), "|").alias("topics"))


@query("txt_19_tags", r"""
    with a as (select doc_id, list_filter(list_transform(string_split(concat('#', lang, ', ', source, ',##', lang, ',, #'), ','),
                   lambda x: trim(ltrim(trim(x), '#'))), lambda x: x <> '') as l from documents)
    select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as tags from a""")
def tag_list(t):
    csv = F.concat(F.lit("#"), "lang", F.lit(", "), "source", F.lit(",##"), "lang", F.lit(",, #"))
    return t.documents.select("doc_id", F.array_join(tx.split_tags(csv), "|").alias("tags"))


FRAGMENTS["signal_texts"] = """select *, concat_ws(' | ', nullif(entity, ''), nullif(pain_point, ''), nullif(feature_request, ''), nullif(summary, '')) as signal_text from @signals"""


@query("txt_20_signal_text", "select cluster_id, signal_text from @signal_texts")
def signal_texts(t):
    return t.signals.select("cluster_id", tx.signal_text(*[F.col(c) for c in ("entity", "pain_point", "feature_request", "summary")]).alias("signal_text"))


@query("txt_21_hash_ids", "select doc_id, concat('sig_', substring(sha256(title), 1, 12)) as signal_id, sha256(lower(trim(title))) as topic_id, sha256(concat(platform, ':', native_id)) as hashed_id from @posts")
def hash_ids(t):
    c = F.col
    return t.posts.select("doc_id", tx.signal_id(c("title")).alias("signal_id"), tx.topic_id(c("title")).alias("topic_id"),
                          tx.platform_hash(c("platform"), c("native_id")).alias("hashed_id"))


@query("dat_01_parse_moment", f"""
    select doc_id, case when doc_id % 6 in (0, 5) then {AS_OF_SECONDS} when doc_id % 6 = 3 then {AS_OF_SECONDS} - (doc_id % 20) * 604800
        when doc_id % 6 = 4 then {AS_OF_SECONDS} - (doc_id % 20) * 2592000 else created_s end as parsed_s from @posts""")
def parse_moment(t):
    n = (F.col("doc_id") % 20).cast("string")
    raw = (F.when(F.col("doc_id") % 6 == 0, F.lit("junk")).when(F.col("doc_id") % 6 == 1, F.concat("created_day", F.lit("T00:00:00.000Z")))
           .when(F.col("doc_id") % 6 == 2, F.concat("created_day", F.lit("T02:00:00+02:00")))
           .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("Streamed "), n, F.lit(" weeks ago")))
           .when(F.col("doc_id") % 6 == 4, F.concat(n, F.lit("mo ago"))))
    return t.posts.select("doc_id", F.unix_seconds(mo.parse_moment(raw, as_of())).alias("parsed_s"))


@query("dat_02_age_days", f"select doc_id, greatest(0, ({AS_OF_SECONDS - 864000} - created_s) / 86400.0)::double as days from @posts")
def age_days(t):
    return t.posts.select("doc_id", mo.age_days(F.timestamp_seconds("created_s"), F.timestamp_seconds(F.lit(AS_OF_SECONDS - 864000))).alias("days"))


@query("dat_03_display_time", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as shown from events")
def display_time(t):
    return t.events.select("event_id", mo.display_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("shown"))


FRAGMENTS["engagement"] = f"""
    select *, round(ln(1 + greatest(0, case when platform in ('reddit', 'hackerNews') then score + comments * 2.0::double
        when platform = 'youtube' then score * 0.02::double + comments * 2.0::double else score + comments end))
        * exp(-0.05::double * greatest(0, ({AS_OF_SECONDS} - created_s) / 86400.0::double)), 4) as engagement from @posts"""


@query("mth_01_engagement", "select doc_id, engagement from @engagement")
def engagement(t):
    c = F.col
    return t.posts.select("doc_id", sc.engagement(c("platform"), c("score"), c("comments"), F.timestamp_seconds("created_s"), as_of()).alias("engagement"))


@query("mth_02_velocity", f"select doc_id, round((score + comments) / greatest(({AS_OF_SECONDS} - created_s) / 3600.0::double, 1), 2) as velocity from @posts")
def velocity(t):
    return t.posts.select("doc_id", sc.engagement_velocity(F.col("score"), F.col("comments"), F.timestamp_seconds("created_s"), as_of()).alias("velocity"))


@query("mth_03_clamp", "select event_id, round(greatest(0, least(1, value / 37 - 0.2)), 4) as clamped from events")
def clamp(t):
    return t.events.select("event_id", F.round(sc.clamp01(F.col("value") / 37 - 0.2), 4).alias("clamped"))


@query("mth_04_min_max", """
    with x as (select user_id, min(value) as lo, max(value) as hi from events group by user_id)
    select event_id, round(case when hi > lo then (value - lo) / (hi - lo) else value end, 6) as scaled from events join x using (user_id)""")
def min_max(t):
    df = sc.with_extent(t.events, ["user_id"], v="value")
    return df.select("event_id", F.round(sc.min_max(F.col("value"), F.col("v_min"), F.col("v_max")), 6).alias("scaled"))


@query("mth_05_share_of_max", """
    with x as (select user_id, max(value) as hi from events group by user_id)
    select event_id, round(case when hi > 0 then value / hi else 0 end, 6) as share from events join x using (user_id)""")
def share_of_max(t):
    df = sc.with_extent(t.events, ["user_id"], v="value")
    return df.select("event_id", F.round(sc.share_of_max(F.col("value"), F.col("v_max")), 6).alias("share"))


def _reply(t):
    """Replies of every form a model may give: bare, fenced, a list, an empty list, broken, missing."""
    body = F.to_json(F.struct(F.col("entity"), F.col("pain_point"), F.col("sentiment"), F.col("summary")))
    n = F.col("cluster_id") % 6
    return (F.when(n == 0, body).when(n == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")))
            .when(n == 2, F.concat(F.lit("["), body, F.lit("]"))).when(n == 3, F.lit("[]")).when(n == 4, F.substring(body, 1, 12)))


@query("jsn_01_reply_document", """
    select cluster_id, cluster_id % 6 < 4 as readable,
           case when cluster_id % 6 < 3 then entity when cluster_id % 6 = 3 then '' end as entity,
           case when cluster_id % 6 < 3 then sentiment when cluster_id % 6 = 3 then 'neutral' end as sentiment,
           case when cluster_id % 6 < 4 then 'discussion' end as intent from @signals""")
def reply_document(t):
    d = t.signals.withColumn("doc", js.reply_document(_reply(t)))
    read = F.col("doc").isNotNull()
    pick = lambda name, default: F.when(read, js.text_field(F.col("doc"), f"$.{name}", default)).alias(name)
    return d.select("cluster_id", read.alias("readable"), pick("entity", ""), pick("sentiment", "neutral"), pick("intent", "discussion"))


@query("jsn_02_intent_reply", """
    select doc_id, concat('q', lang) as original_query,
           case when doc_id % 4 = 3 then 'General' when doc_id % 4 = 1 then 'General' else lang end as category,
           case when doc_id % 4 = 0 then 'news' else 'topic' end as intent,
           case doc_id % 4 when 0 then least(1, n_chars / 1000.0)::double when 1 then 0.5 when 2 then 0.0 else 0.3 end as confidence from documents""")
def intent_reply(t):
    n = F.col("doc_id") % 4
    raw = (F.when(n == 0, F.concat(F.lit('note {"category": " '), "lang", F.lit(' ", "intent": "news", "confidence": '), (F.col("n_chars") / 1000).cast("string"), F.lit("} end")))
           .when(n == 1, F.lit('{"category": 5, "intent": "other", "confidence": "0.9"}'))
           .when(n == 2, F.concat(F.lit('{"category": "'), "lang", F.lit('", "confidence": -2}')))
           .otherwise(F.concat(F.lit("no json "), "lang")))
    return t.documents.select("doc_id", js.intent_reply(raw, F.concat(F.lit("q"), "lang")).alias("r")).select("doc_id", "r.*")


@query("jsn_03_subtopics", "select doc_id, case when doc_id % 3 = 0 then concat(lang, '|', source) else '' end as subtopics from documents")
def subtopics(t):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('x {"subtopics": ["'), "lang", F.lit('", 7, null, "'), "source", F.lit('"]} y'))).when(
        F.col("doc_id") % 3 == 1, F.lit('{"subtopics": 4}')).otherwise(F.col("lang"))
    return t.documents.select("doc_id", F.array_join(js.subtopic_reply(raw), "|").alias("subtopics"))


@query("jsn_05_metadata", "select vec_id, cast(json_extract(to_json({'label': label, 'kind': 'k'}), '$.label') as bigint) as label, 'k' as kind from embeddings")
def metadata(t):
    packed = t.embeddings.select("vec_id", F.to_json(F.struct("label", F.lit("k").alias("kind"))).alias("metadata"))
    schema = T.StructType([T.StructField("label", T.LongType()), T.StructField("kind", T.StringType())])
    return packed.select("vec_id", F.from_json("metadata", schema).alias("m")).select("vec_id", "m.label", "m.kind")


@query("arr_01_any_of", "select cluster_id, intent in ('question', 'discussion', 'comparison') as asks from @signals")
def any_of(t):
    wanted = F.array(*[F.lit(i) for i in ("question", "discussion", "comparison")])
    return t.signals.select("cluster_id", F.arrays_overlap(F.array("intent"), wanted).alias("asks"))
