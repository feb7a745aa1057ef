"""Queries: signals from prompt to synthesis."""

from pyspark.sql import functions as F

from pulseloom.operators import components as co, signals as sg
from pulseloom.plans.q_aggregates import clustered
from pulseloom.plans.registry import FRAGMENTS, query

PROMPT = sg.PROMPT.replace("\n", "' || chr(10) || '")
ODD = sg.ODD_PROMPT.replace("\n", "' || chr(10) || '")


def cluster_posts(t):
    c = clustered(t)
    return c.select("session_id", (F.col("doc_id") % 5 - 1).alias("cluster_id"), F.col("doc_id").alias("ord"), F.col("platform").alias("source"),
                    F.col("author").alias("subreddit"), F.col("author").alias("channel"), "score", F.col("comments").alias("num_comments"), "text",
                    "relevance_score", "rerank_score", "engagement")


FRAGMENTS["cluster_posts"] = """
    select session_id, doc_id % 5 - 1 as cluster_id, doc_id as ord, platform as source, author, score, comments, body as text, comments / 100.0::double as rel,
           score / 700.0::double as eng, row_number() over (partition by session_id, doc_id % 5 order by comments desc, doc_id) as rank from @posts"""
FRAGMENTS["cluster_facts"] = """
    select session_id, cluster_id, count(*) as n, array_to_string(list_sort(list(distinct source)), ', ') as sources, avg(rel) as rel, avg(eng) as eng,
           list(case when length(text) > 280 then concat(trim(substring(text, 1, 280)), '...') else trim(substring(text, 1, 280)) end order by rank) filter (where rank <= 5) as quotes
    from @cluster_posts group by session_id, cluster_id"""


def _prompt_sql() -> str:
    fill = lambda p: "'" + p.replace("{seed}", "' || 'topic ' || f.session_id || '").replace("{n}", "' || f.n || '").replace(
        "{sources}", "' || f.sources || '").replace("{posts}", "' || l.posts || '") + "'"
    return f"""
    with l as (select session_id, cluster_id, string_agg(concat('Post ', cast(rank as string), ' [', source, ']',
            case source when 'reddit' then concat(' r/', author, ' | ↑', cast(score as string), ' | ', cast(comments as string), ' comments')
                        when 'youtube' then concat(' ', author, ' | ', cast(score as string), ' views') else '' end,
            ':', chr(10), case when length(text) > 500 then concat(substring(text, 1, 500), '...') else text end, chr(10)), chr(10) order by rank) as posts
        from @cluster_posts where rank <= 10 group by session_id, cluster_id)
    select f.session_id, f.cluster_id, f.cluster_id = -1 as is_anomaly,
           case when f.cluster_id = -1 then {fill(ODD)} else {fill(PROMPT)} end as prompt
    from @cluster_facts f join l on l.session_id = f.session_id and l.cluster_id = f.cluster_id"""


def seeds(df):
    return df.select("session_id").distinct().withColumn("seed", F.concat(F.lit("topic "), F.col("session_id").cast("string")))


@query("sig_01_prompts", _prompt_sql())
def prompts(t):
    posts = cluster_posts(t)
    return sg.cluster_prompts(posts, seeds(posts))


REPLY_KIND = "(session_id * 5 + cluster_id + 1) % 4"


def extracted(t):
    posts = cluster_posts(t)
    kind = F.expr(REPLY_KIND)
    body = F.concat(F.lit('{"entity": "e'), F.col("cluster_id").cast("string"), F.lit('", "summary": "s", "intent": "question"}'))
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.lit("not json {"))
    replies = posts.select("session_id", "cluster_id").distinct().withColumn("reply", reply).filter(kind < 3)
    return sg.extract_signals(posts, replies)


@query("sig_02_extract", f"""
    select session_id, cluster_id, cluster_id = -1 as is_anomaly, case when k < 2 then concat('e', cast(cluster_id as string)) else '' end as entity,
           case when k < 2 then 'neutral' else '' end as sentiment, case when k < 2 then 'question' else '' end as intent,
           case when k < 2 then 's' when k = 2 then concat('Cluster of ', cast(n as string), ' items (LLM extraction failed)') else concat('Cluster of ', cast(n as string), ' items (LLM error)') end as summary,
           n as evidence_count, sources, case when k < 2 then array_to_string(quotes, '|') else '' end as quotes,
           round(case when k < 3 then rel else 0 end, 6) as avg_relevance, round(case when k < 3 then eng else 0 end, 6) as avg_engagement
    from (select *, {REPLY_KIND} as k from @cluster_facts)""")
def extract(t):
    s = extracted(t)
    return s.select("session_id", "cluster_id", "is_anomaly", "entity", "sentiment", "intent", "summary", "evidence_count",
                    F.array_join("sources", ", ").alias("sources"), F.array_join("representative_quotes", "|").alias("quotes"),
                    F.round("avg_relevance", 6).alias("avg_relevance"), F.round("avg_engagement", 6).alias("avg_engagement"))


@query("sig_03_quotes", "select session_id, cluster_id, array_to_string(quotes, '|') as quotes from @cluster_facts")
def quotes(t):
    from pulseloom.operators.aggregates import cluster_quotes
    q = cluster_quotes(cluster_posts(t), keys=["session_id", "cluster_id"], ordinal="ord")
    return q.select("session_id", "cluster_id", F.array_join("quotes", "|").alias("quotes"))


def merged(t):
    s = t.signals.withColumn("sources", F.array_distinct(F.array("source_a", "source_b"))).withColumn("representative_quotes", F.array("quote"))
    groups = co.merge_groups(s, 0.35, keys=["session_id"], id_col="cluster_id", vec_col="embedding", flag_col="is_anomaly")
    return sg.merge_signals(s, groups)


FRAGMENTS["merged"] = """
    with g as (select s.*, c.component from @signal_texts s join @components c on c.session_id = s.session_id and c.cluster_id = s.cluster_id),
    m as (select session_id, component, sentiment from (select *, row_number() over (partition by session_id, component order by n desc, first) as rn from (
        select session_id, component, sentiment, count(*) as n, min(cluster_id) as first from g group by all)) where rn = 1)
    select g.session_id, g.component, any_value(m.sentiment) as sentiment, bool_or(is_anomaly) as is_anomaly, sum(evidence_count)::bigint as evidence_count,
           list_sort(list(distinct entity)) as entities, coalesce(list_sort(list(distinct pain_point) filter (where pain_point <> '')), []) as pain_points,
           coalesce(list_sort(list(distinct feature_request) filter (where feature_request <> '')), []) as feature_requests, list_sort(list(distinct intent)) as intents,
           list_sort(list_distinct(flatten(list([source_a, source_b])))) as sources, list(quote order by cluster_id)[1:5] as quotes,
           avg(avg_relevance) as rel, avg(avg_engagement) as eng, arg_max(summary, evidence_count * 1000000000 - cluster_id) as summary,
           concat('sig_', substring(sha256(arg_max(signal_text, evidence_count * 1000000000 - cluster_id)), 1, 12)) as signal_id
    from g join m on m.session_id = g.session_id and m.component = g.component group by g.session_id, g.component"""


@query("sig_05_merge", """
    select session_id, component, signal_id, sentiment, is_anomaly, evidence_count, array_to_string(entities, ',') as entities, array_to_string(pain_points, ',') as pain_points,
           array_to_string(feature_requests, ',') as feature_requests, array_to_string(intents, ',') as intents, array_to_string(sources, ',') as sources,
           array_to_string(quotes, '|') as quotes, summary, round(rel, 6) as avg_relevance, round(eng, 6) as avg_engagement from @merged""")
def merge(t):
    m = merged(t)
    lists = [F.array_join(c, ",").alias(c) for c in ("entities", "pain_points", "feature_requests", "intents", "sources")]
    return m.select("session_id", "component", "signal_id", "sentiment", "is_anomaly", "evidence_count", *lists,
                    F.array_join("representative_quotes", "|").alias("quotes"), "summary", F.round("avg_relevance", 6).alias("avg_relevance"),
                    F.round("avg_engagement", 6).alias("avg_engagement"))


FRAGMENTS["components_of_score"] = """
    select m.*, least(rel, 1.0) as c_rel, ln(1 + evidence_count) / ln(1 + x.ev) as c_ev, 0.5::double as c_vel, len(sources) / 3.0::double as c_src,
           case when x.en > 0 then eng / x.en else 0 end as c_eng, 1.0::double - evidence_count / (x.ev + 1)::double as c_nov
    from @merged m join (select session_id, max(evidence_count) as ev, max(eng) as en from @merged group by session_id) x on x.session_id = m.session_id"""
FRAGMENTS["scored"] = "select *, round(0.3 * c_rel + 0.2 * c_ev + 0.15 * c_vel + 0.15 * c_src + 0.1 * c_eng + 0.1 * c_nov, 4)::double as score from @components_of_score"
PARTS = {"c_rel": "relevance", "c_ev": "evidence", "c_vel": "velocity", "c_src": "source_spread", "c_eng": "engagement", "c_nov": "novelty"}


@query("sig_06_components", "select component, " + ", ".join(f"round({c}, 4)::double as {n}_component" for c, n in PARTS.items()) + " from @components_of_score")
def score_components(t):
    return sg.score_signals(merged(t)).select("component", *[f"{n}_component" for n in PARTS.values()])


@query("sig_07_final_score", "select signal_id, component, score as final_score from @scored")
def final_score(t):
    return sg.score_signals(merged(t)).select("signal_id", "component", "final_score").orderBy(F.desc("final_score"), "signal_id")


FRAGMENTS["entries"] = """
    select session_id, signal_id, 'pain_point' as kind, unnest(pain_points) as value, score, is_anomaly from @scored
    union all select session_id, signal_id, 'feature_request', unnest(feature_requests), score, is_anomaly from @scored
    union all select session_id, signal_id, 'question', '', score, is_anomaly from @scored where list_has_any(intents, ['question', 'discussion', 'comparison'])"""


@query("sig_08_entries", "select session_id, signal_id, kind, value, score from @entries")
def entries(t):
    return sg.signal_entries(sg.score_signals(merged(t))).select("session_id", "signal_id", "kind", "value", "score")


FRAGMENTS["top_entries"] = """select session_id, kind, list(concat(signal_id, ':', value) order by rank) as l from (
    select *, row_number() over (partition by session_id, kind order by score desc, signal_id, value) as rank from @entries)
    where rank <= case kind when 'pain_point' then 6 when 'feature_request' then 4 else 8 end group by session_id, kind"""


@query("sig_09_payload", """
    select s.session_id, concat('topic ', cast(s.session_id as string)) as topic, s.total_evidence, s.total_signals, s.top_signal_score,
        (select array_to_string(l, ',') from @top_entries e where e.session_id = s.session_id and kind = 'pain_point') as pains,
        (select array_to_string(l, ',') from @top_entries e where e.session_id = s.session_id and kind = 'feature_request') as requests,
        (select array_to_string(l, ',') from @top_entries e where e.session_id = s.session_id and kind = 'question') as questions,
        (select string_agg(quotes[1], ',' order by rank) from (select *, row_number() over (partition by session_id order by score desc, signal_id) as rank from @scored) q where q.session_id = s.session_id and rank <= 5) as quotes
    from (select session_id, sum(evidence_count)::bigint as total_evidence, count(*) as total_signals, max(score) as top_signal_score from @scored group by session_id) s""")
def payload(t):
    m = merged(t)
    a = sg.compress(sg.score_signals(m), seeds(m))
    joined = lambda name: F.array_join(F.transform(name, lambda e: F.concat(e["signal_id"], F.lit(":"), e["value"])), ",")
    return a.select("session_id", "topic", "total_evidence", "total_signals", "top_signal_score", joined("top_pain_points").alias("pains"),
                    joined("top_feature_requests").alias("requests"), joined("top_questions").alias("questions"),
                    F.array_join(F.transform("representative_quotes", lambda q: q["text"]), ",").alias("quotes"))


@query("sig_10_synthesis_input", """
    select s.session_id, concat('topic ', cast(s.session_id as string)) as topic, 0::bigint as left_out,
           string_agg(signal_id, ',' order by score desc, signal_id) filter (score >= 0.4 or is_anomaly) as signals from @scored s group by s.session_id""")
def synthesis_input(t):
    m = merged(t)
    scored = sg.score_signals(m)
    payloads = sg.synthesis_payloads(sg.compress(scored, seeds(m)), scored, min_score=0.4, limit=1 << 30)
    read = F.from_json("payload", "topic string, signals_left_out bigint, signals array<struct<signal_id: string>>")
    return payloads.select("session_id", read.alias("p")).select("session_id", "p.topic", F.col("p.signals_left_out").alias("left_out"),
                                                                 F.array_join(F.col("p.signals.signal_id"), ",").alias("signals"))


@query("sig_11_catchers", """
    select doc_id as session_id, place, lang as trend, case when place = 0 then 'reddit' else '' end as platform, 'rising' as status, case when place = 0 then n_chars else 0 end as views,
           case when place = 0 then 0.5 else 0.0 end::double as engagement_rate, case when place = 0 then concat('reddit_', cast(doc_id as string)) else '' end as evidence
    from documents, (values (0), (1)) p(place) where doc_id % 4 = 0""")
def catchers(t):
    d = t.documents
    n = F.col("doc_id") % 4
    good = F.concat(F.lit('{"trend_catchers": [{"trend": "'), "lang", F.lit('", "platform": "reddit", "metrics": {"views": '), F.col("n_chars").cast("string"),
                    F.lit(', "engagement_rate": 0.5, "likes": null}, "evidence_ids": ["reddit_'), F.col("doc_id").cast("string"), F.lit('"]}, {"trend": "'), "lang", F.lit('"}]}'))
    reply = F.when(n == 0, good).when(n == 1, F.lit('{"trend_catchers": [{"trend": "x", "confidence": "certain"}]}')).when(n == 2, F.lit("broken {"))
    c = sg.trend_catchers(d.select(F.col("doc_id").alias("session_id"), reply.alias("reply")))
    return c.select("session_id", "place", "trend", "platform", "status", "metrics.views", "metrics.engagement_rate", F.array_join("evidence_ids", ",").alias("evidence"))


@query("jsn_04_hydrate", "select doc_id as session_id, cast(0 as bigint) as impressions, n_chars as likes, 0.0::double as engagement_rate, '' as velocity, 'mainstream' as trend_type, 'medium' as confidence from documents")
def hydrate(t):
    reply = F.concat(F.lit('{"trend_catchers": [{"metrics": {"impressions": null, "likes": '), F.col("n_chars").cast("string"), F.lit("}}]}"))
    c = sg.trend_catchers(t.documents.select(F.col("doc_id").alias("session_id"), reply.alias("reply")))
    return c.select("session_id", "metrics.impressions", "metrics.likes", "metrics.engagement_rate", "metrics.velocity", "trend_type", "confidence")


@query("sig_12_run_usage", """
    select session_id, 'relevance' as stage, sum(floor(length(body) / 4))::bigint as total_tokens from @posts group by session_id
    union all select session_id, 'extract', sum(score + comments)::bigint from @posts group by session_id""")
def run_usage(t):
    replies = t.posts.select("session_id", F.lit("m").alias("model"), F.col("score").alias("prompt_tokens"), F.col("comments").alias("output_tokens"))
    usage = sg.run_usage(relevance=sg.embedding_usage(t.posts, "body"), extract=replies)
    return usage.groupBy("session_id", "stage").agg(F.sum("total_tokens").alias("total_tokens"))
