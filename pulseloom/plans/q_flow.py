"""Queries: streaming forms and the whole analysis."""

import json

from pyspark.sql import functions as F, types as T

from pulseloom.operators import grouping as gr, signals as sg
from pulseloom.operators.hooks import parse_pages, provide_replies
from pulseloom.plans import flow
from pulseloom.plans.q_filters import platform_frames
from pulseloom.plans.q_sources import fresh_folder
from pulseloom.plans.q_text import as_of
from pulseloom.plans.q_vectors import groups
from pulseloom.plans.registry import query
from pulseloom.streaming import feeds


def canned(prompts):
    """A stand-in for a model: names a signal after the first words of its prompt's first post."""
    out = []
    for p in prompts:
        words = p.split("Post 1 ", 1)[-1].split(":\n", 1)[-1].split()[:3]
        name = " ".join(words)
        reply = {"entity": name, "pain_point": f"{name} is slow", "intent": "question", "sentiment": "mixed", "summary": f"About {name}."}
        out.append((json.dumps(reply), len(p) // 4, 40))
    return out


def canned_catchers(payloads):
    """A stand-in for the closing answer: one catcher per payload, named after its topic."""
    return [(json.dumps({"trend_catchers": [{"trend": p.split('"topic":"', 1)[-1].split('"', 1)[0], "platform": "reddit"}]}), len(p) // 4, 20) for p in payloads]


def run_of(t):
    posts = t.posts
    sessions = posts.select("session_id").distinct()
    queries = posts.filter("doc_id % 100 < 10").select("session_id", F.substring("title", 1, 60).alias("query"))
    return flow.Run(platforms=platform_frames(posts), queries=queries, as_of=as_of(), dims=128, relevance_threshold=0.3, duplicate_threshold=0.8,
                    mmr_k=30, merge_threshold=0.7, replies=lambda prompts: provide_replies(prompts, canned),
                    synthesis=lambda prompts: provide_replies(prompts, canned_catchers),
                    seeds=sessions.withColumn("seed", F.concat(F.lit("topic "), F.col("session_id").cast("string"))))


@query("run_01_analysis")
def analysis(t):
    tables = flow.analyse(t.spark, run_of(t), fresh_folder(t, "analysis"))
    catchers = tables.read("catchers").groupBy("session_id").agg(F.max("trend").alias("trend"), F.count("*").alias("catchers"))
    tokens = tables.read("usage").groupBy("session_id").agg(F.sum("total_tokens").alias("tokens"))
    a = tables.read("analysis").join(catchers, "session_id", "left").join(tokens, "session_id", "left")
    return a.select("trend", "catchers", "tokens", "session_id", "topic", "total_evidence", "total_signals", "top_signal_score", F.array_join("sources", ",").alias("sources"),
                    F.size("top_pain_points").alias("pain_points"), F.size("representative_quotes").alias("quotes"))


KNOWN = """
    known as (select session_id, vec_id, leader_id, leader_id % 5 as cluster_id from @greedy),
    named as (select *, concat('s', (cluster_id % 2)::varchar) as signal_id from known)"""


@query("run_02_evidence", f"""with {KNOWN} select session_id, signal_id, vec_id as post_id, case when vec_id = leader_id then 'member' else 'duplicate' end as kind from named""")
def evidence(t):
    grouped = groups(t)
    members = grouped.filter("vec_id = leader_id").select("session_id", F.col("vec_id").alias("id"), (F.col("vec_id") % 5).alias("cluster_id"))
    clusters = members.select("session_id", "cluster_id").distinct().withColumn("component", F.col("cluster_id") % 2)
    signals = clusters.select("session_id", "component").distinct().withColumn("signal_id", F.concat(F.lit("s"), F.col("component").cast("string")))
    return sg.evidence(members, clusters, signals, gr.children(grouped, keys=["session_id"], id_col="vec_id"))


@query("run_03_documents", """
    select session_id, concat('topic ', session_id::varchar) as topic, concat('topic ', session_id::varchar) as trend, 3 as usage_stages from (select distinct session_id from @posts)""")
def run_documents(t):
    tables = flow.analyse(t.spark, run_of(t), fresh_folder(t, "closing"))
    d = t.spark.read.schema(tables.read("documents").schema).json(f"{tables.folder}/documents_json")
    return d.select("session_id", "topic", F.col("catchers")[0]["trend"].alias("trend"), F.size(F.array_distinct(F.col("usage.stage"))).alias("usage_stages"))


@query("udf_04_page_titles", "select page_id, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&amp;', '&') as title from pages")
def page_titles(t):
    def titles(html_text):
        import html
        import re
        for m in re.finditer(r"<title>([^<]*)</title>", html_text):
            yield {"title": html.unescape(m.group(1))}
    return parse_pages(t.pages, titles, "page_id bigint, title string", ["page_id"])


@query("str_03_mention_growth", """
    with v as (select event_type, date_trunc('day', ts) as d, count(*) as mentions from events group by event_type, d)
    select event_type, epoch(d)::bigint as day_s, mentions, lag(mentions) over (partition by event_type order by d) as previous,
           round((mentions - lag(mentions) over (partition by event_type order by d)) / lag(mentions) over (partition by event_type order by d)::double, 6) as growth from v""")
def mention_growth(t):
    events = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    g = feeds.volume_growth(feeds.mention_volume(events, "event_type", "at"), "event_type")
    return g.select("event_type", F.unix_seconds("window_start").alias("day_s"), "mentions", "previous", F.round("growth", 6).alias("growth"))


def streamed(t, build, mode, name, keys=()):
    """Drive a streaming query over the events file to its end and read what it wrote."""
    schema = t.events.schema
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    folder = fresh_folder(t, name)
    out = build(source.withColumn("at", F.col("ts").cast("timestamp")))

    def keep(batch, epoch):
        # only changed keys, each batch in a folder of its own: a batch that is repeated replaces itself
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    else:
        writer.foreachBatch(keep).start().awaitTermination()
    if mode == "update":
        rows = t.spark.read.schema(T.StructType(out.schema.fields + [T.StructField("epoch", T.LongType())])).parquet(f"{folder}/rows")
        return feeds.latest_of_key(rows, keys, "epoch")
    return t.spark.read.schema(out.schema).parquet(f"{folder}/rows")


@query("str_01_first_seen", "select distinct user_id, event_type from events")
def first_seen(t):
    return streamed(t, lambda s: feeds.first_seen(s, ["user_id", "event_type"], "at", "60 days"), "append", "seen").select("user_id", "event_type")


@query("str_02_running_tokens", "select user_id as session_id, event_type as stage, sum(floor(value * 100)::bigint)::bigint as prompt_tokens, sum(event_id % 500)::bigint as output_tokens from events group by all")
def running_tokens(t):
    usage = lambda s: s.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("stage"), F.lit("m").alias("model"),
                               F.floor(F.col("value") * 100).alias("prompt_tokens"), (F.col("event_id") % 500).alias("output_tokens"), F.lit(0).cast("bigint").alias("total_tokens"))
    return streamed(t, lambda s: feeds.running_tokens(usage(s)), "update", "tokens", ["session_id", "stage"]).select("session_id", "stage", "prompt_tokens", "output_tokens")


# windows that the stream's end has closed; the last one of all stays open
@query("str_03_streamed_growth", """
    with v as (select event_type, date_trunc('day', ts) as d, count(*) as mentions from events group by event_type, d)
    select * from (
        select event_type, epoch(d)::bigint as day_s, mentions, lag(mentions) over (partition by event_type order by d) as previous,
               round((mentions - lag(mentions) over (partition by event_type order by d)) / lag(mentions) over (partition by event_type order by d)::double, 6) as growth from v)
    where day_s + 86400 <= (select epoch(max(ts)) - 3600 from events)""")
def streamed_growth(t):
    g = streamed(t, lambda s: feeds.streamed_growth(s, "event_type", "at"), "append", "growth")
    return g.select("event_type", F.unix_seconds("window_start").alias("day_s"), "mentions", "previous", F.round("growth", 6).alias("growth"))


@query("udf_01_embedder", "select doc_id, length(text)::double as first, 3 as dims from documents")
def own_embedder(t):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from pulseloom.operators.embedding import embed

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else [float(len(x)), 1.0, 0.0])

    e = embed(t.documents, "text", embedder=lengths, dims=3)
    return e.select("doc_id", F.col("vec")[0].alias("first"), F.size("vec").alias("dims"))


@query("udf_02_replies", "select doc_id as session_id, cast(0 as bigint) as cluster_id, upper(lang) as reply, length(lang) as prompt_tokens from documents")
def replies(t):
    prompts = t.documents.select(F.col("doc_id").alias("session_id"), F.lit(0).cast("bigint").alias("cluster_id"), F.col("lang").alias("prompt"))
    r = provide_replies(prompts, lambda texts: [(x.upper(), len(x), 1) for x in texts])
    return r.select("session_id", "cluster_id", "reply", "prompt_tokens")
