"""Queries: aggregations."""

from pyspark.sql import functions as F

from pulseloom.operators import aggregates as ag
from pulseloom.plans.registry import FRAGMENTS, query

SUMS = "sum(prompt_tokens)::bigint as prompt_tokens, sum(output_tokens)::bigint as output_tokens, sum(coalesce(total_tokens, 0))::bigint as total_tokens"


@query("agg_01_tokens_by_model", f"select session_id, model, {SUMS} from @usage group by session_id, model")
def tokens_by_model(t):
    return ag.token_totals(t.usage, "model")


@query("agg_02_tokens_by_stage", f"select session_id, stage, {SUMS} from @usage group by session_id, stage")
def tokens_by_stage(t):
    return ag.token_totals(t.usage, "stage")


@query("agg_03_token_report", f"""
    select 'model' as level, session_id, null as stage, model, {SUMS} from @usage group by session_id, model
    union all select 'stage', session_id, stage, null, {SUMS} from @usage group by session_id, stage
    union all select 'TOTAL', session_id, null, null, {SUMS} from @usage group by session_id""")
def token_report(t):
    return ag.token_report(t.usage)


@query("agg_04_candidate_counts", """
    with c as (select *, case source when 'llm' then 'structure' else 'demand' end as kind from @candidates)
    select session_id, source, kind, count(*) as n, count(*) filter (where trend_signal = 'rising') as rising from c
    group by grouping sets ((session_id, source, kind), (session_id, source), (session_id, kind), (session_id))""")
def candidate_counts(t):
    from pulseloom.operators.expansion import kind_of
    return ag.candidate_counts(t.candidates.withColumn("kind", kind_of(F.col("source"))), ["session_id"])


@query("agg_05_harvest_counts", "select session_id, query, platform, sum(result_count)::bigint as items from @harvest group by session_id, query, platform")
def harvest_counts(t):
    return ag.harvest_counts(t.harvest)


FRAGMENTS["clustered"] = "select *, doc_id % 37 - 1 as cluster_id, comments / 100.0::double as relevance_score, score / 700.0::double as eng from @posts"


def clustered(t):
    return t.posts.withColumn("cluster_id", F.col("doc_id") % 37 - 1).withColumn("relevance_score", F.col("comments") / 100).withColumn(
        "engagement", F.col("score") / 700).withColumn("rerank_score", F.lit(0.0)).withColumn("text", F.col("body"))


@query("agg_06_cluster_summary", """
    select c.cluster_id, count(*) as evidence_count, array_to_string(list_sort(list(distinct platform)), ',') as sources,
           round(avg(relevance_score), 6) as avg_relevance, round(avg(eng), 6) as avg_engagement from @clustered c group by c.cluster_id""")
def cluster_summary(t):
    s = ag.cluster_summary(clustered(t), keys=["cluster_id"], source="platform")
    return s.withColumn("sources", F.array_join("sources", ",")).withColumn("avg_relevance", F.round("avg_relevance", 6)).withColumn(
        "avg_engagement", F.round("avg_engagement", 6))


@query("agg_07_merge_aggregate", """
    with g as (select *, cluster_id % 50 as grp from @signals),
    s as (select grp, sentiment, count(*) as n, min(cluster_id) as first from g group by grp, sentiment),
    m as (select grp, sentiment from (select *, row_number() over (partition by grp order by n desc, first) as rn from s) where rn = 1)
    select g.grp, array_to_string(list_sort(list(distinct entity)), ',') as entities, sum(evidence_count)::bigint as evidence_count,
           round(avg(avg_relevance), 6) as avg_relevance, any_value(m.sentiment) as sentiment,
           arg_max(summary, evidence_count * 1000000 - cluster_id) as summary, bool_or(is_anomaly) as is_anomaly
    from g join m on m.grp = g.grp group by g.grp""")
def merge_aggregate(t):
    from pulseloom.operators.signals import merge_aggregate as merge
    s = t.signals.withColumn("component", F.col("cluster_id") % 50).withColumn("sources", F.array("source_a", "source_b")).withColumn(
        "representative_quotes", F.array("quote"))
    m = merge(s, keys=["component"], ordinal="cluster_id")
    return m.select(F.col("component").alias("grp"), F.array_join("entities", ",").alias("entities"), "evidence_count",
                    F.round("avg_relevance", 6).alias("avg_relevance"), "sentiment", "summary", "is_anomaly")


@query("agg_08_global_stats", """
    select session_id, sum(evidence_count)::bigint as total_evidence, count(*) as total_signals, max(avg_relevance)::double as top_signal_score,
           array_to_string(list_sort(list_distinct(flatten(list([source_a, source_b])))), ',') as sources from @signals group by session_id""")
def global_stats(t):
    from pulseloom.operators.signals import global_stats as stats
    s = t.signals.withColumn("sources", F.array("source_a", "source_b")).withColumn("final_score", F.col("avg_relevance").cast("double"))
    return stats(s).select("session_id", "total_evidence", "total_signals", "top_signal_score", F.array_join("sources", ",").alias("sources"))


@query("agg_11_outcome_tally", """
    select stage, count(*) filter (where status = 'completed') as succeeded, count(*) filter (where status <> 'completed') as failed,
           count(*) filter (where status <> 'completed' and l_suppkey % 3 < 2) as rate_limited, count(*) as total from @runs group by stage""")
def outcome_tally(t):
    kinds = F.when(F.col("l_suppkey") % 3 == 0, "Rate limit exceeded").when(F.col("l_suppkey") % 3 == 1, "status 429").otherwise("timeout")
    return ag.outcome_tally(t.runs.withColumn("error", F.when(F.col("status") != "completed", kinds)), ["stage"])


@query("agg_12_mean_words", r"""
    select role, round(avg(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))), 6) as mean_words from conversations group by role""")
def mean_words(t):
    return ag.mean_words(t.conversations, "text", ["role"]).withColumn("mean_words", F.round("mean_words", 6))


@query("agg_13_cluster_sizes", "select session_id, cluster_id, count(*) as size, cluster_id = -1 as is_noise from @clustered group by session_id, cluster_id")
def cluster_sizes(t):
    return ag.cluster_sizes(clustered(t), ["session_id"])


@query("arr_02_first_quotes", """
    select conv_id, array_to_string(list(text order by turn)[1:5], ' / ') as quotes from conversations group by conv_id""")
def first_quotes(t):
    from pulseloom.operators.signals import first_quotes as quotes
    c = t.conversations.select("conv_id", "turn", F.array("text").alias("q"))
    return quotes(c, keys=["conv_id"], ordinal="turn", quotes="q").select("conv_id", F.array_join("quotes", " / ").alias("quotes"))


@query("arr_03_source_union", """
    select session_id, array_to_string(list_sort(list_distinct(flatten(list([source_a, source_b])))), ',') as sources from @signals group by session_id""")
def source_union(t):
    from pulseloom.operators.signals import distinct_members
    s = t.signals.select("session_id", F.array("source_a", "source_b").alias("sources"))
    return distinct_members(s, ["session_id"], "sources").withColumn("sources", F.array_join("sources", ","))
