"""Queries: ranks and top lists."""

import pandas as pd
from pyspark.sql import functions as F, types as T
from pyspark.sql.functions import pandas_udf

from pulseloom.operators import ranking as rk
from pulseloom.plans.registry import FRAGMENTS, query


@query("rnk_01_harvest_rank", """
    select conv_id, turn, rank from (select *, row_number() over (partition by conv_id order by turn) as rank from conversations) where rank <= 4""")
def harvest_rank(t):
    pages = t.conversations.withColumn("page", F.floor(F.col("turn") / 3)).withColumn("pos", F.col("turn") % 3)
    return rk.harvest_rank(pages, ["conv_id"], "page", "pos", 4).select("conv_id", "turn", "rank")


@query("rnk_02_distinct_rank", """
    with f as (select session_id, native_id, min(query_ord * 1000000000 + pos) as seen_at from @posts_repeat group by session_id, native_id)
    select session_id, native_id, rank from (select *, row_number() over (partition by session_id order by seen_at) as rank from f) where rank <= 60""")
def distinct_rank(t):
    return rk.harvest_rank_distinct(t.posts_repeat, ["session_id"], "native_id", "query_ord", "pos", 60).select("session_id", "native_id", "rank")


FRAGMENTS["query_scores"] = """
    select d.session_id, d.vec_id, max(list_cosine_similarity(d.embedding::double[], q.embedding::double[])) as score
    from @vectors d join @vectors q on d.session_id = q.session_id and q.vec_id % 50 < 5 where d.vec_id % 50 >= 5 group by d.session_id, d.vec_id"""


@query("rnk_03_threshold_or_floor", """
    select session_id, vec_id, round(score, 6) as score from (
        select *, row_number() over (partition by session_id order by score desc, vec_id) as rn from @query_scores) where score >= 0.3 or rn <= 50""")
def threshold_or_floor(t):
    from pulseloom.plans.q_vectors import query_scores
    kept = rk.threshold_or_floor(query_scores(t), 0.3, 50, keys=["session_id"], score="score", ordinal="vec_id")
    return kept.withColumn("score", F.round("score", 6))


@query("rnk_04_top_per_cluster", """
    select cluster_id, doc_id, rank from (select doc_id % 37 as cluster_id, doc_id,
        row_number() over (partition by doc_id % 37 order by greatest(comments / 100.0, score / 5000.0) desc, doc_id) as rank from @posts) where rank <= 10""")
def top_per_cluster(t):
    posts = t.posts.withColumn("cluster_id", F.col("doc_id") % 37).withColumn("rerank_score", F.col("comments") / 100).withColumn(
        "relevance_score", F.col("score") / 5000)
    return rk.top_per_cluster(posts, keys=["cluster_id"], ordinal="doc_id").select("cluster_id", "doc_id", "rank")


@query("rnk_05_top_candidates", """
    select session_id, ord, rank from (select session_id, ord, row_number() over (partition by session_id order by (ord * 37) % 101 desc, ord) as rank from @candidates) where rank <= 10""")
def top_candidates(t):
    scored = t.candidates.withColumn("semantic_score", (F.col("ord") * 37) % 101)
    return rk.top_n(scored, 10, ["session_id"], [F.desc("semantic_score"), F.col("ord")]).select("session_id", "ord", "rank")


@query("rnk_06_top_lists", " union all ".join(f"""
    select '{k}' as kind, session_id, cluster_id, rank from (select session_id, cluster_id,
        row_number() over (partition by session_id order by avg_relevance desc, cluster_id) as rank from @signals where {w}) where rank <= {n}"""
    for k, w, n in (("pain_point", "pain_point <> ''", 6), ("feature_request", "feature_request <> ''", 4),
                    ("question", "intent in ('question', 'discussion', 'comparison')", 8))))
def top_lists(t):
    out = None
    for kind, where, n in (("pain_point", "pain_point <> ''", 6), ("feature_request", "feature_request <> ''", 4),
                           ("question", "intent in ('question', 'discussion', 'comparison')", 8)):
        part = rk.top_n(t.signals.filter(where), n, ["session_id"], [F.desc("avg_relevance"), F.col("cluster_id")]).select(
            F.lit(kind).alias("kind"), "session_id", "cluster_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


@pandas_udf(T.DoubleType())
def shared_letters(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """A stand-in pair scorer: the share of the query's letters that occur in the text."""
    return pd.Series([len(set(q) & set(x)) / max(len(set(q)), 1) for q, x in zip(queries, texts)], dtype="float64")


@query("rnk_07_rerank", """
    select session_id, doc_id, round(s, 6) as rerank_score from (select *, row_number() over (partition by session_id order by s desc, doc_id) as rn from (
        select session_id, doc_id, len(list_intersect(string_split(query, ''), string_split(text, ''))) / len(list_distinct(string_split(query, '')))::double as s
        from (select p.session_id, p.doc_id, p.query, d.text from @posts p join documents d using (doc_id)))) where rn <= 20""")
def rerank(t):
    posts = t.posts.select("session_id", "doc_id", "query").join(t.documents.select("doc_id", "text"), "doc_id")
    kept = rk.rerank(posts, shared_letters, 20, keys=["session_id"], query="query", text="text", ordinal="doc_id")
    return kept.select("session_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


@query("rnk_08_run_listing", """
    select session_id, id, row_number() over (partition by session_id order by started_at, id) as rank from @runs""")
def run_listing(t):
    return rk.placed(t.runs, ["session_id"], ["started_at", "id"]).select("session_id", "id", "rank")


@query("rnk_09_latest", """
    select session_id, l_partkey, l_suppkey from (select *, row_number() over (partition by session_id order by started_at desc, id desc) as rn from @runs) where rn = 1""")
def latest(t):
    return rk.latest(t.runs, ["session_id"], [F.desc("started_at"), F.desc("id")]).select("session_id", "l_partkey", "l_suppkey")
