"""The given tables in the shapes the operators work on.

Each adapter is one SELECT that Spark and a plain SQL engine read alike; ``{name}`` stands for a table or another
adapter. The clock of all of them is 2024-01-31 00:00:00 UTC.
"""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
AS_OF_SECONDS = 1706659200

ADAPTERS = {
    # documents as harvested posts: sessions of 100 documents, ten queries each, four platforms in turn
    "posts": """
        select doc_id, cast(floor(doc_id / 100) as bigint) as session_id, cast(doc_id % 10 as bigint) as query_ord,
               cast(doc_id % 4 as bigint) as platform_ord, doc_id as pos,
               case doc_id % 4 when 0 then 'reddit' when 1 then 'youtube' when 2 then 'hackerNews' else 'instagram' end as platform,
               concat('query ', cast(doc_id % 10 as string)) as query,
               concat('d', cast(doc_id as string)) as native_id,
               case when doc_id % 23 = 0 then 'AutoModerator' else concat('user', cast(doc_id % 50 as string)) end as author,
               substring(text, 1, 60) as title,
               case when doc_id % 17 = 0 then '' when doc_id % 19 = 0 then '[deleted]'
                    when doc_id % 5 = 0 then concat(text, ' #AICodingTools 🚀 see https://example.com/x wow!!! &amp; more')
                    else text end as body,
               (n_chars * 7) % 5000 as score, n_chars % 97 as comments,
               1706572800 - (doc_id % 30) * 86400 as created_s,
               concat('2024-01-', lpad(cast(30 - doc_id % 30 as string), 2, '0')) as created_day,
               case when doc_id % 3 = 0 then concat('/r/sub/', cast(doc_id as string))
                    when doc_id % 3 = 1 then concat('https://host.example/p/', cast(doc_id as string)) else '' end as link
        from {documents}""",
    # the same posts, every seventh found again by the next query
    "posts_repeat": """
        select * from {posts}
        union all
        select doc_id, session_id, query_ord + 1 as query_ord, platform_ord, pos, platform,
               concat('query ', cast(query_ord + 1 as string)) as query, native_id, author, title, body,
               score, comments, created_s, created_day, link from {posts} where doc_id % 7 = 0""",
    "usage": """
        select event_id, user_id as session_id, event_type as stage, concat('m', cast(event_id % 3 as string)) as model,
               cast(floor(value * 100) as bigint) as prompt_tokens, event_id % 500 as output_tokens,
               case when event_id % 11 = 0 then null else cast(floor(value * 100) as bigint) + event_id % 500 end as total_tokens,
               ts as created_at
        from {events}""",
    "sessions": """
        select o_orderkey as id, o_custkey as user_id, concat('topic ', cast(o_orderkey % 200 as string)) as query,
               o_orderstatus as status, o_totalprice as price, o_orderdate as created_at
        from {orders}""",
    "runs": """
        select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-',
                      cast(cast(round(l_extendedprice * 100) as bigint) as string), '-', cast(cast(round(l_discount * 100 + l_tax * 10000) as bigint) as string)) as id,
               l_orderkey as session_id, l_linenumber as attempt,
               case (l_linenumber - 1) % 4 when 0 then 'intent_analysis' when 1 then 'topic_expansion'
                    when 2 then 'collection' else 'python_analysis' end as stage,
               case when l_linestatus = 'F' then 'completed' else 'failed' end as status,
               l_partkey, l_suppkey, l_quantity, l_shipdate as started_at
        from {lineitem}""",
    "harvest": """
        select l_orderkey as session_id, concat('t', cast(l_partkey % 50 as string)) as query, l_partkey as topic_id,
               case l_returnflag when 'A' then 'reddit' when 'N' then 'youtube' else 'hackerNews' end as platform,
               l_linenumber as line, l_suppkey, l_extendedprice, cast(l_quantity as bigint) as result_count, l_shipdate as collected_at
        from {lineitem}""",
    "vectors": """
        select vec_id, embedding, label, cast(floor(vec_id / 50) as bigint) as session_id from {embeddings}""",
    # vectors as expansion candidates of three sources; candidate texts repeat
    "candidates": """
        select vec_id as ord, cast(floor(vec_id / 50) as bigint) as session_id, embedding,
               concat(case when vec_id % 2 = 0 then 'Q' else 'q' end, cast(vec_id % 450 as string)) as query,
               case label % 3 when 0 then 'llm' when 1 then 'autocomplete' else 'trends' end as source,
               case vec_id % 4 when 0 then 'rising' when 1 then 'top' else null end as trend_signal
        from {embeddings}""",
    "signals": """
        select vec_id as cluster_id, cast(floor(vec_id / 50) as bigint) as session_id, embedding,
               vec_id % 9 = 0 as is_anomaly, 1 + vec_id % 13 as evidence_count,
               concat('e', cast(label as string)) as entity,
               case when vec_id % 3 = 0 then concat('p', cast(vec_id % 20 as string)) else '' end as pain_point,
               case when vec_id % 5 = 0 then concat('f', cast(vec_id % 15 as string)) else '' end as feature_request,
               case vec_id % 4 when 0 then 'positive' when 1 then 'negative' when 2 then 'neutral' else 'mixed' end as sentiment,
               case vec_id % 5 when 0 then 'question' when 1 then 'venting' when 2 then 'comparison' when 3 then 'announcement' else 'discussion' end as intent,
               concat('summary ', cast(vec_id as string)) as summary,
               case vec_id % 4 when 0 then 'reddit' when 1 then 'youtube' when 2 then 'hackerNews' else 'instagram' end as source_a,
               case vec_id % 3 when 0 then 'reddit' when 1 then 'youtube' else 'hackerNews' end as source_b,
               concat('quote ', cast(vec_id as string)) as quote,
               (vec_id % 100) / cast(100 as double) as avg_relevance, (vec_id % 37) / cast(10 as double) as avg_engagement
        from {embeddings}""",
    "urls": """
        select page_id, url, split_part(split_part(url, '/', 4), '?', 1) as tag, html from {pages}""",
}


class Tables:
    """Lazy access to the given tables and adapters of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in ADAPTERS:
            sql = ADAPTERS[name]
            needs = {field for _, field, _, _ in Formatter().parse(sql) if field}
            return self.spark.sql(sql, **{n: getattr(self, n) for n in needs})
        raise AttributeError(name)


def plain_sql(name: str) -> str:
    """An adapter as a subquery over the bare table names."""
    sql = ADAPTERS[name]
    needs = {field for _, field, _, _ in Formatter().parse(sql) if field}
    return "(" + sql.format(**{n: n if n in TABLES else plain_sql(n) for n in needs}) + ")"


def expand(sql: str, fragments: dict[str, str]) -> str:
    """Replace ``@name`` by the adapter or SQL fragment of that name."""
    def put(match: re.Match) -> str:
        name = match.group(1)
        if name in fragments:
            return "(" + expand(fragments[name], fragments) + ")"
        return plain_sql(name) if name in ADAPTERS else match.group(0)
    return re.sub(r"@([a-z_]+)", put, sql)
