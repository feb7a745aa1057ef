"""Queries: joins."""

from pyspark.sql import functions as F

from pulseloom.functions import text as tx
from pulseloom.operators import joins as jn
from pulseloom.plans.registry import query


@query("jon_01_topics_by_platform_id", """
    select distinct s.id as session_id, s.query as text from @sessions s join @harvest h on h.session_id = s.id where h.l_suppkey = 7""")
def topics_by_platform_id(t):
    topics = t.sessions.select("id", F.col("query").alias("text"))
    link = t.harvest.select(F.col("session_id").alias("topic_id"), F.lit("host").alias("platform"), F.col("l_suppkey").cast("string").alias("platform_id")).distinct()
    links = link.withColumn("hashed_id", tx.platform_hash(F.col("platform"), F.col("platform_id")))
    wanted = link.filter("platform_id = '7'").select("platform", "platform_id")
    return jn.topics_by_platform_id(topics, links, wanted).select(F.col("id").alias("session_id"), "text")


@query("jon_02_evidence_posts", """
    with o as (select l_orderkey as owner, l_linenumber as line, unnest([l_partkey, l_suppkey, -1 - l_partkey]) as doc_id, unnest([0, 1, 2]) as place from lineitem)
    select owner, line, place, doc_id, lang from o join documents using (doc_id)""")
def evidence_posts(t):
    owners = t.lineitem.select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("line"),
                               F.array("l_partkey", "l_suppkey", -1 - F.col("l_partkey")).alias("ids"))
    found = jn.evidence_posts(owners, t.documents.select("doc_id", "lang"), owner=["owner", "line"], ids="ids", post_id="doc_id")
    return found.select("owner", "line", "place", "doc_id", "lang")


@query("jon_03_transcripts", """
    select doc_id, case when doc_id % 3 = 0 and doc_id % 2 = 0 then concat('about ', lang) else 'caption' end as caption,
           case when doc_id % 3 = 0 then n_chars else 5 end as like_count,
           case when doc_id % 3 = 0 then source else 'user' end as username,
           cast(case when doc_id % 3 = 0 then case when doc_id % 4 = 0 then 9 else 100 end else 9 end as bigint) as taken_at,
           case when doc_id % 3 = 0 then text else '' end as transcript from documents""")
def transcripts(t):
    d = t.documents
    posts = d.select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit("caption").alias("caption"),
                     F.lit(5).cast("bigint").alias("like_count"), F.lit(None).cast("bigint").alias("comment_count"), F.lit("user").alias("username"),
                     F.lit("").alias("full_name"), F.lit(9).cast("bigint").alias("taken_at"))
    meta = F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("about "), "lang")).otherwise("").alias("description"), F.col("n_chars").alias("like_count"),
                    F.lit(None).cast("bigint").alias("comment_count"), F.col("source").alias("channel"), F.lit("").alias("uploader"),
                    F.when(F.col("doc_id") % 4 == 0, 0).otherwise(100).cast("bigint").alias("timestamp"))
    texts = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("transcript"), meta.alias("meta"))
    return jn.with_transcripts(posts, texts).select("doc_id", "caption", "like_count", "username", "taken_at", "transcript")


@query("jon_04_details", """
    select doc_id, case when doc_id % 3 = 0 then concat('full ', lang) else 't' end as title, case when doc_id % 6 = 0 then source else 'd' end as description from documents""")
def details(t):
    d = t.documents
    videos = d.select("doc_id", F.lit("t").alias("title"), F.lit("d").alias("description"))
    more = d.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("full "), "lang").alias("title"),
                                             F.when(F.col("doc_id") % 6 == 0, F.col("source")).otherwise("").alias("shortDescription"))
    return jn.with_details(videos, more, "doc_id")


@query("jon_07_new_only", "select native_id as id from @posts where doc_id % 3 <> 0")
def new_only(t):
    posts = t.posts.select(F.col("native_id").alias("id"), "doc_id")
    return jn.new_only(posts, posts.filter("doc_id % 3 = 0")).select("id")


@query("jon_08_existing", "select o_orderkey as id from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def existing(t):
    from pulseloom.operators.filters import known_ids
    store = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return known_ids(t.orders.select(F.col("o_orderkey").alias("id")), store)


@query("jon_09_topics_by_source", """
    select t.session_id, t.topic, s.source, s.query from (select id as session_id, concat('topic ', floor(id / 4)::bigint::varchar) as topic from @sessions) t
    join (select concat('topic ', floor(ord / 5)::bigint::varchar) as topic, source, query from @candidates) s using (topic)""")
def topics_by_source(t):
    # a few sessions ask for a topic, and a few suggestions belong to it: the output grows with the input
    number = lambda column, of: F.concat(F.lit("topic "), F.floor(F.col(column) / of).cast("string")).alias("topic")
    topics = t.sessions.select(F.col("id").alias("session_id"), number("id", 4), F.lit(0).alias("topic_ord"))
    suggestions = t.candidates.select(number("ord", 5), "source", "query")
    return jn.expand_topics(topics, suggestions).select("session_id", "topic", "source", "query")
