"""Queries: set operations and table maintenance."""

import uuid

from pyspark.sql import functions as F

from pulseloom.functions import text as tx
from pulseloom.operators import sets as st
from pulseloom.plans.registry import FRAGMENTS, query
from pulseloom.session import ensure_checkpoint_dir, stored
from pulseloom.sources import sinks as sk


@query("set_01_ordered_union", "select query, 0 as part_ord, ord from @candidates where source = 'llm' union all select query, 1, ord from @candidates where source = 'trends' union all select query, 2, ord from @candidates where source = 'autocomplete'")
def ordered_union(t):
    c = t.candidates.select("query", "ord", "source")
    return st.ordered_union(c.filter("source = 'llm'"), c.filter("source = 'trends'"), c.filter("source = 'autocomplete'")).select("query", "part_ord", "ord")


@query("set_02_first_ignoring_case", "select session_id, min(ord) as ord from @candidates group by session_id, lower(query)")
def first_ignoring_case(t):
    return st.distinct_ignoring_case(t.candidates, "query", ["ord"], ["session_id"]).select("session_id", "ord")


@query("set_03_first_trimmed", "select session_id, min(ord) as ord from @candidates group by session_id, lower(query)")
def first_trimmed(t):
    padded = t.candidates.withColumn("query", F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" "), "query")).otherwise(F.col("query")))
    return st.distinct_ignoring_case(padded, "query", ["ord"], ["session_id"], trimmed=True).select("session_id", "ord")


@query("set_04_insert_or_ignore", """
    select sha256(lower(trim(query))) as topic_id, min(id) as first_session from @sessions group by all""")
def insert_or_ignore(t):
    s = t.sessions.select(tx.topic_id(F.col("query")).alias("topic_id"), F.col("id").alias("first_session"))
    early, late = s.filter("first_session < 5000"), s.filter("first_session >= 5000")
    base = early.groupBy("topic_id").agg(F.min("first_session").alias("first_session"))
    return st.insert_or_ignore(base, late, ["topic_id"], ["first_session"])


@query("set_05_insert_or_update", """
    select c_custkey as session_id, case when c_custkey % 3 = 1 then 'new' else c_mktsegment end as topic,
           case when c_custkey % 3 = 0 then 'new' else c_name end as result, c_custkey % 3 as state from customer""")
def insert_or_update(t):
    c = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("topic"), F.col("c_name").alias("result"),
                          (F.col("c_custkey") % 3).alias("state"))
    base = c.filter("state <> 1")
    fresh = c.filter("state = 0").withColumn("topic", F.lit("new")).withColumn("result", F.lit("new")).unionByName(
        c.filter("state = 1").withColumn("topic", F.lit("new")))
    return st.insert_or_update(base, fresh, ["session_id"], ["result"])


CUSTOMERS = "select c_custkey as id, c_mktsegment as topic, c_name as result, c_custkey % 16 as place from customer"
FRAGMENTS["customers"] = CUSTOMERS


def bucketed(t, rows):
    """A table of sixteen partitions by key, and a way to tell which rows lie in files that were there before."""
    table = sk.BucketedTable(t.spark, f"{ensure_checkpoint_dir(t.spark)}/bucketed-{uuid.uuid4().hex}", ["id"], 16, F.pmod("id", F.lit(16)))
    table.create(rows)
    listed = lambda: t.spark.read.parquet(table.path).select("*", F.input_file_name().alias("file"))
    before = stored(listed().select("file").distinct())
    now = lambda: listed().join(before.withColumn("kept", F.lit(True)), "file", "left").select(
        *rows.columns, F.coalesce("kept", F.lit(False)).alias("same_file"))
    return table, now


def customers(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("topic"), F.col("c_name").alias("result"), (F.col("c_custkey") % 16).alias("place"))


# changes and new rows in two partitions of sixteen: the files of the others stay
@query("set_05_touched_partitions", """
    select id, case when id % 160 = 3 then 'new' else topic end as topic, case when place = 3 and id % 160 <> 3 and id % 5 = 0 then 'new' else result end as result,
           place, place not in (3, 5) as same_file from @customers""")
def touched_partitions(t):
    c = customers(t)
    fresh = c.filter("id % 160 = 3").withColumn("topic", F.lit("new"))  # not there yet
    known = c.filter("place = 3 and id % 160 <> 3 and id % 5 = 0").withColumn("topic", F.lit("ignored")).withColumn("result", F.lit("new"))
    same = c.filter("place = 5 and id % 7 = 0")
    table, now = bucketed(t, c.filter("id % 160 <> 3"))
    table.insert_or_update(fresh.unionByName(known).unionByName(same), ["result"])
    return now()


@query("set_07_touched_partitions", """
    select id, case when place = 9 and id % 3 = 0 then 'done' else topic end as topic, result, place, place <> 9 as same_file from @customers""")
def patched_partitions(t):
    table, now = bucketed(t, customers(t))
    table.patch(customers(t).filter("place = 9 and id % 3 = 0").select("id", F.lit("done").alias("topic"), F.lit(None).cast("string").alias("result")))
    return now()


# of one partition a part goes, another goes altogether
@query("set_08_touched_partitions", """
    select *, place <> 2 as same_file from @customers where not (place = 2 and id % 3 = 0) and place <> 4""")
def deleted_partitions(t):
    table, now = bucketed(t, customers(t))
    table.delete(customers(t).filter("(place = 2 and id % 3 = 0) or place = 4").select("id"))
    return now()


@query("set_06_distinct_urls", "select distinct regexp_replace(url, '[?#].*$', '') as url from pages")
def distinct_urls(t):
    return t.pages.select(F.regexp_replace("url", r"[?#].*$", "").alias("url")).distinct()


@query("set_07_patch", """
    select id, case when status = 'F' then 'done' else status end as status, case when status = 'F' and id % 2 = 0 then 'patched' else query end as query, price from @sessions""")
def patch(t):
    base = t.sessions.select("id", "status", "query", "price")
    changes = base.filter("status = 'F'").select("id", F.lit("done").alias("status"), F.when(F.col("id") % 2 == 0, "patched").alias("query"))
    return st.patch(base, changes, ["id"])


@query("set_08_cascade", """
    select 'sessions' as tab, count(*) as n from @sessions where status <> 'P'
    union all select 'runs', count(*) from @runs r where session_id not in (select id from @sessions where status = 'P')
    union all select 'harvest', count(*) from @harvest h where session_id not in (select id from @sessions where status = 'P')""")
def cascade(t):
    left = st.delete_cascading({"sessions": (t.sessions, "id"), "runs": (t.runs, "session_id"), "harvest": (t.harvest, "session_id")},
                               t.sessions.filter("status = 'P'"), "id")
    out = None
    for name, df in left.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
        out = part if out is None else out.unionByName(part)
    return out
