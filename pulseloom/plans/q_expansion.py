"""Queries: query expansion."""

from pyspark.sql import functions as F

from pulseloom.operators import expansion as ex
from pulseloom.plans.q_vectors import COS, greedy_sql
from pulseloom.plans.registry import FRAGMENTS, query


@query("exp_01_kind", "select ord, case source when 'llm' then 'structure' else 'demand' end as kind from @candidates")
def kind(t):
    return t.candidates.select("ord", ex.kind_of(F.col("source")).alias("kind"))


def related(t):
    c = t.candidates.filter("trend_signal is not null")
    return c.select(F.concat(F.lit("q"), (F.col("ord") % 7).cast("string")).alias("topic"), F.col("trend_signal").alias("list"), F.col("ord").alias("pos"),
                    F.when(F.col("ord") % 13 != 0, F.col("query")).alias("query"))


@query("exp_02_trends", """
    select concat('q', cast(ord % 7 as string)) as topic, query, trend_signal, case trend_signal when 'rising' then 0 else 1 end as list_ord, ord as pos
    from @candidates where trend_signal is not null and ord % 13 <> 0 and lower(query) <> concat('q', cast(ord % 7 as string))""")
def trends(t):
    return ex.trends_suggestions(related(t)).drop("source")


SUGGEST = "select concat('q', cast(ord % 150 as string)) as q, ord as pos, concat('q', cast((ord * 7 + 3) % 190 as string)) as s from @candidates"


@query("exp_03_breadth", f"""
    with sug as ({SUGGEST}),
    l1 as (select sd.session_id, s.s from (select distinct session_id, concat('q', cast(session_id % 9 + 1 as string)) as q from @vectors) sd join sug s on s.q = sd.q where s.s <> sd.q),
    d1 as (select distinct session_id, s, 1 as level from l1),
    d2 as (select distinct d.session_id, g.s, 2 as level from d1 d join sug g on g.q = d.s where g.s <> d.s and (d.session_id, g.s) not in (select session_id, s from d1)),
    d3 as (select distinct d.session_id, g.s, 3 as level from d2 d join sug g on g.q = d.s where g.s <> d.s and (d.session_id, g.s) not in (select session_id, s from d1 union all select session_id, s from d2))
    select session_id, s as query, level from d1 union all select * from d2 union all select * from d3""")
def breadth(t):
    table = t.candidates.select(F.concat(F.lit("q"), (F.col("ord") % 150).cast("string")).alias("query"), F.col("ord").alias("pos"), F.concat(F.lit("Q"), ((F.col("ord") * 7 + 3) % 190).cast("string")).alias("suggestion"))
    seeds = t.vectors.select("session_id", F.concat(F.lit("q"), (F.col("session_id") % 9 + 1).cast("string")).alias("query")).distinct()
    return ex.expand_breadth(seeds, table, 3).select("session_id", F.lower("query").alias("query"), "level")


@query("exp_04_subtopics", """
    select doc_id, concat('Original question: "', source, '"', chr(10), 'Topic to expand: "', lang, '"', chr(10), 'Intent: topic; Category: General', chr(10), 'Related topics: ', source, ', other') as prompt,
           concat(source, '|sub') as subtopics from documents""")
def subtopics(t):
    d = t.documents.select("doc_id", F.col("lang").alias("topic"), F.col("source").alias("original_query"), F.lit("topic").alias("intent"),
                           F.lit("General").alias("category"), F.array(F.upper("lang"), "source", F.lit("other")).alias("topics"))
    asked = ex.subtopic_prompts(d).select("doc_id", "prompt")
    replies = t.documents.select(F.concat_ws("/", F.col("doc_id").cast("string"), "lang").alias("topic"), F.concat(
        F.lit('{"subtopics": ["'), "source", F.lit('", "'), F.col("doc_id").cast("string"), F.lit("/"), F.upper("lang"), F.lit('", "sub"]}')).alias("reply"))
    found = ex.subtopic_candidates(replies).withColumn("doc_id", F.split("topic", "/")[0].cast("bigint"))
    listed = found.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "query"))), lambda x: x["query"]), "|").alias("subtopics"))
    return asked.join(listed, "doc_id")


@query("exp_05_merge_candidates", "select session_id, min(ord) as ord, count(*) as n from @candidates group by session_id, lower(query)")
def merge_candidates(t):
    kept = ex.merge_candidates(t.candidates, ["ord"])
    counts = t.candidates.groupBy("session_id", F.lower("query").alias("k")).agg(F.count("*").alias("n"))
    return kept.withColumn("k", F.lower("query")).join(counts, ["session_id", "k"]).select("session_id", "ord", "n")


def scored(t):
    c = t.candidates.withColumn("kind", ex.kind_of(F.col("source"))).withColumnRenamed("embedding", "vec")
    seeds = c.filter("ord % 50 = 0").select("session_id", F.col("vec").alias("seed_vec"))
    return ex.score_candidates(c, seeds, peer_threshold=0.3)


FRAGMENTS["candidate_scores"] = f"""
    with c as (select *, case source when 'llm' then 'structure' else 'demand' end as kind from @candidates),
    seed as (select session_id, embedding from c where ord % 50 = 0),
    g as (select a.session_id, a.ord, greatest(0, least(1, {COS})) as gsim from c a join seed b on b.session_id = a.session_id),
    p as (select a.session_id, a.ord, avg({COS}) filter (where {COS} > 0.3) as raw, true as peers from c a join c b on b.session_id = a.session_id and a.source <> b.source group by a.session_id, a.ord),
    x as (select session_id, max(raw) as top from p group by session_id),
    f as (select c.*, g.gsim, coalesce(p.raw, 0) / greatest(coalesce(x.top, 0), 2.220446049250313e-16) as rel, coalesce(p.peers, false) as peers,
                 row_number() over (partition by c.session_id, lower(trim(c.query)) order by c.ord) as rn
          from c join g using (session_id, ord) left join p using (session_id, ord) left join x using (session_id)),
    b as (select *, greatest(0, least(1, case when peers then gsim * 0.8 + rel * 0.2 else gsim end)) as base,
                 case trend_signal when 'rising' then 1.06 when 'top' then 1.03 else 1.0 end::double * case kind when 'demand' then 1.02 else 1.0 end::double as boost from f where rn = 1)
    select session_id, ord, gsim, rel, case when base * boost > 1 then base + (1 - base) * (boost - 1) else base * boost end as blended from b"""


@query("exp_06_global_score", "select ord, round(gsim, 4) as global_score from @candidate_scores")
def global_score(t):
    return scored(t).select("ord", "global_score")


@query("exp_07_relative_score", "select ord, round(rel, 4) as relative_score from @candidate_scores")
def relative_score(t):
    return scored(t).select("ord", "relative_score")


@query("agg_10_peer_support", f"""
    select a.session_id, a.ord, count(*) filter (where {COS} > 0.3) as peer_matches, round(avg({COS}) filter (where {COS} > 0.3), 6) as mean_similarity
    from @candidates a join @candidates b on b.session_id = a.session_id and a.source <> b.source group by a.session_id, a.ord having count(*) filter (where {COS} > 0.3) > 0""")
def peer_support(t):
    from pulseloom.operators.similarity import peer_support as support
    s = support(t.candidates, 0.3, keys=["session_id"], id_col="ord", vec_col="embedding", source_col="source")
    return s.select("session_id", "ord", "peer_matches", F.round(F.col("peer_sum") / F.col("peer_matches"), 6).alias("mean_similarity"))


@query("exp_08_semantic_score", "select ord, round(greatest(0, least(1, blended)), 4) as semantic_score from @candidate_scores")
def semantic_score(t):
    return scored(t).select("ord", "semantic_score")


FRAGMENTS["kept_candidates"] = "select session_id, ord as vec_id, round(greatest(0, least(1, blended)), 4) as sem from @candidate_scores"


def _thin_sql() -> str:
    base = greedy_sql(0.3, "sem").replace("from @vectors", "from @kept_candidates")
    return f"select session_id, vec_id as ord from ({base.replace('from @near where', 'from @near_kept where')}) where vec_id = leader_id"


FRAGMENTS["near_kept"] = "select n.* from @near n join @kept_candidates a on a.session_id = n.session_id and a.vec_id = n.id_a join @kept_candidates b on b.session_id = n.session_id and b.vec_id = n.id_b"


@query("exp_09_thin", _thin_sql())
def thin(t):
    return ex.thin_candidates(scored(t), 0.3).select("session_id", "ord")


@query("exp_10_questions", "select id as session_id, unnest([concat(query, ' trends'), concat(query, ' alternatives'), concat('how to use ', query)]) as question from @sessions")
def questions(t):
    return t.sessions.select(F.col("id").alias("session_id"), F.explode(ex.fallback_questions(F.col("query"))).alias("question"))


@query("exp_11_topic_fallback", r"select doc_id, case when doc_id % 2 = 0 then lang else trim(regexp_replace(lower(text), '\s+', ' ', 'g')) end as topics from documents")
def topic_fallback(t):
    found = F.when(F.col("doc_id") % 2 == 0, F.array("lang"))
    return t.documents.select("doc_id", F.array_join(ex.topics_or_query(found, F.col("text")), "|").alias("topics"))
