"""Queries: vectors, similarity, grouping, diversification, clustering."""

from pyspark.sql import functions as F

from pulseloom.functions import text as tx, vectors as ve
from pulseloom.operators import clusters as cl, components as co, diversify as dv, embedding as em, grouping as gr, similarity as si
from pulseloom.plans.registry import FRAGMENTS, query

SMALL_BLOCK = 16
VEC = dict(keys=["session_id"], id_col="vec_id", vec_col="embedding")
COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


def queries_and_docs(t):
    v = t.vectors
    is_query = F.col("vec_id") % 50 < 5
    return v.filter(is_query).select("session_id", F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), v.filter(~is_query)


def query_scores(t):
    queries, docs = queries_and_docs(t)
    return si.best_query_similarity(docs, queries, key="session_id", id_col="vec_id", vec_col="embedding").withColumnRenamed("relevance_score", "score")


@query("sim_01_cosine", f"select a.vec_id, round({COS}, 6) as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine(t):
    a = t.embeddings.select("vec_id", ve.as_double(F.col("embedding")).alias("va"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), ve.as_double(F.col("embedding")).alias("vb"))
    return a.join(b, "vec_id").select("vec_id", F.round(ve.cosine(F.col("va"), F.col("vb")), 6).alias("sim"))


@query("sim_02_unit", "select vec_id, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as first, round(embedding[64]::double / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as last from embeddings")
def unit(t):
    u = t.embeddings.select("vec_id", ve.unit(ve.as_double(F.col("embedding"))).alias("u"))
    return u.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("sim_03_best_query", "select session_id, vec_id, round(score, 6) as score from @query_scores")
def best_query(t):
    return query_scores(t).withColumn("score", F.round("score", 6))


@query("jon_06_docs_by_queries", "select session_id, vec_id, round(score, 6) as score from @query_scores")
def docs_by_queries(t):
    queries, docs = queries_and_docs(t)
    # no broadcast: documents and queries meet by session
    met = si.best_query_similarity(docs, queries, key="session_id", id_col="vec_id", vec_col="embedding", broadcast_bytes=0)
    return met.select("session_id", "vec_id", F.round("relevance_score", 6).alias("score"))


def _search_sql(metric: str) -> str:
    d = {"cosine": f"1 - {COS}", "l2": "pow(list_distance(a.embedding::double[], b.embedding::double[]), 2)",
         "dot": "1 - list_inner_product(a.embedding::double[], b.embedding::double[])"}[metric]
    return f"""select query_id, id, rank, round(distance, 6) as distance, round(1 - distance, 6) as similarity from (
        select *, row_number() over (partition by query_id order by distance, id) as rank from (
            select b.vec_id as query_id, a.vec_id as id, {d} as distance from embeddings a join embeddings b on b.vec_id % 250 < 2)) where rank <= 5"""


def _search(metric):
    def run(t):
        q = t.embeddings.filter("vec_id % 250 < 2").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
        found = si.vector_search(t.embeddings, q, 5, metric, id_col="vec_id", vec_col="embedding")
        return found.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))
    return run


for _m in ("cosine", "l2", "dot"):
    query(f"sim_04_search_{_m}", _search_sql(_m))(_search(_m))

FRAGMENTS["near"] = f"select a.session_id, a.vec_id as id_a, b.vec_id as id_b, {COS} as sim from @vectors a join @vectors b on a.session_id = b.session_id and a.vec_id < b.vec_id"


# equal vectors are one class, named by its smallest id
FRAGMENTS["classes"] = "select session_id, min(vec_id) as vec_id, embedding from @vectors group by session_id, embedding"
FRAGMENTS["class_pairs"] = f"select a.session_id, a.vec_id as id_a, b.vec_id as id_b, {COS} as sim from @classes a join @classes b on a.session_id = b.session_id and a.vec_id < b.vec_id"


@query("sim_05_similar_pairs", "select session_id, id_a, id_b, round(sim, 6) as sim from @class_pairs where sim > 0.3")
def similar_pairs(t):
    return si.similar_classes(t.vectors, 0.3, **VEC)[0].withColumn("sim", F.round("sim", 6))


@query("sim_05_similar_pairs_blocks", "select session_id, id_a, id_b, round(sim, 6) as sim from @class_pairs where sim > 0.3")
def similar_pairs_blocks(t):
    # sessions of several blocks: the path of large groups
    return si.similar_classes(t.vectors, 0.3, block_rows=SMALL_BLOCK, **VEC)[0].withColumn("sim", F.round("sim", 6))


@query("sim_05_members", "select session_id, vec_id, min(vec_id) over (partition by session_id, embedding) as representative from @vectors")
def members(t):
    return si.vector_classes(t.vectors, **VEC)[1]


@query("sim_05_candidates", f"""
    select count(*) as pairs, 0::bigint as wrong, true as enough from embeddings a join embeddings b on a.vec_id < b.vec_id where {COS} > 0.4""")
def candidates(t):
    """All vectors as one group, by tables of signs: how many pairs there are, found ones that are none, and whether nine of ten are found."""
    every = t.embeddings.withColumn("all", F.lit(1))
    how = dict(keys=["all"], id_col="vec_id", vec_col="embedding")
    exact = si.similar_pairs(every, 0.4, **how).select("id_a", "id_b", F.lit(1).alias("exact"))
    found = si.candidate_pairs(every, 0.4, block_rows=SMALL_BLOCK, **how).select("id_a", "id_b", F.lit(1).alias("found"))
    both = exact.join(found, ["id_a", "id_b"], "full")
    return both.agg(F.count("exact").alias("pairs"), F.count_if(F.col("exact").isNull()).alias("wrong"),
                    (F.count_if(F.col("exact").isNotNull() & F.col("found").isNotNull()) >= 0.9 * F.count("exact")).alias("enough"))


@query("jon_05_theta_join", "select session_id, id_a, id_b, round(sim, 6) as sim from @class_pairs where sim >= 0.35")
def theta_join(t):
    return si.similar_classes(t.vectors, 0.35, inclusive=True, **VEC)[0].withColumn("sim", F.round("sim", 6))


@query("sim_06_stored_or_embedded", "select doc_id, doc_id % 3 = 0 as stored from documents")
def stored_or_embedded(t):
    d = t.documents.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text").alias("text"))
    store = d.filter("doc_id % 3 = 0").select(tx.topic_id(F.col("text")).alias("id"), F.array_repeat(F.lit(2.0), 16).alias("vector"))
    return em.stored_or_embedded(d, store, "text", dims=16).select("doc_id", (F.col("vec")[0] == 2.0).alias("stored"))


@query("sim_07_topics_to_index", """
    select min(ord) as ord, sha256(lower(query)) as id from @candidates where sha256(lower(query)) not in (select sha256(lower(query)) from @candidates where ord % 450 < 100) group by lower(query)""")
def topics_to_index(t):
    batch = t.candidates.select("ord", F.col("query").alias("text"))
    store = batch.filter("ord % 450 < 100").select(tx.topic_id(F.col("text")).alias("id")).distinct()
    return em.topics_to_index(batch, store).select("ord", "id")


@query("emb_01_embed", "select doc_id, cast(64 as bigint) as dims, case when regexp_matches(text, '[\\p{L}'']') then 1.0 else 0.0 end::double as length from documents")
def embed(t):
    e = em.embed(t.documents, "text", dims=64)
    return e.select("doc_id", F.size("vec").cast("bigint").alias("dims"), F.round(ve.norm(F.col("vec")), 6).alias("length"))


# ---- near duplicates -------------------------------------------------------------------------------------------------

def greedy_sql(threshold: float, priority: str) -> str:
    """Best-first grouping, one row of a session after the other."""
    return f"""
    with recursive nodes as (select session_id, vec_id, row_number() over (partition by session_id order by {priority} desc, vec_id) as rn from @vectors),
    links as (select session_id, id_a, id_b from @near where sim > {threshold} union all select session_id, id_b, id_a from @near where sim > {threshold}),
    near_lists as (select n.session_id, n.vec_id, n.rn, coalesce(list(m.rn) filter (where m.rn is not null), []) as nb
        from nodes n left join links l on l.session_id = n.session_id and l.id_a = n.vec_id
        left join nodes m on m.session_id = l.session_id and m.vec_id = l.id_b group by all),
    walk as (select session_id, 0::bigint as rn, []::bigint[] as kept from (select distinct session_id from nodes)
        union all select w.session_id, w.rn + 1, case when list_has_any(n.nb, w.kept) then w.kept else list_append(w.kept, n.rn) end
        from walk w join near_lists n on n.session_id = w.session_id and n.rn = w.rn + 1),
    done as (select session_id, kept from (select *, row_number() over (partition by session_id order by rn desc) as z from walk) where z = 1)
    select n.session_id, n.vec_id, m.vec_id as leader_id from near_lists n join done d on d.session_id = n.session_id
    join nodes m on m.session_id = n.session_id and m.rn = case when list_contains(d.kept, n.rn) then n.rn else list_min(list_intersect(n.nb, d.kept)) end"""


FRAGMENTS["greedy"] = greedy_sql(0.3, "vec_id % 37")


def groups(t, **layout):
    return gr.near_duplicates(t.vectors.withColumn("p", F.col("vec_id") % 37), 0.3, priority_col="p", ordinal_col="vec_id", **VEC, **layout)


@query("dup_01_near_duplicates", "select * from @greedy")
def near_duplicates(t):
    return groups(t)


@query("dup_01_near_duplicates_rounds", "select * from @greedy")
def near_duplicates_rounds(t):
    return groups(t, block_rows=SMALL_BLOCK)


@query("dup_02_children", "select session_id, leader_id, vec_id as child_id from @greedy where vec_id <> leader_id")
def children(t):
    return gr.children(groups(t), keys=["session_id"], id_col="vec_id")


@query("dup_02_representatives", "select session_id, leader_id as vec_id, count(*) - 1 as duplicate_count from @greedy group by session_id, leader_id")
def representatives(t):
    return gr.representatives(t.vectors, groups(t), keys=["session_id"], id_col="vec_id").select("session_id", "vec_id", "duplicate_count")


FRAGMENTS["sets"] = r"""select doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> ''))) as toks from documents"""
FRAGMENTS["set_reps"] = "select toks, min(doc_id) as id, len(toks) as n from @sets where len(toks) > 0 group by toks"


def token_sets(t):
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    return gr.similar_sets(t.documents.select("doc_id", words.alias("toks")), 0.7, id_col="doc_id", tokens_col="toks")


@query("dup_03_similar_sets", """
    with t as (select id, n, unnest(toks) as w from @set_reps),
    shared as (select a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as k from t a join t b on a.w = b.w and a.id < b.id
               and least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) group by all)
    select id_a, id_b, round(k / (na + nb - k)::double, 6) as jaccard from shared where k / (na + nb - k)::double >= 0.7""")
def similar_sets(t):
    return token_sets(t)[0].select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


@query("dup_03_equal_sets", "select doc_id, min(doc_id) over (partition by toks) as representative from @sets where len(toks) > 0")
def equal_sets(t):
    return token_sets(t)[1]


@query("dup_04_diversify", f"""
    with recursive ext as (select session_id, min(vec_id % 97) as lo, max(vec_id % 97) as hi from @vectors group by session_id),
    v as (select session_id, vec_id, embedding, ((vec_id % 97) - lo)::double / (hi - lo) as rel from @vectors join ext using (session_id)),
    sims as (select session_id, id_a as p, id_b as c, sim from @near union all select session_id, id_b, id_a, sim from @near),
    walk as (select session_id, vec_id, rel, null::double as near, 0 as step, null::bigint as won from v
        union all
        select w.session_id, w.vec_id, w.rel, greatest(w.near, s.sim), w.step + 1, w.best
        from (select *, arg_max(vec_id, (0.7 * rel - 0.3 * coalesce(near, 0), -vec_id)) over (partition by session_id) as best from walk) w
        join sims s on s.session_id = w.session_id and s.p = w.best and s.c = w.vec_id where w.step < 40)
    select session_id, won as vec_id, cast(step as integer) as pick from walk where step > 0 group by session_id, won, step""")
def diversify(t):
    return dv.diversify(t.vectors.withColumn("rel", F.col("vec_id") % 97), 40, 0.7, relevance_col="rel", ordinal_col="vec_id", **VEC)


# the plain rules, step by step: Kruskal over all pairs of a session in the order of (weight, ends), clusters of three and more,
# the choice of the greater mass, and what ends below the least distance passes to the cluster around it
FRAGMENTS["density_density"] = "case when q = 0 then 1000000000000000000000::hugeint else floor(1e9 / sqrt(q / 1e9) + 0.5)::hugeint end"
DENSITY_SQL = """
    with recursive unit as (
        select floor(vec_id / 50)::bigint as session_id, vec_id, row_number() over (partition by floor(vec_id / 50) order by vec_id) as i,
               list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from embeddings),
    pairs as (
        select a.session_id, a.i, b.i as j, greatest(0, floor((2.0 - 2.0 * list_dot_product(a.u, b.u)) * 1e9 + 0.5))::bigint as q
        from unit a join unit b on a.session_id = b.session_id and a.i < b.i),
    cores as (
        select session_id, i, list_sort(list(q))[2] as core
        from (select session_id, i, q from pairs union all select session_id, j, q from pairs) group by session_id, i),
    edges as (
        select *, row_number() over (partition by session_id order by q, i, j) as e from (
            select p.session_id, p.i, p.j, greatest(p.q, x.core, y.core) as q from pairs p
            join cores x on x.session_id = p.session_id and x.i = p.i join cores y on y.session_id = p.session_id and y.i = p.j)),
    steps as (
        select session_id, 0::bigint as e, list(i order by i) as part, 0::bigint as q, null::bigint as x, null::bigint as y from unit group by session_id
        union all
        select s.session_id, d.e, list_transform(s.part, lambda p: case when p = s.part[d.j] then s.part[d.i] else p end), d.q, s.part[d.i], s.part[d.j]
        from steps s join edges d on d.session_id = s.session_id and d.e = s.e + 1),
    merges as (select session_id, e, q, x, y, part, len(list_filter(part, lambda p: p = x)) as size from steps where x <> y),
    nodes as (
        select n.*, l.e as l, r.e as r, coalesce(l.size, 1) >= 3 as bl, coalesce(r.size, 1) >= 3 as br, l.size as ls, r.size as rs
        from merges n
        left join merges l on l.session_id = n.session_id and l.e = (select max(m.e) from merges m where m.session_id = n.session_id and m.e < n.e and m.x = n.x)
        left join merges r on r.session_id = n.session_id and r.e = (select max(m.e) from merges m where m.session_id = n.session_id and m.e < n.e and m.x = n.y)),
    homes as (
        select session_id, e, e as c from nodes where size >= 3 and bl = br
        union all
        select n.session_id, n.e, h.c from homes h join nodes n on n.session_id = h.session_id and n.bl <> n.br and h.e = case when n.bl then n.l else n.r end),
    joined as (
        select session_id, c, sum(@density_density * (size - case when bl <> br then case when bl then ls else rs end else 0 end)) as joined
        from nodes join homes using (session_id, e) group by session_id, c),
    ends as (
        select n.session_id, h.c, n.e as parent, n.q, case when h.e = n.l then n.ls else n.rs end as size
        from nodes n join homes h on h.session_id = n.session_id and h.e in (n.l, n.r) where n.bl and n.br),
    own as (
        select *, joined - @density_density * size as own, row_number() over (partition by session_id order by c) as k from ends join joined using (session_id, c)),
    masses as (
        select session_id, 0::bigint as k, []::hugeint[] as inside, []::hugeint[] as mass from own group by session_id
        union all
        select session_id, k, list_append(inside, within), list_append(mass, greatest(own, within)) from (
            select m.session_id, o.k, m.inside, m.mass, o.own,
                   coalesce((select sum(m.mass[i.k]) from own i where i.session_id = o.session_id and i.parent = o.c), 0)::hugeint as within
            from masses m join own o on o.session_id = m.session_id and o.k = m.k + 1)),
    judged as (
        select o.session_id, o.c, o.parent, o.q, o.own >= m.inside[o.k] as chosen
        from own o join masses m on m.session_id = o.session_id and m.k = (select max(x.k) from own x where x.session_id = o.session_id)),
    around as (
        select session_id, c, c as a from judged
        union all
        select r.session_id, r.c, j.parent from around r join judged j on j.session_id = r.session_id and j.c = r.a
        where exists (select 1 from judged p where p.session_id = j.session_id and p.c = j.parent)),
    standing as (
        select distinct s.session_id, min(r.a) as top from judged s join around r on r.session_id = s.session_id and r.c = s.c
        join judged t on t.session_id = s.session_id and t.c = r.a
        where s.chosen and not exists (select 1 from around o join judged u on u.session_id = o.session_id and u.c = o.a
                                       where o.session_id = s.session_id and o.c = s.c and o.a <> s.c and u.chosen)
          and (not sqrt(t.q / 1e9) < 0.06 or not exists (select 1 from judged p where p.session_id = t.session_id and p.c = t.parent))
        group by s.session_id, s.c),
    points as (
        select u.session_id, u.vec_id, min(n.e) as e from unit u join nodes n on n.session_id = u.session_id and n.size >= 3 and n.part[u.i] = n.x group by all),
    placed as (
        select p.session_id, p.vec_id, s.top from points p join homes h on h.session_id = p.session_id and h.e = p.e
        join around r on r.session_id = p.session_id and r.c = h.c join standing s on s.session_id = p.session_id and s.top = r.a),
    numbered as (select session_id, top, row_number() over (partition by session_id order by min(vec_id)) - 1 as cluster_id from placed group by session_id, top),
    few as (select session_id from unit group by session_id having count(*) < 3)
    select u.session_id, u.vec_id, case when u.session_id in (from few) then 0 else coalesce(n.cluster_id, -1) end::integer as cluster_id
    from unit u left join placed p on p.session_id = u.session_id and p.vec_id = u.vec_id left join numbered n on n.session_id = p.session_id and n.top = p.top"""


@query("clu_01_density_clusters", DENSITY_SQL)
def density_clusters(t):
    return cl.density_clusters(t.vectors, **VEC)


@query("clu_01_density_clusters_blocks", DENSITY_SQL)
def density_clusters_blocks(t):
    # no session in one task: contraction, chains and running totals over the edges
    return cl.density_clusters(t.vectors, block_rows=SMALL_BLOCK, **VEC)


@query("clu_02_small_sessions", "select floor(vec_id / 2)::bigint as session_id, vec_id, 0 as cluster_id from embeddings")
def small_sessions(t):
    pairs = t.embeddings.withColumn("session_id", F.floor(F.col("vec_id") / 2))
    return cl.density_clusters(pairs, **VEC)


FRAGMENTS["apart"] = """
    select floor(vec_id / 50)::bigint as session_id, vec_id, case when vec_id % 50 >= 45 then -1 else (vec_id % 50) % 5 end as part from embeddings"""


def built_clusters(t, **layout):
    """Five tight directions and five lone ones per session: the clusters are known beforehand."""
    k = F.col("vec_id") % 50
    direction = F.when(k >= 45, k - 40).otherwise(k % 5)  # 0 to 4 are shared, 5 to 9 belong to one vector each
    # a little of a direction of its own keeps the members apart without moving their cluster
    vec = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.when(i == direction, 1.0).when((i == k + 10) & (k < 45), 0.02 + 0.001 * k).otherwise(0.0))
    rows = t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 50).alias("session_id"), vec.alias("embedding"))
    return cl.density_clusters(rows, **VEC, **layout)


CLUSTER_SQL = "select session_id, vec_id, part::integer as cluster_id from @apart"


@query("clu_01_built_clusters", CLUSTER_SQL)
def clusters_in_one_task(t):
    return built_clusters(t)


@query("clu_01_built_clusters_blocks", CLUSTER_SQL)
def clusters_in_blocks(t):
    return built_clusters(t, block_rows=SMALL_BLOCK)


@query("clu_03_noise", "select session_id, count(*) filter (where part = -1) as noise, count(*) filter (where part <> -1) as clustered from @apart group by session_id")
def noise(t):
    return built_clusters(t).groupBy("session_id").agg(F.count_if(F.col("cluster_id") == -1).alias("noise"), F.count_if(F.col("cluster_id") != -1).alias("clustered"))


COMPONENTS = """
    with recursive links as (select n.session_id, id_a as a, id_b as b from @near n where sim >= 0.35 and (id_a % 9 = 0) = (id_b % 9 = 0)),
    both_ways as (select * from links union select session_id, b, a from links),
    reach as (select session_id, vec_id as a, vec_id as b from @vectors union select r.session_id, r.a, l.b from reach r join both_ways l on l.session_id = r.session_id and l.a = r.b)
    select session_id, a as cluster_id, min(b) as component from reach group by session_id, a"""
FRAGMENTS["components"] = COMPONENTS


@query("sig_04_components", "select * from @components")
def components(t):
    return co.merge_groups(t.signals, 0.35, keys=["session_id"], id_col="cluster_id", vec_col="embedding", flag_col="is_anomaly").drop("is_anomaly")


@query("sig_04_components_blocks", "select * from @components")
def components_blocks(t):
    return co.merge_groups(t.signals, 0.35, keys=["session_id"], id_col="cluster_id", vec_col="embedding", flag_col="is_anomaly", block_rows=SMALL_BLOCK).drop("is_anomaly")


@query("agg_09_row_maximum", "select session_id, vec_id, round(max(sim), 6) as highest from (select session_id, id_a as vec_id, sim from @near union all select session_id, id_b, sim from @near) group by session_id, vec_id")
def row_maximum(t):
    return si.best_partner(t.vectors, **VEC).select("session_id", "vec_id", F.round("best", 6).alias("highest"))
