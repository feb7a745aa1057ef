"""The queries of this package, each over the whole of its tables, and the SQL that checks those which SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseloom.llm import (centroids, decontaminate, fingerprints, mixing, neardup, packing, pii, quality, secret_scan, simple8b, url_filter,
                           warc, whitening)
from pulseloom.llm.spans import written
from pulseloom.llm.common import documents, run_folder


def _vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "warc")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read_archive(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, ["doc_id"]).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary=_vocabulary())


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_trigram_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85).drop("text_key")


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_digests(documents(spark, sf_dir), _vocabulary())


def op11_bisector_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.bisector_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    own = {name: build for name, build in globals().items() if name.startswith("op") and name[2].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


SQL: dict[str, str] = {
    "op11_bisector_tournament": """
    with kept as (
        select vec_id, embedding from embeddings
        where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
    vals as (select vec_id, unnest(range(64)) as i, unnest(list_transform(embedding, lambda v: floor(64 * v::double)::bigint)) as x from kept),
    firsts as (select vec_id, (row_number() over (order by sha256('1:' || vec_id::varchar)) - 1)::integer as cluster from kept
               order by sha256('1:' || vec_id::varchar) limit 16),
    c0 as (select f.cluster, v.i, v.x from vals v join firsts f using (vec_id)),
    d0 as (select v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) as distance from vals v join c0 c on v.i = c.i group by all),
    a0 as (select vec_id, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d0 group by vec_id),
    s0 as (select a.cluster, v.i, sum(v.x)::bigint as s, count(*) as n from vals v join a0 a using (vec_id) group by all),
    c1 as (select c.cluster, c.i, coalesce(s.s // s.n - case when s.s % s.n < 0 then 1 else 0 end, c.x) as x
               from c0 c left join s0 s on s.cluster = c.cluster and s.i = c.i),
    d1 as (select v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) as distance from vals v join c1 c on v.i = c.i group by all),
    a1 as (select vec_id, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d1 group by vec_id),
    s1 as (select a.cluster, v.i, sum(v.x)::bigint as s, count(*) as n from vals v join a1 a using (vec_id) group by all),
    c2 as (select c.cluster, c.i, coalesce(s.s // s.n - case when s.s % s.n < 0 then 1 else 0 end, c.x) as x
               from c1 c left join s1 s on s.cluster = c.cluster and s.i = c.i),
    d2 as (select v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) as distance from vals v join c2 c on v.i = c.i group by all),
    a2 as (select vec_id, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d2 group by vec_id),
    s2 as (select a.cluster, v.i, sum(v.x)::bigint as s, count(*) as n from vals v join a2 a using (vec_id) group by all),
    c3 as (select c.cluster, c.i, coalesce(s.s // s.n - case when s.s % s.n < 0 then 1 else 0 end, c.x) as x
               from c2 c left join s2 s on s.cluster = c.cluster and s.i = c.i),
    d3 as (select v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) as distance from vals v join c3 c on v.i = c.i group by all),
    a3 as (select vec_id, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d3 group by vec_id),
    digest as (select cluster, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c3 group by cluster)
    select a.vec_id, a.cluster, a.distance::bigint as distance, sum(a.distance) over (partition by a.cluster)::bigint as cluster_inertia,
           sum(a.distance) over ()::bigint as inertia, d.centroid_sha256
    from a3 a join digest d using (cluster)""",
    "op13_pareto_mix": """
    with sized as (
        select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
               '1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) as key from documents),
    sources as (
        select source, sum(size)::bigint as source_size,
               case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from sized group by source),
    -- sources fill up in the order of size over weight; the rest share what these leave
    filling as (
        select *, row_number() over (order by source_size / w, source) as place,
               sum(source_size) over () - coalesce(sum(3 * source_size) over (order by source_size / w, source rows between unbounded preceding and 1 preceding), 0) as free,
               sum(w) over (order by source_size / w, source rows between current row and unbounded following) as open from sources),
    level as (select min(place) as place, arg_min(free, place)::double as free, arg_min(open, place)::double as open from filling where 3 * source_size * open >= free * w),
    targets as (
        select source, source_size, case when f.place < l.place then (3 * source_size)::double else l.free * f.w::double / l.open end as target
        from filling f, level l),
    odds as (
        select s.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) as copies, floor(coalesce(t.target / nullif(t.source_size, 0), 0)) as whole,
               (('0x' || substr(md5(s.key), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
        from sized s join targets t on s.source is not distinct from t.source),
    ranked as (
        select *, sum(size) over (partition by source order by (u / (1 - u)) / nullif((copies - whole) / (1 - (copies - whole)), 0) nulls last, key
                                  rows between unbounded preceding and current row) as upto from odds)
    select doc_id, size::bigint as size, source_size, target, (whole * size + case
        when copies > whole and 2.0 * upto - size <= 2.0 * (target - whole * source_size) then size else 0 end)::bigint as taken
    from ranked""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
