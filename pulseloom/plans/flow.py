"""The whole analysis of many sessions at once, as stage tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseloom import settings
from pulseloom.functions import text as tx
from pulseloom.operators import clusters as cl, components as co, diversify as dv, grouping as gr, normalize as nz, ranking as rk, signals as sg
from pulseloom.operators.embedding import embed
from pulseloom.operators.similarity import best_query_similarity
from pulseloom.session import cut
from pulseloom.sources.sinks import StageTables, posts_by_id, write_documents


@dataclass
class Run:
    """Inputs and parameters of a run.

    ``platforms``: landed posts per platform. ``queries``: session_id, query. ``seeds``: session_id, seed.
    ``replies``: prompts -> (session_id, cluster_id, reply, prompt_tokens, output_tokens), see
    ``operators.hooks.provide_replies``. ``synthesis``: the same for the closing prompts of sessions; without it a run ends
    with their payloads.
    """

    platforms: dict[str, DataFrame]
    queries: DataFrame
    seeds: DataFrame
    replies: Callable[[DataFrame], DataFrame]
    as_of: Column
    embedder: object = None
    dims: int = 256
    relevance_threshold: float = settings.RELEVANCE_THRESHOLD
    relevance_floor: int = settings.RELEVANCE_FLOOR
    duplicate_threshold: float = settings.DUPLICATE_THRESHOLD
    mmr_k: int = settings.MMR_TOP_K
    mmr_lambda: float = settings.MMR_LAMBDA
    merge_threshold: float = settings.MERGE_THRESHOLD
    scorer: object = None
    synthesis: Callable[[DataFrame], DataFrame] | None = None
    min_score: float = 0.0
    embed_chars: int | None = None  # for an embedder that takes no longer texts

    def stages(self) -> dict[str, Callable[[StageTables], DataFrame]]:
        return {"normalized": self.normalized, "embedded": self.embedded, "relevant": self.relevant, "grouped": self.grouped, "selected": self.selected,
                "clustered": self.clustered, "replies": self.answered, "signals": self.signals, "components": self.components, "merged": self.merged,
                "scored": self.scored, "evidence": self.evidence, "analysis": self.analysis, "payloads": self.payloads,
                **({"synthesis": self.synthesised, "catchers": self.catchers} if self.synthesis else {}), "usage": self.usage,
                "posts": self.posts, "documents": self.documents}

    def _embed(self, df: DataFrame, text: str) -> DataFrame:
        return embed(df, text, "vec", self.embedder, self.dims)

    def normalized(self, s: StageTables) -> DataFrame:
        return nz.normalize(self.platforms, self.as_of).withColumn("ord", arrival(F.col("query_ord"), F.col("platform_ord"), F.col("pos")))

    def embedded(self, s: StageTables) -> DataFrame:
        texts = s.read("normalized").withColumn("_input", tx.embedding_input(F.col("title"), F.col("text"), self.embed_chars))
        return self._embed(texts, "_input").drop("_input")

    def relevant(self, s: StageTables) -> DataFrame:
        vectors = s.read("embedded")
        asked = cut(self._embed(self.queries, "query"))  # read several times
        scores = best_query_similarity(vectors, asked, key="session_id", id_col="id", vec_col="vec")
        # who is kept is settled on ids and scores; texts and vectors travel once, for those alone
        scored = cut(vectors.select("session_id", "id", "ord").join(scores, ["session_id", "id"]))
        names = rk.threshold_or_floor(scored, self.relevance_threshold, self.relevance_floor, keys=["session_id"],
                                      score="relevance_score", ordinal="ord")
        kept = vectors.join(names.drop("ord"), ["session_id", "id"])
        return rk.rerank(kept, self.scorer, keys=["session_id"], query="query", text="text", ordinal="ord")

    def grouped(self, s: StageTables) -> DataFrame:
        return gr.near_duplicates(s.read("relevant"), self.duplicate_threshold, keys=["session_id"], id_col="id", vec_col="vec",
                                  priority_col="engagement", ordinal_col="ord")

    def selected(self, s: StageTables) -> DataFrame:
        kept = gr.representatives(s.read("relevant"), s.read("grouped"), keys=["session_id"], id_col="id")
        best = kept.withColumn("_rel", F.greatest("rerank_score", "relevance_score"))
        picks = dv.diversify(best, self.mmr_k, self.mmr_lambda, keys=["session_id"], id_col="id", vec_col="vec",
                             relevance_col="_rel", ordinal_col="ord")
        return kept.join(picks, ["session_id", "id"])

    def clustered(self, s: StageTables) -> DataFrame:
        posts = s.read("selected")
        labels = cl.density_clusters(posts, keys=["session_id"], id_col="id", vec_col="vec")
        return posts.join(labels, ["session_id", "id"])

    def answered(self, s: StageTables) -> DataFrame:
        """Replies are a stage of their own: asking is what costs, so it happens once."""
        return self.replies(sg.cluster_prompts(s.read("clustered"), self.seeds, ordinal="pick"))

    def signals(self, s: StageTables) -> DataFrame:
        return sg.extract_signals(s.read("clustered"), s.read("replies"), ordinal="pick")

    def components(self, s: StageTables) -> DataFrame:
        texts = s.read("signals").withColumn("_text", tx.signal_text(*[F.col(c) for c in ("entity", "pain_point", "feature_request", "summary")]))
        return co.merge_groups(self._embed(texts, "_text"), self.merge_threshold, keys=["session_id"], id_col="cluster_id",
                               vec_col="vec", flag_col="is_anomaly")

    def merged(self, s: StageTables) -> DataFrame:
        return sg.merge_signals(s.read("signals"), s.read("components"))

    def scored(self, s: StageTables) -> DataFrame:
        return sg.score_signals(s.read("merged"))

    def evidence(self, s: StageTables) -> DataFrame:
        """The posts behind each signal, and the copies folded into them."""
        return sg.evidence(s.read("clustered"), s.read("components"), s.read("merged"),
                           gr.children(s.read("grouped"), keys=["session_id"], id_col="id"))

    def analysis(self, s: StageTables) -> DataFrame:
        found = s.read("normalized").groupBy("session_id").agg(F.count("*").alias("total_evidence"))
        return sg.compress(s.read("scored"), self.seeds, found)

    def payloads(self, s: StageTables) -> DataFrame:
        return sg.synthesis_payloads(s.read("analysis"), s.read("scored"), self.min_score)

    def synthesised(self, s: StageTables) -> DataFrame:
        asked = s.read("payloads").select("session_id", F.lit(0).cast("bigint").alias("cluster_id"), F.col("payload").alias("prompt"))
        return self.synthesis(asked)

    def catchers(self, s: StageTables) -> DataFrame:
        return sg.trend_catchers(s.read("synthesis"))

    def posts(self, s: StageTables) -> DataFrame:
        """The posts that evidence refers to, by id: a side table of the documents, whole at any size."""
        named = s.read("evidence").select("session_id", F.col("post_id").alias("id")).distinct()
        return posts_by_id(s.read("relevant").drop("vec").join(named, ["session_id", "id"], "left_semi"))

    def documents(self, s: StageTables) -> DataFrame:
        """One closing document per session: topic, analysis, trend catchers, token usage."""
        listed = lambda name, order: s.read(name).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(
            order, *[c for c in s.read(name).columns if c not in ("session_id", order)]))).alias(name))
        analysis = s.read("analysis")
        out = analysis.select("session_id", "topic", F.struct(*[c for c in analysis.columns if c not in ("session_id", "topic")]).alias("analysis"))
        # a session has a few rows of either: one per stage, and what one closing reply names
        for name, order in ([("catchers", "place")] if self.synthesis else []) + [("usage", "stage")]:
            out = out.join(listed(name, order), "session_id", "left")
        return out

    def usage(self, s: StageTables) -> DataFrame:
        """Token rows of all stages."""
        texts = s.read("normalized").select("session_id", tx.embedding_input(F.col("title"), F.col("text"), self.embed_chars).alias("_t")).unionByName(
            self.queries.select("session_id", F.col("query").alias("_t")))
        answered = {settings.EXTRACTION_STAGE: s.read("replies")} | ({settings.SYNTHESIS_STAGE: s.read("synthesis")} if self.synthesis else {})
        return sg.run_usage(**{settings.EMBEDDING_STAGE: sg.embedding_usage(texts, "_t")}, **{n: r.filter("reply is not null").withColumn("model", F.lit("reply")) for n, r in answered.items()})


def arrival(query_ord: Column, platform_ord: Column, pos: Column) -> Column:
    """Order in which a session's posts were found, as one number."""
    return (query_ord.cast("bigint") * 10 + platform_ord) * 1_000_000_000_000 + pos


def analyse(spark: SparkSession, run: Run, folder: str, start: str | None = None, end: str | None = None) -> StageTables:
    """Run the stages into ``folder``, which all executors share, resuming after the last finished one."""
    tables = StageTables(spark, folder)
    built = tables.run(run.stages(), start, end, stop_when_empty=("normalized", "relevant"))
    if "documents" in built:
        write_documents(tables.read("documents"), f"{folder}/documents_json")
    return tables
