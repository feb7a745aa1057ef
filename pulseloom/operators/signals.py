"""Signals: prompts and replies per cluster, merging, scoring, compression, synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom import settings
from pulseloom.functions import documents as js, text as tx
from pulseloom.functions.scores import share_of_max, with_extent
from pulseloom.operators.aggregates import cluster_quotes, cluster_summary, majority
from pulseloom.operators.filters import score_or_anomaly
from pulseloom.operators.ranking import top_n, top_per_cluster
from pulseloom.session import cut

PROMPT = "Describe the shared subject of these posts.\nTopic: {seed}\n{n} posts from {sources}\n\n{posts}\nAnswer with one JSON object."
ODD_PROMPT = "Describe what sets these outlying posts apart.\nTopic: {seed}\n{n} posts from {sources}\n\n{posts}\nAnswer with one JSON object."
SIGNAL_FIELDS = ["entity", "pain_point", "feature_request", "sentiment", "intent", "summary"]


def distinct_members(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sorted distinct elements of an array column per group; repeats vanish before the shuffle."""
    return (df.select(*keys, F.explode(column).alias(column)).filter(F.coalesce(column, F.lit("")) != "")
            .groupBy(*keys).agg(F.sort_array(F.collect_set(column)).alias(column)))


def first_quotes(df: DataFrame, n: int = settings.TOP_QUOTES, *, keys: list[str], ordinal: str, quotes: str) -> DataFrame:
    """The first ``n`` quotes of a group's lists, in order of rows and list places."""
    listed = df.select(*keys, ordinal, F.posexplode(quotes).alias("_place", "_quote"))
    best = top_n(listed, n, keys, [ordinal, "_place"], "_rank")
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_quote"))),
                                               lambda q: q["_quote"]).alias("quotes"))


def _fill(template: str, **parts: Column) -> Column:
    out, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        out.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        out.append(parts[name])
    return F.concat(*out)


def cluster_prompts(posts: DataFrame, seeds: DataFrame, *, n: int = settings.DOCS_PER_CLUSTER, ordinal: str = "ord",
                    prompt: str = PROMPT, odd_prompt: str = ODD_PROMPT) -> DataFrame:
    """One prompt row per cluster from its ``n`` most relevant posts; cluster -1 uses the prompt for outliers."""
    keys = ["session_id", "cluster_id"]
    best = top_per_cluster(posts, n, keys=keys, ordinal=ordinal)
    c = F.col
    lines = best.select(*keys, "rank", tx.post_line(c("rank"), c("source"), c("subreddit"), c("channel"), c("score"),
                                                    c("num_comments"), c("text")).alias("line"))
    joined = lines.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("_posts"))
    facts = cluster_summary(posts, keys=keys).select(*keys, "evidence_count", "sources")
    rows = facts.join(joined, keys).join(seeds.select("session_id", "seed"), "session_id", "left")
    parts = dict(seed=F.coalesce("seed", F.lit("")), n=c("evidence_count").cast("string"), sources=F.array_join("sources", ", "), posts=c("_posts"))
    text = F.when(c("cluster_id") == -1, _fill(odd_prompt, **parts)).otherwise(_fill(prompt, **parts))
    return rows.select(*keys, (c("cluster_id") == -1).alias("is_anomaly"), text.alias("prompt"))


def extract_signals(posts: DataFrame, replies: DataFrame, *, ordinal: str = "ord") -> DataFrame:
    """One signal per cluster out of its reply (session_id, cluster_id, reply).

    An unreadable reply leaves the figures but no quotes; a missing or unusable one leaves only the evidence.
    """
    keys = ["session_id", "cluster_id"]
    facts = cluster_summary(posts, keys=keys).join(cluster_quotes(posts, keys=keys, ordinal=ordinal), keys, "left")
    rows = facts.join(replies.select(*keys, "reply"), keys, "left").withColumn("_doc", js.reply_document(F.col("reply")))
    doc = F.col("_doc")
    read = doc.isNotNull() & js.kind_of(doc).startswith("OBJECT")
    broken = ~F.coalesce(read, F.lit(False)) & F.col("reply").isNotNull() & doc.isNull()
    read = F.coalesce(read, F.lit(False))
    items = F.concat(F.lit("Cluster of "), F.col("evidence_count").cast("string"), F.lit(" items "))
    failed = F.concat(items, F.when(broken, settings.UNREADABLE_REPLY).otherwise(settings.FAILED_REPLY))
    defaults = {"sentiment": "neutral", "intent": "discussion"}
    field = lambda name: F.when(read, js.text_field(doc, f"$.{name}", defaults.get(name, "")))
    return rows.select(
        *keys, (F.col("cluster_id") == -1).alias("is_anomaly"),
        *[field(n).otherwise(failed if n == "summary" else F.lit("")).alias(n) for n in SIGNAL_FIELDS],
        "evidence_count", "sources",
        F.when(read, F.col("quotes")).otherwise(F.array().cast("array<string>")).alias("representative_quotes"),
        F.when(read | broken, F.col("avg_relevance")).otherwise(0.0).alias("avg_relevance"),
        F.when(read | broken, F.col("avg_engagement")).otherwise(0.0).alias("avg_engagement"))


def merge_aggregate(signals: DataFrame, *, keys: list[str], ordinal: str) -> DataFrame:
    """One row per merge group. A session has at most ``MMR_TOP_K / CLUSTER_MIN_SIZE`` signals, so the sets stay small."""
    some = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    primary = F.max_by(F.struct(*SIGNAL_FIELDS), F.struct("evidence_count", (-F.col(ordinal)).alias("_first")))
    merged = signals.groupBy(*keys).agg(
        some("entity").alias("entities"), some("pain_point").alias("pain_points"), some("feature_request").alias("feature_requests"),
        some("intent").alias("intents"), F.sum("evidence_count").alias("evidence_count"), F.avg("avg_relevance").alias("avg_relevance"),
        F.avg("avg_engagement").alias("avg_engagement"), F.bool_or("is_anomaly").alias("is_anomaly"), primary.alias("_primary"),
        F.count("*").alias("signals_merged"))
    p = lambda n: F.col(f"_primary.{n}")
    text = tx.signal_text(p("entity"), p("pain_point"), p("feature_request"), p("summary"))
    return (merged.join(majority(signals, keys, "sentiment", ordinal), keys, "left")
            .join(distinct_members(signals, keys, "sources"), keys, "left")
            .join(first_quotes(signals, keys=keys, ordinal=ordinal, quotes="representative_quotes"), keys, "left")
            .withColumn("sentiment", F.coalesce("sentiment", F.lit("neutral")))
            .withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
            .withColumn("representative_quotes", F.coalesce("quotes", F.array().cast("array<string>")))
            .withColumn("signal_id", tx.signal_id(text)).withColumn("summary", p("summary")).drop("_primary", "quotes"))


def merge_signals(signals: DataFrame, groups: DataFrame) -> DataFrame:
    """Signals folded by their merge group (session_id, cluster_id, component); a session's only signal keeps its sentiment."""
    tagged = cut(signals.join(groups.select("session_id", "cluster_id", "component"), ["session_id", "cluster_id"]))
    merged = merge_aggregate(tagged, keys=["session_id", "component"], ordinal="cluster_id")
    alone = tagged.groupBy("session_id").agg(F.count("*").alias("_n"), F.first("sentiment").alias("_own"))
    return merged.join(alone, "session_id").withColumn(
        "sentiment", F.when(F.col("_n") == 1, F.col("_own")).otherwise(F.col("sentiment"))).drop("_n", "_own")


def score_signals(signals: DataFrame, total_sources: int = settings.TOTAL_SOURCES, keys: list[str] = ["session_id"]) -> DataFrame:
    """Components and weighted final score of every signal, relative to the largest of its session."""
    df = with_extent(signals, keys, ev="evidence_count", en="avg_engagement")
    w, c = settings.SCORE_WEIGHTS, F.col
    parts = {
        "relevance": F.least(c("avg_relevance"), F.lit(1.0)),
        "evidence": F.when(c("ev_max") > 0, F.log1p(c("evidence_count")) / F.log1p(c("ev_max"))).otherwise(0.0),
        "velocity": F.lit(settings.FLAT_VELOCITY),
        "source_spread": F.size("sources") / F.lit(total_sources) if total_sources > 0 else F.lit(0.0),
        "engagement": share_of_max(c("avg_engagement"), c("en_max")),
        "novelty": 1.0 - c("evidence_count") / (c("ev_max") + 1),
    }
    weights = {**w, "evidence": w["evidence_count"]}
    final = sum((F.lit(weights[n]) * x for n, x in parts.items()), F.lit(0.0))
    return df.select(*signals.columns, *[F.round(x, 4).alias(f"{n}_component") for n, x in parts.items()],
                     F.round(final, 4).alias("final_score"))


ENTRY = ["signal_id", "is_anomaly", "summary", "entities", "sentiment", "evidence_count", "sources"]


def signal_entries(scored: DataFrame) -> DataFrame:
    """Signals as pain-point, feature-request and question rows."""
    base = scored.select("session_id", *ENTRY, F.col("final_score").alias("score"), "pain_points", "feature_requests", "intents")
    drop = ("pain_points", "feature_requests", "intents")
    pains = base.withColumn("value", F.explode("pain_points")).withColumn("kind", F.lit("pain_point"))
    requests = base.withColumn("value", F.explode("feature_requests")).withColumn("kind", F.lit("feature_request"))
    asked = F.arrays_overlap("intents", F.array(*[F.lit(i) for i in settings.QUESTION_INTENTS]))
    questions = base.filter(asked).withColumn("value", F.lit("")).withColumn("kind", F.lit("question"))
    return pains.filter("value <> ''").unionByName(requests.filter("value <> ''")).unionByName(questions).drop(*drop)


def evidence(members: DataFrame, groups: DataFrame, signals: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """``session_id, signal_id, post_id, kind``: the posts behind each merged signal, a row each, however many they are.

    ``members``: session_id, id, cluster_id of the clustered posts (kind ``member``). ``groups``: session_id, cluster_id, component.
    ``signals``: session_id, component, signal_id. ``duplicates``: session_id, leader_id, child_id, posts folded into a member
    (kind ``duplicate``).
    """
    keys = ["session_id"]
    named = groups.join(signals.select(*keys, "component", "signal_id"), [*keys, "component"]).select(*keys, "cluster_id", "signal_id")
    own = members.select(*keys, "cluster_id", F.col("id").alias("post_id")).join(named, [*keys, "cluster_id"]).select(*keys, "signal_id", "post_id")
    out = own.withColumn("kind", F.lit("member"))
    if duplicates is not None:
        folded = duplicates.select(*keys, F.col("leader_id").alias("post_id"), "child_id").join(own, [*keys, "post_id"]).select(
            *keys, "signal_id", F.col("child_id").alias("post_id"), F.lit("duplicate").alias("kind"))
        out = out.unionByName(folded)
    return out


def global_stats(scored: DataFrame, sources: str = "sources", totals: DataFrame | None = None) -> DataFrame:
    """Evidence, signals, sources and best score of each session.

    ``totals``: session_id, total_evidence, where the evidence is more than what the signals count (all posts of a run).
    """
    figures = scored.groupBy("session_id").agg(F.sum("evidence_count").alias("total_evidence"), F.count("*").alias("total_signals"),
                                               F.max("final_score").alias("top_signal_score"))
    if totals is not None:
        figures = figures.drop("total_evidence").join(totals.select("session_id", "total_evidence"), "session_id", "left")
    return figures.join(distinct_members(scored, ["session_id"], sources), "session_id", "left")


def compress(scored: DataFrame, seeds: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One analysis row per session: its best pain points, requests, questions and quotes, and its figures (see ``global_stats``)."""
    scored = cut(scored)
    entries = signal_entries(scored)
    out = global_stats(scored, totals=totals).join(seeds.select("session_id", F.col("seed").alias("topic")), "session_id", "left")
    entry = F.struct(*ENTRY, "score", "value")
    empty = lambda name, like: F.coalesce(F.col(name), F.from_json(F.lit("[]"), like))
    for name, kind, n in (("top_pain_points", "pain_point", settings.TOP_PAIN_POINTS),
                          ("top_feature_requests", "feature_request", settings.TOP_FEATURE_REQUESTS),
                          ("top_questions", "question", settings.TOP_QUESTIONS)):
        best = top_n(entries.filter(F.col("kind") == kind), n, ["session_id"], [F.desc("score"), F.col("signal_id"), F.col("value")])
        listed = best.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))),
                                                            lambda x: x["e"]).alias(name))
        out = out.join(listed, "session_id", "left").withColumn(name, empty(name, listed.schema[name].dataType))
    top = top_n(scored, settings.TOP_QUOTES, ["session_id"], [F.desc("final_score"), F.col("signal_id")])
    quote = F.struct("rank", F.col("representative_quotes")[0].alias("text"), "sources", "entities")
    quotes = top.filter(F.size("representative_quotes") > 0).groupBy("session_id").agg(F.transform(
        F.array_sort(F.collect_list(quote)), lambda q: F.struct(q["text"].alias("text"), q["sources"].alias("sources"), q["entities"].alias("entities"))).alias("representative_quotes"))
    return out.join(quotes, "session_id", "left").withColumn(
        "representative_quotes", empty("representative_quotes", quotes.schema["representative_quotes"].dataType))


def synthesis_payloads(analysis: DataFrame, scored: DataFrame, min_score: float = 0.0, exempt: bool = True,
                       limit: int = settings.SYNTHESIS_CHARS) -> DataFrame:
    """The analysis and its best signals as JSON text per session: always whole, with ``signals_left_out``.

    ``limit`` is the budget of characters for all signals together, in order of their scores: a signal that would overstep it
    is left out, and so are all after it. No text is cut inside a signal.
    """
    keep = lambda name: F.filter(name, lambda e: score_or_anomaly(e["score"], e["is_anomaly"], min_score, exempt)).alias(name)
    kept = scored.filter(score_or_anomaly(F.col("final_score"), F.col("is_anomaly"), min_score, exempt))
    columns = [c for c in scored.columns if c not in ("session_id", "component", "embedding", "vec")]
    order = Window.partitionBy("session_id").orderBy(F.desc("final_score"), "signal_id")
    sized = kept.withColumn("_size", F.length(F.to_json(F.struct(*columns))) + 1).withColumn("_upto", F.sum("_size").over(order)).withColumn(
        "_rank", F.row_number().over(order))
    best = sized.filter(F.col("_upto") <= limit)
    listed = best.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.struct(*columns).alias("s")))),
                                                        lambda x: x["s"]).alias("signals"))
    left_out = sized.groupBy("session_id").agg(F.count_if(F.col("_upto") > limit).alias("signals_left_out"))
    rows = analysis.join(listed, "session_id", "left").join(left_out, "session_id", "left").select("session_id", F.struct(
        "topic", keep("top_pain_points"), keep("top_feature_requests"), keep("top_questions"), "representative_quotes", "signals",
        F.coalesce("signals_left_out", F.lit(0)).alias("signals_left_out"),
        F.struct("total_evidence", "total_signals", "sources", "top_signal_score").alias("stats")).alias("doc"))
    return rows.select("session_id", F.to_json("doc").alias("payload"))


# What a trend catcher may say, and its defaults.
TREND_TYPES = ["mainstream", "counter_trend"]
CONFIDENCES = ["high", "medium", "low"]
CATCHER_DEFAULTS = {"trend": "", "platform": "", "status": "rising", "trend_type": "mainstream", "confidence": "medium",
                    "suggested_content": "", "format": "", "angle": "", "act_by": "", "representative_id": ""}
METRIC_KINDS = {"impressions": "bigint", "views": "bigint", "engagement_rate": "double", "likes": "bigint", "comments": "bigint",
                "shares": "bigint"}


def trend_catchers(replies: DataFrame) -> DataFrame:
    """Trend catchers of each session's synthesis reply (session_id, reply), in order; a bad reply gives none."""
    doc = F.try_parse_json(F.trim(F.col("reply")))
    items = replies.select("session_id", F.coalesce(js.field(doc, "$.trend_catchers", "array<variant>"), F.array().cast("array<variant>")).alias("_items"))
    valid = F.forall("_items", lambda v: js.text_field(v, "$.trend_type", "mainstream").isin(TREND_TYPES)
                     & js.text_field(v, "$.confidence", "medium").isin(CONFIDENCES))
    rows = items.filter(valid).select("session_id", F.posexplode("_items").alias("place", "_c"))
    c = F.col("_c")
    metrics = F.struct(*[F.coalesce(js.field(c, f"$.metrics.{n}", k), F.lit(0).cast(k)).alias(n) for n, k in METRIC_KINDS.items()],
                       js.text_field(c, "$.metrics.velocity").alias("velocity"))
    return rows.select("session_id", "place", *[js.text_field(c, f"$.{n}", d).alias(n) for n, d in CATCHER_DEFAULTS.items()],
                       metrics.alias("metrics"), js.string_list(c, "$.reference_links").alias("reference_links"),
                       js.string_list(c, "$.evidence_ids").alias("evidence_ids"))


def run_usage(**stages: DataFrame) -> DataFrame:
    """Token rows of all stages of a run; each frame has session_id, model, prompt_tokens, output_tokens."""
    out = None
    for stage, df in stages.items():
        part = df.select("session_id", F.lit(stage).alias("stage"), "model", "prompt_tokens", "output_tokens",
                         (F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("total_tokens"))
        out = part if out is None else out.unionByName(part)
    return out


def embedding_usage(texts: DataFrame, text: str, model: str = "embedding") -> DataFrame:
    """Estimated tokens of embedded texts per session."""
    return texts.groupBy("session_id").agg(F.sum(tx.token_estimate(F.col(text))).alias("prompt_tokens")).select(
        "session_id", F.lit(model).alias("model"), "prompt_tokens", F.lit(0).cast("bigint").alias("output_tokens"))
