import json
import tempfile

import pytest
from pyspark.sql import functions as F

from pulseloom import schemas
from pulseloom.functions import moments as mo
from pulseloom.operators import normalize as nz, ranking as rk, signals as sg
from pulseloom.operators.hooks import parse_pages, provide_replies
from pulseloom.plans import flow, registry
from pulseloom.plans.adapters import Tables
from pulseloom.plans.q_flow import run_of
from pulseloom.plans.q_text import as_of
from pulseloom.sources import collection as cn, reddit as rd, sinks as sk, trends as tr, youtube as yt

FOLDER = "/root/testdata/sf0.001"
LONG = "this is the text of a post that is long enough to be kept by the filter for words"


def test_collection_file_to_posts(spark):
    doc = {"seed": "s", "results": [
        {"query": "q1", "reddit": [{"postId": "a", "title": "T", "body": LONG, "author": "u", "score": 9}, {"postId": "b", "title": "T", "body": "", "author": "u"},
                                   {"postId": "c", "title": "T", "body": LONG, "author": "AutoModerator"}],
         "youtube": [{"id": "v", "title": LONG, "description": "", "viewsText": "2,000 views"}, {"id": "w", "title": LONG, "viewsText": "1,999 views"}]},
        {"query": "q2", "reddit": [{"postId": "a", "title": "T", "body": LONG, "author": "u", "score": 1}],
         "hackerNews": [{"id": "h", "title": "T", "text": LONG, "points": 3}, {"id": "n", "title": "", "text": LONG}],
         "instagram": [{"pk": "i", "caption": "", "transcript": LONG, "full_name": "F", "taken_at": 0}]}]}
    folder = tempfile.mkdtemp()
    with open(f"{folder}/one.json", "w") as f:
        json.dump(doc, f, indent=1)
    posts = nz.normalize(cn.flatten(cn.read_collections(spark, folder)), as_of()).collect()
    got = {r.id: r for r in posts}
    assert set(got) == {"reddit_a", "youtube_v", "hackernews_h", "instagram_i"}
    assert got["reddit_a"].query == "q1" and got["reddit_a"].score == 9 and got["reddit_a"].session_id == "one"
    assert got["hackernews_h"].url == "https://news.ycombinator.com/item?id=h"
    assert got["instagram_i"].author == "F" and got["instagram_i"].engagement == 0.0


def test_search_page(spark):
    html = """<div class="search-result-group"><span class="search-header-label">posts</span>
      <div class="search-result-link" data-fullname="t3_x1"><a class="search-title" href="/r/a/1">A &amp; <b>B</b></a><br>
      <span class="search-score">1,234 points</span><a class="search-comments">5 comments</a><span class="search-author"><a class="id-t2_9z" href="/user/me">me</a></span>
      <a class="search-subreddit-link" href="/r/a">r/a</a><time datetime="2024-01-01T00:00:00+00:00">1 month ago</time></div>
      <div class="search-result-link"></div></div>"""
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "p int, html string")
    rows = sorted(rd.search_posts(pages, ["p"]).collect(), key=lambda r: r["rank"])
    assert [(r.p, r["rank"], r.postId, r.title, r.score, r.comments, r.author, r.authorId, r.subreddit, r.permalink, r.hasThumbnail) for r in rows] == [
        (1, 1, "x1", "A & B", 1234, 5, "me", "9z".join(["t2_", ""]), "a", "https://old.reddit.com/r/a/1", False), (1, 2, "", "", 0, 0, "", None, "", "", False)]
    assert {(r.p, r.after, r.has_next) for r in rd.next_pages(pages, ["p"]).collect()} == {(1, None, False), (2, None, False), (3, None, False)}


def test_video_tree(spark):
    tree = {"a": [{"videoRenderer": {"videoId": "1", "title": {"runs": [{"text": "x"}, {"text": "y"}]}}}, {"videoRenderer": {"title": {}}}],
            "z": {"continuationItemRenderer": {"continuationEndpoint": {"continuationCommand": {"token": "t"}}}}}
    pages = spark.createDataFrame([(1, json.dumps(tree)), (2, "{bad"), (3, None)], "p int, data string")
    found = yt.find_renderers(pages, ["p"])
    v = yt.videos(found, ["p"]).collect()
    assert [(r.id, r.title, r.badges, r.verified, r.channelUrl) for r in v] == [("1", "xy", [], False, "")]
    assert [tuple(r) for r in yt.continuations(found, ["p"]).collect()] == [(1, "t")]


def test_trend_errors_stay_in_their_row(spark):
    rows = [(1, "autoComplete", ")]}' {\"default\":{\"topics\":[{\"title\":\"a\"}]}}"), (2, "autoComplete", "<p>x</p>"), (3, "autoComplete", "Rate limit"), (4, "x", "{}"), (5, "autoComplete", "{")]
    df = spark.createDataFrame(rows, "i int, method string, raw string")
    assert [r.error for r in tr.guard(df).orderBy("i").collect()] == [
        None, "unexpected HTML response", "rate limited (HTTP 429)", "unknown method", "failed to parse response"]
    assert [tuple(r) for r in tr.auto_complete(df, ["i"]).collect()] == [(1, 0, "", "a", "")]


@pytest.mark.parametrize("high, want", [(10, 50), (55, 55)])
def test_relevance_floor(spark, high, want):
    df = spark.range(60).select(F.lit(1).alias("s"), "id", F.when(F.col("id") < high, 0.9).otherwise(0.1).alias("score"))
    assert rk.threshold_or_floor(df, keys=["s"], score="score", ordinal="id").count() == want


def test_scores_by_hand(spark):
    rows = [("s", "a", 9, ["r", "y", "h", "i"], 1.5, 2.0), ("s", "b", 1, ["r"], 0.5, 1.0)]
    df = spark.createDataFrame(rows, "session_id string, signal_id string, evidence_count bigint, sources array<string>, avg_relevance double, avg_engagement double")
    a, b = sg.score_signals(df).orderBy("signal_id").collect()
    assert a.source_spread_component == 1.3333 and a.relevance_component == 1.0 and a.novelty_component == 0.1
    assert a.final_score == round(0.3 + 0.2 + 0.075 + 0.15 * 4 / 3 + 0.1 + 0.1 * (1 - 9 / 10), 4)
    assert b.evidence_component == 0.301 and b.engagement_component == 0.5
    none = sg.score_signals(df.withColumn("avg_engagement", F.lit(0.0))).collect()
    assert {r.engagement_component for r in none} == {0.0}


def test_stage_tables_resume_and_stop_when_empty(spark):
    tables = sk.StageTables(spark, tempfile.mkdtemp())
    calls = []

    def stage(name, n):
        def build(_):
            calls.append(name)
            return spark.range(n)
        return build

    stages = {"a": stage("a", 2), "b": stage("b", 0), "c": stage("c", 1)}
    assert tables.run(stages, end="a") == ["a"]
    assert tables.run(stages, stop_when_empty=("b",)) == ["b"] and calls == ["a", "b"]
    assert not tables.done("c")
    # an empty stage that nobody stops at doesn't keep later ones from being built
    assert tables.run(stages) == ["c"]
    # what was built from a stage is stale once that is built again
    assert tables.run(stages, start="a", end="a") == ["a"]
    assert not tables.done("b") and not tables.done("c")
    assert tables.run(stages) == ["b", "c"]


def test_partition_count_does_not_matter(spark):
    results = []
    for partitions in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = registry.callables()["nrm_05_top_posts"](spark, FOLDER).collect()
        results.append(sorted(map(tuple, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and results[0]


def test_whole_analysis(spark):
    t = Tables(spark, FOLDER)
    tables = flow.analyse(spark, run_of(t), tempfile.mkdtemp())
    analysis = tables.read("analysis").collect()
    assert len(analysis) == tables.read("normalized").select("session_id").distinct().count()
    picked = tables.read("selected")
    assert picked.groupBy("session_id").count().agg(F.max("count")).first()[0] <= 30
    assert picked.select("session_id", "id").distinct().count() == picked.count() == tables.read("clustered").count()
    assert tables.run(run_of(t).stages()) == []
    found = {r.session_id: r["count"] for r in tables.read("normalized").groupBy("session_id").count().collect()}
    assert {r.session_id: r.total_evidence for r in analysis} == found
    behind = tables.read("evidence")
    assert behind.filter("kind = 'member'").count() == tables.read("clustered").count()
    assert behind.join(tables.read("merged"), ["session_id", "signal_id"], "left_anti").count() == 0
    assert tables.read("posts").count() == behind.select("session_id", "post_id").distinct().count()
    assert {r.session_id for r in spark.read.json(f"{tables.folder}/documents_json").collect()} == set(found)
    catchers = tables.read("catchers").collect()
    assert {r.trend for r in catchers} == {f"topic {r.session_id}" for r in analysis}
    assert {r.stage for r in tables.read("usage").select("stage").distinct().collect()} == {"s1_relevance", "extract_signals", "synthesize"}


def test_schemas_parse(spark):
    for fields in [schemas.COLLECTION, *schemas.SESSION_STORE.values()]:
        assert spark.createDataFrame([], fields).columns


def test_one_failing_prompt_or_page_loses_nothing_else(spark):
    prompts = spark.createDataFrame([(1, i, "bad" if i == 3 else f"p{i}") for i in range(20)], "session_id bigint, cluster_id bigint, prompt string").coalesce(1)

    def provider(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [(t.upper(), 1, 1) for t in texts]
    got = {r.cluster_id: r.reply for r in provide_replies(prompts, provider).collect()}
    assert got == {i: None if i == 3 else f"P{i}" for i in range(20)}

    def parser(text):
        if text == "bad":
            raise ValueError("broken page")
        yield {"title": text}
    pages = prompts.select("cluster_id", F.col("prompt").alias("html"))
    rows = {r.cluster_id: (r.title, r.error) for r in parse_pages(pages, parser, "cluster_id bigint, title string, error string", ["cluster_id"]).collect()}
    assert len(rows) == 20 and rows[3] == (None, "ValueError: broken page") and rows[4] == ("p4", None)


def test_odd_times_are_the_clock(spark):
    rows = [("99999999999999 years ago",), ("99999999999999999999 days ago",), ("3000 years ago",), ("2 days ago",)]
    df = spark.createDataFrame(rows, "x string").select(mo.parse_moment(F.col("x"), as_of()).alias("at"), as_of().alias("clock"))
    assert [(r.clock - r.at).days for r in df.collect()] == [0, 0, 0, 2]
    odd = spark.createDataFrame([(10 ** 17,), (-10 ** 17,), (0,), (None,), (60,)], "s bigint")
    got = [r.at for r in odd.select(F.unix_seconds(mo.from_epoch_seconds(F.col("s"), as_of())).alias("at")).collect()]
    assert got[:4] == [got[0]] * 4 and got[4] == 60


def test_payloads_keep_whole_signals(spark):
    rows = [("s", f"sig{i}", 1.0 - i / 100, False, "x" * 300) for i in range(50)]
    scored = spark.createDataFrame(rows, "session_id string, signal_id string, final_score double, is_anomaly boolean, summary string")
    analysis = spark.createDataFrame([("s", "t")], "session_id string, topic string").select(
        "*", *[F.from_json(F.lit("[]"), "array<struct<score: double, is_anomaly: boolean>>").alias(n) for n in ("top_pain_points", "top_feature_requests", "top_questions")],
        F.array().alias("representative_quotes"), F.lit(50).alias("total_evidence"), F.lit(50).alias("total_signals"), F.array().alias("sources"), F.lit(1.0).alias("top_signal_score"))
    doc = json.loads(sg.synthesis_payloads(analysis, scored, limit=4000).first().payload)
    kept = [x["signal_id"] for x in doc["signals"]]
    assert kept == [f"sig{i}" for i in range(len(kept))] and 5 < len(kept) < 50 and doc["signals_left_out"] == 50 - len(kept)


def test_language_is_right_for_most_texts(spark):
    rows = registry.callables()["txt_13_accuracy"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.right_ones for r in rows) >= 0.9 * sum(r.n for r in rows), rows


def test_pages_are_parsed_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from pulseloom.functions.pages import row_batches
    # one batch of 400 pages of 400 kB as Python texts (four bytes a character); all at once are 160 MB
    batch = pa.record_batch({"p": pa.array(range(400)), "html": pa.array(["🚀" + "x" * 100_000] * 400)})
    schema = pa.schema([("p", pa.int64()), ("body", pa.string())])
    tracemalloc.start()
    got = [(b.num_rows, b["p"].to_pylist()) for b in row_batches([batch], schema, lambda key, text: [(*key, text)] if key[0] % 2 else [])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [p for _, ps in got for p in ps] == list(range(1, 400, 2)) and max(n for n, _ in got) < 20
    assert peak < 20e6, peak


def test_files_of_session_stages_follow_runs(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 400).alias("session_id"), F.col("id").alias("n"))
    tables = sk.SessionStages(spark, str(tmp_path))
    stages = {"kept": lambda s, todo: rows.join(todo, "session_id", "left_semi"),
              "counted": lambda s, todo: s.read("kept", todo).groupBy("session_id").agg(F.count("*").alias("n"))}
    files = lambda stage: {str(p) for p in (tmp_path / stage).rglob("*.parquet")}
    assert tables.run(stages, rows) == {"kept": 400, "counted": 400}
    before = files("counted")
    assert len(files("kept")) < 100 and len(before) < 100  # one or more for each session before
    tables.forget(spark.createDataFrame([(7,)], "session_id long"), ["kept"])
    assert tables.run(stages, rows) == {"kept": 1, "counted": 1}
    assert before < files("counted")
    assert sorted(map(tuple, tables.read("counted").collect())) == [(k, 10) for k in range(400)]
    tables.forget(rows, ["counted"])
    tables.run(stages, rows)
    assert not before & files("counted")  # no record names those runs any more
    assert sorted(map(tuple, tables.read("counted").collect())) == [(k, 10) for k in range(400)]
    assert tables.run({"none": lambda s, todo: rows.join(todo, "session_id", "left_semi").filter("n < 0")}, rows) == {"none": 400}
    assert tables.done("none").count() == 400
