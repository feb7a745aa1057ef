import datetime

import pytest
from pyspark.sql import functions as F

from pulseloom.functions import documents as js, moments as mo, scores as sc, text as tx
from pulseloom.functions.language import detect_language
from pulseloom.operators import filters as fl, projections as pj

UTC = datetime.timezone.utc


def values(spark, rows, kind, *exprs):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    out = df.select("i", *[e(F.col("x")).alias(f"v{n}") for n, e in enumerate(exprs)]).orderBy("i").collect()
    return [r["v0"] if len(exprs) == 1 else tuple(r)[1:] for r in out]


@pytest.mark.parametrize("step, cases", [
    (tx.clean_text, {None: "", "": "", "a &amp; <b>x</b>": "a & x", "Edit: thanks for the gold!!! ok...": "! ok.",
                     "#AICodingTools rock": "A I Coding Tools rock", "a#B": "aB", "[removed] see https://e.com/x?y now": "see now",
                     "flag \U0001F1EB\U0001F1F7 heart ❤️ done": "flag heart done", "x  y": "x y", "### head": "### head"}),
    (tx.spell_hashtags, {"#a_b #Élan x#yZ": "a_b Élan xy Z", "# no": "# no", "##TwoWords": "#Two Words"}),
    (tx.collapse_marks, {"wow!!! ok?!": "wow! ok!", "a..b": "a.b", "a.b": "a.b"}),
    (tx.digits, {"3,562 views": 3562, "none": 0, "": 0, None: 0}),
    (lambda x: tx.truncate(x, 5), {"abcde": "abcde", "abcdef": "abcde..."}),
    (tx.token_estimate, {"abcdefg": 1, "abcdefgh": 2}),
])
def test_text_steps(spark, step, cases):
    assert values(spark, list(cases), "string", step) == list(cases.values())


def test_text_steps_leave_out_what_cannot_match(spark):
    """Counting to fifteen makes no list of words, and the results of guarded steps are those of their plain patterns."""
    blanks = [" ", "\t", "\u00a0", "\u3000", "\x1f", "\n \r", "\u2028"]
    texts = [pre + sep.join(["w\U0001F680é"[:1 + n % 3]] * n) + end for n in (0, 1, 14, 15, 16) for sep in blanks for pre in ("", " ") for end in ("", sep)]
    assert values(spark, texts, "string", lambda x: fl.enough_words(x)) == [n >= 15 for n in values(spark, texts, "string", tx.word_count)]
    assert values(spark, ["", "a"], "string", lambda x: fl.enough_words(x, 0), lambda x: fl.enough_words(x, 1)) == [(True, False), (True, True)]
    odd = ["", "a:b", "[x]", "http://e.com/x", "HTTP://e", "EDIT : thank for the GOLD", "x [Removed] y", "edit", "\u2190\u21ff\ufe0f", "\u2189\u2200\u25ff\u27c0",
           "\U0001F1E6\U0001F1FF\U0001F2FF", "\U0001FAFF\U0001FB00", "“ü”", "!?.", "a!!b", "...", "!", "a?!.!b.c"]
    pattern = lambda p, to: lambda x: F.regexp_replace(x, p, to)
    got = values(spark, odd, "string", tx.strip_boilerplate, pattern(tx.BOILERPLATE, " "), tx.strip_emoji, pattern(tx.EMOJI, " "),
                 tx.collapse_marks, pattern(r"([!?.]){2,}", "$1"))
    assert all(a == b and c == d and e == f for a, b, c, d, e, f in got)
    plan = lambda c: spark.range(1).select(c(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert "split(" not in plan(fl.enough_words)


def test_word_chunks(spark):
    text = " ".join(f"w{i}" for i in range(331))
    chunks = values(spark, ["", "a b", text, " ".join(["x"] * 330)], "string", tx.chunk_words)
    assert chunks[0] == [] and chunks[1] == ["a b"]
    assert [c.split()[0] for c in chunks[2]] == ["w0", "w150", "w300"]
    assert len(chunks[3]) == 2


def test_topics_and_tags(spark):
    assert values(spark, [[" A  b", "a B", "", "c", "d"]], "array<string>", lambda x: tx.normalize_topics(x, 3)) == [["a b", "c"]]
    assert values(spark, ["#a, b,##a,, #"], "string", tx.split_tags) == [["a", "b"]]


def test_moments(spark):
    now = datetime.datetime(2024, 1, 31, tzinfo=UTC)
    as_of = F.timestamp_seconds(F.lit(int(now.timestamp())))
    day = datetime.timedelta(days=1)
    cases = {"11 months ago": now - 330 * day, "Streamed 3 weeks ago": now - 21 * day, "2yr ago": now - 730 * day,
             "10h ago": now - datetime.timedelta(hours=10), "2mo ago": now - 60 * day, "2024-01-02T03:04:05Z": datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC),
             "2024-01-02T03:04:05": datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC), "2024-01-02": datetime.datetime(2024, 1, 2, tzinfo=UTC), "": now, None: now, "junk": now}
    got = values(spark, list(cases), "string", lambda x: F.unix_seconds(mo.parse_moment(x, as_of)))
    assert got == [int(v.timestamp()) for v in cases.values()]
    assert values(spark, [0, None, 1700000000], "bigint", lambda x: F.unix_seconds(mo.from_epoch_seconds(x, as_of))) == [int(now.timestamp())] * 2 + [1700000000]
    assert values(spark, ["3:59", "4:00", "20:00", "1:00:00", "live"], "string", fl.duration_bucket) == [
        "Under 4 minutes", "4 - 20 minutes", "4 - 20 minutes", "Over 20 minutes", None]


def test_clamp_keeps_null(spark):
    assert values(spark, [-1.0, 0.5, 2.0, None], "double", sc.clamp01) == [0.0, 0.5, 1.0, None]


def test_replies(spark):
    raw = ['{"entity": "a"}', 'x\n```json\n{"entity": "b"}\n```', '[{"entity": "c"}]', "[]", "{broken", None]
    assert values(spark, raw, "string", lambda x: js.field(js.reply_document(x), "$.entity")) == ["a", "b", "c", None, None, None]
    assert values(spark, ['{"subtopics": ["a", 1, null, "b"]}', "no"], "string", js.subtopic_reply) == [["a", "b"], []]
    got = values(spark, ['note {"category": " X ", "intent": "brand", "confidence": 7} end', "{}", "none"], "string",
                 lambda x: js.intent_reply(x, F.lit("q")))
    assert [tuple(g) for g in got] == [("q", "X", "brand", 1.0), ("q", "General", "topic", 0.5), ("q", "General", "topic", 0.3)]


def test_language(spark):
    texts = ["the cat is on the mat and it was not for you", "le chat est dans la maison et il ne dort pas", "12345 !!!", None]
    assert values(spark, texts, "string", detect_language) == ["en", "fr", None, None]


def test_urls(spark):
    links = ["https://www.instagram.com/p/Ab_1/?x=1#f", "/reel/Z9", "http://instagram.com/reel/q//", "https://evil.example/p/a/", "/explore/", "", None]
    assert values(spark, links, "string", pj.canonical_post_url) == [
        "https://www.instagram.com/p/Ab_1/", "https://www.instagram.com/reel/Z9/", "https://www.instagram.com/reel/q/", None, None, None, None]
    assert values(spark, ["/r/x", "http://y", "", None], "string", pj.absolute_url) == ["https://old.reddit.com/r/x", "http://y", None, None]
