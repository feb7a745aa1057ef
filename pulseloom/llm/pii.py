"""Personal data: fixed forms, and identifiers that the contexts of those betray.

The fixed forms (e-mail and IP addresses, card and phone numbers) are seeds. Every word of a text that holds a digit or
``@``, and every phone-like run, is an instance; the words next to it are its patterns: one or two on the left, one or two on
the right, and one on each side. A pattern is scored for a kind by the share of its distinct instances that are of
that kind, an instance by the patterns it is met with, whose odds are changed by its shape and its length: by how much more
frequent they are among the kind's seeds than among all instances, and down to ``UNLIKE`` if no seed has them. Both are repeated in turn,
until no instance becomes sure; sure instances count as seeds. Instances that are no seed and whose score
reaches the threshold are reported as ``like_<kind>``, wherever they stand.

Null and empty texts have no spans. Equal rows get equal results; ids may repeat or be null. Columns other than the id and
the text play no part. Instances may have any length: they are told apart by a hash of 64 bits. The words next to them
are looked for in the ``CONTEXT_CHARS`` characters on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseloom.functions.once import bind
from pulseloom.llm.common import stored
from pulseloom.llm.spans import accumulated, found, of_kind

# fixed values: the forms, written so that each is matched in one go (no form is retried inside a run it failed on)
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
INSTANCE = r"\+[0-9][\x20().0-9-]+[0-9]|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
KINDS = ["email", "ip", "card", "phone"]

CONTEXT_CHARS = 64
MIN_SEEDS = 5        # distinct seeds or sure instances a pattern must have been met with
THRESHOLD = 0.8      # score from which patterns spread and instances are reported
SMOOTHING = 1.0      # unlabelled instances every pattern is thought to have besides
UNLIKE = 0.5         # odds of an instance whose shape or length no seed has


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """The fixed forms by kind, then start. ``kind, start, end, value``."""
    octets = lambda s: F.forall(F.split(s["value"], r"\."), lambda o: (F.length(F.ltrim(o, F.lit("0"))) <= 3)
                                & (F.coalesce(o.try_cast("int"), F.lit(0)) <= 255))
    phone = lambda s: F.length(_digits(s["value"])).between(8, 15)
    return F.concat(of_kind(found(text, EMAIL), "email"), of_kind(F.filter(found(text, IP), octets), "ip"),
                    of_kind(F.filter(found(text, CARD), lambda s: _luhn(s["value"])), "card"),
                    of_kind(F.filter(found(text, PHONE), phone), "phone"))


def _shape(value: Column) -> Column:
    """What a value is made of: an address sign, a plus in front, digits alone, or letters and digits."""
    return F.when(F.contains(value, F.lit("@")), "@").when(F.startswith(value, F.lit("+")), "+").when(~value.rlike(r"\p{L}"), "9").otherwise("a9")


def instances(text: Column) -> Column:
    """``start, end, value`` of all instances, cut of the punctuation around them, and the words next to them: ``left, right``
    one, ``left2, right2`` two."""
    # each run of punctuation is looked at once, however long
    ahead, behind = r"^[^\p{L}\p{N}+]++", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"

    def one(s):
        value = F.regexp_replace(F.regexp_replace(s["value"], ahead, ""), behind, "")
        start = (s["start"] + F.length(F.regexp_extract(s["value"], ahead, 0))).cast("int")
        before, after = F.lower(F.right(s["before"], F.lit(CONTEXT_CHARS))), F.lower(F.left(s["after"], F.lit(CONTEXT_CHARS)))
        return F.struct(start.alias("start"), (start + F.length(value)).cast("int").alias("end"), value.alias("value"),
                        F.regexp_extract(before, r"(\S+)\s*$", 1).alias("left"), F.regexp_extract(after, r"^\s*(\S+)", 1).alias("right"),
                        F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1).alias("left2"), F.regexp_extract(after, r"^\s*(\S+\s+\S+)", 1).alias("right2"))
    return F.filter(F.transform(found(text, INSTANCE), one), lambda s: F.length(s["value"]) > 0)


def _likelihoods(values: DataFrame, name: str) -> DataFrame:
    """``_of, <name>, <name>_odds``: by how much a feature changes the odds of a kind; smoothed, so that none rules a kind out."""
    counts = values.groupBy(name).agg(F.count("*").alias("_all"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    total = counts.agg(*[F.sum(c).alias(f"_sum_{c}") for c in ["_all", *KINDS]])  # a few rows: shapes, or powers of two
    share = lambda c: F.col(c) / F.col(f"_sum_{c}")
    each = F.array(*[F.struct(F.lit(k).alias("_of"), (UNLIKE + (1 - UNLIKE) * F.when(F.col(f"_sum_{k}") > 0, share(k) / share("_all")).otherwise(0.0)).alias(f"{name}_odds"))
                     for k in KINDS])
    return stored(counts.join(F.broadcast(total)).select(name, F.inline(each)), "likelihoods")


def discovered(met: DataFrame, *, rounds: int | None = None, min_seeds: int = MIN_SEEDS, threshold: float = THRESHOLD) -> DataFrame:
    """``value`` (a hash), ``kind, score`` of the instances that good patterns betray, from ``value, left, right, left2, right2, kind`` (null: no seed).

    All steps are grouped sums over distinct (pattern, instance) edges: partial sums meet a frequent pattern's shuffle,
    never its rows. Pattern tables are joined by plain equi-joins, which Spark splits where a pattern is frequent.
    """
    alone = lambda side, name: F.when(F.length(name) > 0, F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(name), name).alias("pattern")))
    both = F.when((F.length("left") > 0) & (F.length("right") > 0), F.struct(F.lit("both").alias("side"), F.xxhash64(F.lit("both"), "left", "right").alias("pattern")))
    contexts = F.array_compact(F.array(alone("left", "left"), alone("left", "left2"), alone("right", "right"), alone("right", "right2"), both))
    own = [F.xxhash64("value").alias("value"), _shape(F.col("value")).alias("_shape"), F.floor(F.log2(F.length("value"))).cast("string").alias("_length")]
    features = ["_shape", "_length"]
    edges = stored(met.select(*own, "kind", F.inline(contexts)).groupBy("side", "pattern", "value", *features).agg(F.max("kind").alias("kind")), "edges")
    # a pattern of fewer instances can't have seeds enough
    frequent = edges.groupBy("pattern").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_seeds).select("pattern")
    edges = stored(edges.join(frequent, "pattern"), "edges")
    values = edges.groupBy("value", *features).agg(F.max("kind").alias("kind"))
    likely = {name: _likelihoods(values, name) for name in features}
    sums = [F.sum(F.when(F.col("kind") == k, F.lit(1.0)).otherwise(F.coalesce(F.col(f"_s_{k}"), F.lit(0.0)))).alias(f"_{k}") for k in KINDS]
    scored = None
    turn, sure_before = 0, 0
    while rounds is None or turn < rounds:
        # instances start unscored; seeds always count as certain
        now = (edges.select("*", *[F.lit(0.0).alias(f"_s_{k}") for k in KINDS]) if scored is None else
               edges.join(scored.filter(F.col("score") >= threshold).groupBy("value").agg(
                   *[F.max(F.when(F.col("_of") == k, F.col("score"))).alias(f"_s_{k}") for k in KINDS]), "value", "left"))
        patterns = now.groupBy("pattern").agg(F.count("*").alias("_n"), *sums, *[
            F.count_if((F.col("kind") == k) | (F.col("kind").isNull() & (F.col(f"_s_{k}") >= threshold))).alias(f"_seeds_{k}") for k in KINDS])
        good = patterns.select("pattern", F.explode(F.array_compact(F.array(*[
            F.when((F.col(f"_seeds_{k}") >= min_seeds) & (F.col(f"_{k}") / (F.col("_n") + SMOOTHING) >= threshold),
                   F.struct(F.lit(k).alias("_of"), (F.col(f"_{k}") / (F.col("_n") + SMOOTHING)).alias("_c"))) for k in KINDS]))).alias("_x")
        ).select("pattern", "_x.*")
        # an instance is as sure as its sides together (one minus the product of their doubts), or as the pattern of both
        sides = edges.filter(F.col("kind").isNull()).join(good, "pattern").groupBy("value", "_of", *features).agg(*[
            F.coalesce(F.max(F.when(F.col("side") == side, F.col("_c"))), F.lit(0.0)).alias(f"_{side}") for side in ("left", "right", "both")])
        sure = sides.select("value", "_of", F.greatest(1 - (1 - F.col("_left")) * (1 - F.col("_right")), F.col("_both")).alias("_c"), *features)
        for name, table in likely.items():
            sure = sure.join(F.broadcast(table), ["_of", name], "left")
        odds = F.col("_c") / F.greatest(1 - F.col("_c"), F.lit(1e-9))
        for name in likely:
            odds = odds * F.coalesce(f"{name}_odds", F.lit(UNLIKE))
        scored = stored(sure.select("value", "_of", (odds / (1 + odds)).alias("score")), "scores")
        # scores never fall from one turn to the next, so an equal number is the same instances
        turn, sure_now = turn + 1, scored.filter(F.col("score") >= threshold).count()
        if sure_now == sure_before:
            break
        sure_before = sure_now
    best = scored.filter(F.col("score") >= threshold).groupBy("value").agg(F.max(F.struct("score", "_of")).alias("_b"))
    return best.select("value", F.col("_b._of").alias("kind"), F.col("_b.score").alias("score"))


def _with_seeds(scanned: DataFrame) -> DataFrame:
    """The instances of each row with the kind of the first fixed form (in the order of kinds) that they overlap, if any.

    Forms of one kind don't overlap, so of those that begin before an instance ends, the last one ends last: one running
    maximum for each kind over the places of a text settles all its instances.
    """
    base = scanned.select("_id", "_key", F.inline("base")).select(
        "_id", "_key", F.col("start").alias("_at"), F.lit(1).alias("_form"), *[F.when(F.col("kind") == k, F.col("end")).alias(f"_end_{k}") for k in KINDS])
    met = scanned.select("_id", "_key", F.inline("_met")).withColumns({"_at": F.col("end"), "_form": F.lit(0)})  # a form at the very end is beyond it
    so_far = Window.partitionBy("_key", "_id").orderBy("_at", "_form").rowsBetween(Window.unboundedPreceding, 0)
    last = met.unionByName(base, allowMissingColumns=True).withColumns({f"_last_{k}": F.max(f"_end_{k}").over(so_far) for k in KINDS})
    kind = F.coalesce(*[F.when(F.col(f"_last_{k}") > F.col("start"), F.lit(k)) for k in KINDS])
    return last.filter("_form = 0").select("_id", "_key", "start", "end", "value", "left", "right", "left2", "right2", kind.alias("kind"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """``<id>, text_key, base, spans``: the fixed forms of each row, and all its spans (``kind, start, end, value``).

    ``text_key`` is the xxhash64 of id and text.
    """
    text = F.col(text_col).cast("string")
    scanned = stored(docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_key"), base_spans(text).alias("base"),
                                 instances(text).alias("_met")), "scanned")
    met = stored(_with_seeds(scanned.filter(F.size("_met") > 0).dropDuplicates(["_id", "_key"])), "met")
    new = discovered(met, **learning).select(F.col("value").alias("_value"), F.col("kind").alias("_as"))
    more = met.filter(F.col("kind").isNull()).join(new, F.xxhash64("value") == F.col("_value")).groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.struct(
        F.concat(F.lit("like_"), F.col("_as")).alias("kind"), "start", "end", "value"))).alias("_more")).withColumnRenamed("_id", "_other")
    rows = scanned.select("_id", "_key", "base")
    more = more.withColumnRenamed("_key", "_k")
    both = rows.join(more, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_other")), "left")
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)")
    return both.select(F.col("_id").alias(id_col), F.col("_key").alias("text_key"), "base", F.concat("base", F.coalesce("_more", empty)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with personal data replaced by its kind in brackets. Spans that overlap are one: it takes the kind of the first by start,
    then of the longest, and nothing of any of them is left."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("k"))))
    mark = lambda s: F.concat(F.lit("["), F.upper(F.regexp_replace(s["k"], "^like_", "")), F.lit("]"))

    def pieces(s, ends, part):
        """Text and mark at each span that begins after all before it have ended, and the text behind the last."""
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        one = lambda x, i: F.when(x["a"] >= before(i), F.concat(part(before(i), x["a"]), mark(x))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(s, one), ""), part(F.element_at(ends, -1), F.length(text)))

    # a place in a text is counted from its beginning, so with many spans the text is taken apart once
    cut = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    letters = lambda c: lambda a, b: F.when(b > a, F.array_join(F.transform(F.sequence(a, b - 1), lambda i: F.get(c, i)), "")).otherwise(F.lit(""))
    few = lambda s, ends: pieces(s, ends, cut)
    many = lambda s, ends: bind(F.split(text, ""), lambda c: pieces(s, ends, letters(c)))
    done = bind(keyed, lambda s: bind(accumulated(F.transform(s, lambda x: -x["b"]), F.greatest), lambda ends: F.when(
        F.size(s) <= 64, few(s, ends)).otherwise(many(s, ends))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
