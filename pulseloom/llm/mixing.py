"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share by weight of all words, but at most ``MOST`` times its own size; what others can't take is shared
again by weight. Target over size is the expected number of copies of each of its documents (times the document's own weight,
if there is a column of weights). The whole part is taken for certain. The fraction is an inclusion probability p: documents
are ranked by Pareto's order, random odds u / (1 - u) over inclusion odds p / (1 - p), and the first ones are taken, up to the
place where the sum of their words comes nearest to what is left of the target (half a document off at most, the one at the
border). u is a digest of seed, id and text, so every run takes the same.

No source meets in one task: ranks and running sums come from a sort by range, in which only sums of whole ranges are carried on.
A null or empty text has size 0 and takes 0; a null source is a source, the last one; sources without words get target 0. Rows equal in
id and text have equal ranks, but are documents of their own. Null ids count like others. Weights that are null or not over
zero take nothing, unless no document of the source has one over zero: then all count alike. Extra columns play no part.
An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseloom.llm.common import stored

WEIGHTS = (5, 2, 1)  # of the sources in order, over and over
MOST = 3
SEED = "1"
WORD = r"[^\x20\x09-\x0D]+"  # fixed value


def words_in(text: Column) -> Column:
    """The number of runs of other characters than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest of ``key``."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def running(rows: DataFrame, order: list[str], sums: dict[str, str], within: list[str]) -> DataFrame:
    """``rows`` with ``_before_<name>`` for each of ``sums``: the sum of its column over the rows of the same ``within``
    that come earlier in ``order`` (which must begin with ``within``).

    Sorted by range, so a task holds one range of any group; the sums of whole ranges, a row for each range and group, are
    carried on.
    """
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    ranged = stored(ranged, "ranged")  # the split by range is fixed from here on
    totals = ranged.groupBy(*within, "_p").agg(*[F.sum(c).alias(f"_own_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_of_{c}") for c in within], F.col("_p").alias("_of_p"),
                           *[F.coalesce(F.sum(f"_own_{name}").over(earlier), F.lit(0)).alias(f"_carried_{name}") for name in sums])
    same = F.col("_p") == F.col("_of_p")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = Window.partitionBy("_p", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_here_{name}") for name, c in sums.items()])
    return out.join(totals, same).select(*rows.columns, *[
        (F.col(f"_carried_{name}") + F.col(f"_here_{name}")).alias(f"_before_{name}") for name in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, a row for each source."""
    placed = running(sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1)),
                     ["_null", "source"], {"place": "_one"}, [])
    placed = stored(placed.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (
        F.pmod("_before_place", F.lit(len(weights))) + 1).cast("int")).cast("long").alias("weight")), "sources")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    free = placed.agg(F.sum(wide("source_size")).alias("size")).first()["size"]
    share = Fraction(0)  # of a weight of one
    full = F.lit(False)
    total = int(free or 0)
    while True:  # a source once full stays full, as the share of the others only grows
        left = placed.agg(F.sum(F.when(~full, wide("weight"))).alias("w"), F.sum(F.when(full, most * wide("source_size"))).alias("s"),
                          F.count(F.when(full, 1)).alias("n")).first()
        if left["w"] is None:
            break
        share = Fraction(total - int(left["s"] or 0), int(left["w"]))
        now = most * wide("source_size") * F.lit(share.denominator).cast("decimal(20,0)") < wide("weight") * F.lit(share.numerator).cast("decimal(20,0)")
        if placed.filter(now).count() == left["n"]:
            break
        full = now
    rest, weight = share.numerator, share.denominator
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(
        F.lit(float(rest)) * F.col("weight").cast("double") / F.lit(float(weight)))
    return placed.select("source", "source_size", target.alias("target"))


def copies_by_weight(docs: DataFrame, most: int) -> DataFrame:
    """``docs`` with ``copies``, the expected copies: proportional to ``weight``, at most ``most``, and filling each source's target."""
    usable = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double")).otherwise(0.0)
    docs = docs.withColumn("weight", usable)
    level = stored(docs.groupBy("source").agg(F.max("weight").alias("_top"), F.max("target").alias("_target")), "levels")
    on = lambda a, b: a.join(b.select(F.col("source").alias("_s"), *[c for c in b.columns if c != "source"]), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    docs = on(docs, level.drop("_target")).withColumn("weight", F.when(F.col("_top") > 0, F.col("weight") / F.col("_top")).otherwise(1.0)).drop("_top")
    docs = stored(docs, "weighted")
    level = level.select("source", F.lit(0.0).alias("_level"))
    while True:  # a document once full stays full, as the level only rises
        full = F.col("weight") * F.col("_level") >= most
        sums = on(docs, level).groupBy("source").agg(
            F.max("target").alias("_target"), F.sum(F.when(full, most * F.col("size")).otherwise(0)).alias("_full"),
            F.sum(F.when(~full, F.col("weight") * F.col("size")).otherwise(0.0)).alias("_open"), F.max("_level").alias("_was"))
        rise = F.when(F.col("_open") > 0, (F.col("_target") - F.col("_full")) / F.col("_open")).otherwise(F.col("_was"))
        found = stored(sums.select("source", F.greatest(rise, "_was").alias("_level"), "_was"), "levels")
        level = found.drop("_was")
        if not found.filter(F.col("_level") > F.col("_was") * (1 + 1e-12)).limit(1).count():
            break
    return on(docs, level).withColumn("copies", F.least(F.lit(float(most)), F.col("weight") * F.col("_level"))).drop("_level")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """``id, size, source_size, target, copies, taken`` for every row: its words, those of its source, the source's target, how
    often it is expected in the mix, and how many of its words the mix takes (``size`` times its whole number of copies)."""
    text = F.col(text_col).cast("string")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    more = [F.col(weight_col).alias("weight")] if weight_col else []
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words_in(text).alias("size"), key.alias("key"), *more)
    slim = stored(slim, "sized")
    sources = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    named = sources.withColumnRenamed("source", "_s")
    slim = slim.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    slim = slim.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)) if not more else copies_by_weight(slim, most)
    whole = F.floor("copies").cast("long")
    slim = slim.withColumn("_whole", whole).withColumn("_part", F.col("copies") - F.col("_whole"))
    u = uniform(F.col("key"))
    odds = F.when(F.col("_part") > 0, (u / (1 - u)) / (F.col("_part") / (1 - F.col("_part")))).otherwise(float("inf"))
    ranked = slim.withColumn("_odds", odds).withColumn("_certain", F.col("_whole") * F.col("size"))
    # what is left of each target after the whole copies
    certain = ranked.groupBy("source").agg(F.sum("_certain").alias("_sum")).withColumnRenamed("source", "_s")
    ranked = ranked.withColumn("_nulls", F.col("source").isNull().cast("int"))
    ordered = running(ranked, ["_nulls", "source", "_odds", "key"], {"words": "size"}, ["_nulls", "source"])
    ordered = ordered.join(certain, F.col("source").eqNullSafe(F.col("_s")))
    nearer = (F.col("_part") > 0) & (2.0 * F.col("_before_words") + F.col("size") <= 2.0 * (F.col("target") - F.col("_sum")))
    taken = (F.col("_certain") + F.when(nearer, F.col("size")).otherwise(0)).cast("long")
    return ordered.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", taken.alias("taken"))
