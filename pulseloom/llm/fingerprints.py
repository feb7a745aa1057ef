"""I-Match fingerprints: hashes of a document's terms of middling rarity, over several random parts of the lexicon.

The lexicon holds the terms that occur in at least ``LEAST`` and at most ``MOST`` of all documents, a band of inverse document
frequency. As a document adds to the counts of its own terms alone, the lexicon has at most (mean terms of a document) /
``LEAST`` terms, however large the corpus is. Of each text the distinct terms in the lexicon are sorted and hashed, once over
the whole lexicon and once over each random part of it; the finer the parts, the more of them an edit leaves as they are.
The likeness of two fingerprints is the share of equal hashes among the parts in which either text has a term.

A text without a term in the band is fingerprinted by the hash of all its terms (``t:``), and is like only its equals. Null
texts are empty ones. Terms are lower-cased runs of letters and digits. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.common import next_smaller, stored
from pulseloom.llm.decontaminate import words_of

LEAST, MOST = 0.003, 0.1
PARTS = ((1, 1), (64, 32), (512, 32))  # one term in so many belongs to a part; parts of that fineness
BROADCAST_TERMS = 2_000_000
NO_TERM = 0  # stands for "this text", so that texts without a known term are not lost in the join


def terms_of(text: Column) -> Column:
    return F.array_distinct(words_of(text))


def lexicon(docs: DataFrame, *, text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """``term`` (hashed) of the band, from all documents."""
    total = docs.count()
    counts = docs.select(F.explode(terms_of(F.col(text_col).cast("string"))).alias("term")).groupBy("term").count()
    return counts.filter(F.col("count").between(least * total, most * total)).select("term")


def _belongs(shift: int, one_in: int, part: int):
    return lambda term: F.shiftright(term, shift).bitwiseAND(F.lit(one_in - 1)) == part


def part_hashes(terms: Column) -> Column:
    """A text's hash for each part of the lexicon, as hexadecimal digits; empty where it has no term. ``terms`` must be sorted."""
    out, shift = [], 3
    for one_in, number in PARTS:
        for part in range(number):
            own = F.filter(terms, _belongs(shift, one_in, part)) if one_in > 1 else terms
            out.append(F.when(F.size(own) > 0, F.right(F.lpad(F.lower(F.hex(F.xxhash64(own))), 16, "0"), F.lit(8))).otherwise(""))
        shift += max(1, one_in.bit_length() - 1)
    return F.array(*out)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of two arrays of part hashes (or of single hashes)."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != "") | (p["b"] != ""))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(a == b, F.lit(1.0)).when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(same, F.size(pairs)), F.lit(0.0)))


def written(parts: Column) -> Column:
    return F.when(F.size(parts) > 1, F.concat(F.lit("i:"), F.array_join(parts, "."))).otherwise(F.concat(F.lit("t:"), parts[0]))


def fingerprints(texts: DataFrame, known: DataFrame, keys: list[str], facts: list[str], *, text_col: str = "text") -> DataFrame:
    """``<keys>, <facts>, parts`` for each row of ``texts``; ``known`` is a written lexicon. ``keys`` tell the texts apart."""
    words = texts.select(*keys, *facts, F.inline(F.array(F.struct(terms_of(F.coalesce(F.col(text_col), F.lit(""))).alias("_terms")))))
    words = words.withColumn("_all", F.xxhash64(F.array_sort("_terms")))
    spread = words.select(*keys, *facts, "_all", F.explode(F.array_append("_terms", F.lit(NO_TERM).cast("long"))).alias("term"))
    wanted = known.unionByName(known.sparkSession.range(NO_TERM, NO_TERM + 1).select(F.col("id").alias("term"))).distinct()
    # bounded by the band (see above), and counted all the same
    wanted = F.broadcast(wanted) if known.count() <= BROADCAST_TERMS else wanted
    met = spread.join(wanted, "term").groupBy(*keys).agg(
        *[F.max(f).alias(f) for f in facts], F.max("_all").alias("_all"),
        F.array_sort(F.array_remove(F.collect_set("term"), NO_TERM)).alias("_terms"))
    single = F.array(F.lpad(F.lower(F.hex("_all")), 16, "0"))
    return met.select(*keys, *facts, F.when(F.size("_terms") > 0, part_hashes(F.col("_terms"))).otherwise(single).alias("parts"))


def edited_and_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the same text with its last third replaced by the start of the next document, and of
    the next document (by descending id; after the smallest comes the greatest).

    Rows without an id have no place in that order and are left out. Of rows that repeat an id, the smallest text is what
    comes before or after; each of them has a row in the result if their texts differ.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = stored(lexicon(docs, text_col=text_col), "lexicon")
    third = F.floor(F.length("text") / 3).cast("int")
    ids = rows.select("doc_id", third.alias("need")).groupBy("doc_id").agg(F.max("need").alias("need"))
    ids = stored(next_smaller(ids, "doc_id", ["need"]), "order")
    # of the next text only what is needed goes on to the document it belongs to
    wanted = ids.select(F.col("next_doc_id").alias("doc_id"), F.col("doc_id").alias("_for"), "need")
    heads = rows.join(wanted.hint("shuffle_hash"), "doc_id").groupBy(F.col("_for").alias("doc_id")).agg(F.min(F.left("text", F.col("need"))).alias("_head"))
    both = rows.join(heads, "doc_id").withColumn("_need", third)
    edited = F.concat(F.left("text", F.length("text") - F.col("_need")), F.left("_head", F.col("_need")))
    texts = both.select("doc_id", F.xxhash64("text").alias("text_key"), F.length("text").cast("long").alias("n_chars"), F.inline(F.array(
        F.struct(F.lit(False).alias("edited"), F.col("text").alias("text")), F.struct(F.lit(True).alias("edited"), edited.alias("text")))))
    texts = texts.withColumn("sha256", F.when(F.col("edited"), F.sha2("text", 256)))
    prints = fingerprints(texts, known, ["doc_id", "text_key", "edited"], ["n_chars", "sha256"])
    of = lambda edited: F.max(F.when(F.col("edited") == edited, F.col("parts")))
    each = stored(prints.groupBy("doc_id", "text_key").agg(F.max("n_chars").alias("n_chars"), F.max("sha256").alias("edited_sha256"),
                                                           of(False).alias("own"), of(True).alias("changed")), "prints")
    following = each.groupBy("doc_id").agg(F.min("own").alias("_next"))
    following = ids.select("doc_id", F.col("next_doc_id")).join(following.withColumnRenamed("doc_id", "next_doc_id"), "next_doc_id").select("doc_id", "_next")
    return each.join(following, "doc_id").select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("_next")).alias("near_next"))
