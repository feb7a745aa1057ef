"""Benchmark contamination: passages of documents that resemble benchmark items.

Words are runs of letters and digits, in lower case; shingles have ``WIDTH`` words (a shorter item is one shingle). For
every item, windows of its size are laid over the documents. Only windows that hold one of the item's shingles can resemble
it at all, and among the starts where they do, none before the first or after the last alignment of a shared shingle does
better; so the other windows are left out without loss. Each remaining window and each item has a SimHash of its words,
weighted by their counts. Fingerprints are cut into ``RADIUS + 1`` blocks: two that differ in at most ``RADIUS`` bits agree in
some block, so an equi-join on (size, block number, block) finds all items within the radius. What is within it is
confirmed by the exact similarity of weighted shingles: the sum of the smaller counts over the sum of the larger ones.

Null and empty texts and items match nothing. Rows that repeat an id are looked at one by one and reported under that id;
rows with a null id are reported with a null id. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseloom.llm.common import stored

WIDTH = 5
THRESHOLD = 0.8
BITS = 64
RADIUS = 18
BROADCAST_SHINGLES = 1_000_000  # of 24 bytes; larger benchmarks are joined by shuffle


def words_of(text: Column) -> Column:
    """Hashes of the words, in order."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles_of(words: Column) -> Column:
    """One hash for each run of ``WIDTH`` words; for fewer words one of them all; none for none."""
    n = F.size(words)
    return F.when(n >= WIDTH, runs_of(words, WIDTH)).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def runs_of(words: Column, width: int) -> Column:
    """One hash for each run of ``width`` words; the hash of a run is that of the array of its words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(rows: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """``<keys>, fingerprint``: for each bit, whether it is set in most of the group's words."""
    votes = [F.sum(F.when(F.getbit(word, F.lit(b)) == 1, 1).otherwise(-1)).alias(f"_{b}") for b in range(BITS)]
    bits = [F.when(F.col(f"_{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.groupBy(*keys).agg(*votes).select(*keys, total.alias("fingerprint"))


def with_blocks(prints: DataFrame) -> DataFrame:
    """A row for each block of a fingerprint: its number and its bits."""
    count = RADIUS + 1
    cuts = [round(k * BITS / count) for k in range(count + 1)]
    blocks = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fingerprint", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("part"))
              for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return prints.select("*", F.inline(F.array(*blocks)))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, start, n_words, distance, similarity``: for each document and item the most similar window."""
    found = matches(docs, benchmark, **options)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col("start")).alias("s"), "n_words")).alias("_b"))
    return best.select("doc_id", "item_id", (-F.col("_b.s")).alias("start"), F.col("_b.n_words").alias("n_words"),
                       (-F.col("_b.d")).alias("distance"), F.col("_b.similarity").alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, doc_key, item_id, start, n_words, distance, similarity``: all windows that resemble an item.

    ``doc_key`` is the xxhash64 of id and text.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.inline(F.array(F.struct(words_of(F.col(item_text_col).cast("string")).alias("words")))))
    items = stored(items.filter(F.size("words") > 0).select("item_id", "words", F.size("words").alias("n_words"), F.xxhash64("words").alias("item_key"))
                   .dropDuplicates(["item_id", "item_key"]), "items")
    item_shingles = items.select("item_id", "item_key", "n_words", F.posexplode(shingles_of(F.col("words"))).alias("at", "shingle"))

    # 1. shared shingles: all shingles of all documents against those of the benchmark
    known = item_shingles.select("shingle").distinct()
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    hashed = rows.select("doc_id", F.xxhash64("doc_id", "_text").alias("doc_key"), F.inline(F.array(F.struct(words_of(F.col("_text")).alias("words")))))
    # items shorter than a shingle are looked for as runs of their own length
    widths = sorted(r[0] for r in items.select(F.least("n_words", F.lit(WIDTH))).distinct().collect()) or [WIDTH]
    placed = hashed.select("doc_id", "doc_key", F.inline(F.concat(*[F.transform(runs_of(F.col("words"), w), lambda h, i: F.struct(
        i.alias("pos"), h.alias("shingle"))) for w in widths])))
    hits = stored(placed.join(known, "shingle").distinct(), "hits")

    # 2. windows of the items' sizes where they can be most similar
    starts = hits.join(item_shingles, "shingle").select("doc_id", "doc_key", "item_key", "n_words", (F.col("pos") - F.col("at")).alias("start")).distinct()
    following = F.lead("start").over(Window.partitionBy("doc_id", "doc_key", "item_key").orderBy("start"))
    # alignments less than a window apart are of one passage: all starts between them are tried too
    last = F.when(following - F.col("start") <= F.col("n_words"), following - 1).otherwise(F.col("start"))
    windows = starts.withColumn("_last", last).select("doc_id", "doc_key", "n_words", F.explode(F.sequence("start", "_last")).alias("start")).distinct()
    texts = hashed.join(windows.groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("start", "n_words")).alias("_w"))
                        .select(F.col("doc_id").alias("_d"), F.col("doc_key").alias("_k"), "_w"),
                        (F.col("doc_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))).dropDuplicates(["doc_id", "doc_key"])
    cut = texts.select("doc_id", "doc_key", "words", F.inline("_w")).select(
        "doc_id", "doc_key", "start", "n_words", F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1,
                                                         F.greatest(F.col("n_words") + F.least(F.col("start"), F.lit(0)), F.lit(0))).alias("words"))
    cut = stored(cut.filter(F.size("words") > 0), "windows")

    # 3. fingerprints within the radius, by blocks
    window_key = ["doc_id", "doc_key", "start", "n_words"]
    of_windows = simhash(cut.select(*window_key, F.explode("words").alias("word")), window_key)
    of_items = simhash(items.select("item_id", "item_key", "n_words", F.explode("words").alias("word")), ["item_id", "item_key", "n_words"])
    met = with_blocks(of_windows).join(with_blocks(of_items).withColumnRenamed("fingerprint", "_other"), ["n_words", "block", "part"])
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("_other")))
    near = stored(met.filter(distance <= RADIUS).select(*window_key, "item_id", "item_key", distance.alias("distance")).distinct(), "near")

    # 4. exact weighted similarity
    pair = [*window_key, "item_id", "item_key", "distance"]
    counted = lambda rows, keys, name: rows.groupBy(*keys, "shingle").agg(F.count("*").alias(name))
    in_windows = counted(cut.select(*window_key, F.explode(shingles_of(F.col("words"))).alias("shingle")), window_key, "_n")
    in_items = counted(item_shingles, ["item_key", "item_id"], "_m")
    sizes = items.select("item_id", "item_key", F.size(shingles_of(F.col("words"))).alias("_item"))
    lengths = cut.select(*window_key, F.size(shingles_of(F.col("words"))).alias("_window"))
    key = lambda df: df.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    shared = (key(near).join(key(in_windows), window_key).join(in_items, ["item_id", "item_key", "shingle"])
              .groupBy(*pair).agg(F.sum(F.least("_n", "_m")).alias("_both")))
    judged = shared.join(key(lengths), window_key).join(sizes, ["item_id", "item_key"])
    similarity = F.col("_both") / (F.col("_item") + F.col("_window") - F.col("_both"))
    kind = docs.schema[id_col].dataType
    good = judged.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold)
    return good.select(F.nullif("doc_id", F.lit("")).cast(kind).alias("doc_id"), "doc_key", "item_id", "start", "n_words", "distance", "similarity")
