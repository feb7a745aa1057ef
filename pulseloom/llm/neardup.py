"""Near-duplicate documents by an LSH forest over MinHash signatures of word shingles.

Words are runs without white space, A-Z lower-cased; a text's set holds its distinct shingles of ``WIDTH`` words, or its
whole word sequence as one shingle if it has fewer. Texts of equal sets are one node. Each of ``TREES`` orders sorts all
nodes by their own minima in turn; neighbours in an order are candidates when the prefix they share is at least
``MIN_DEPTH`` long. Neighbours share the longest prefixes of their region, so where many nodes resemble each other only the
deepest are compared; nodes that no minimum tells apart come in another order in each tree. Candidates whose sketches differ
too much for the threshold are dropped (the bound is over four standard deviations away), all others are confirmed on the full
sets of both texts. The first ``FIRST_TREES`` orders link the next neighbour only, which is enough to bring a large group
together; then all orders are searched again, among nodes of different components: a group that is one already gives no more pairs.

The forest links most of each group at small cost, but it may miss partners where more nodes than its neighbours share a
prefix (templates, common passages). So a second search is complete: similar sets share a shingle among the first few of
both in any order common to all (prefix filter). Shingles known as common come last in that order, and pairs that the forest
has brought together are left out, so neither a family just under the threshold nor a large group is squared.

Null and empty texts, and those of white space alone, have an empty set, link with nothing and stay. Rows of equal
``doc_id`` are judged by their own texts; rows with a null id link with nothing. Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseloom.llm.common import attempt_name, removed, stored
from pulseloom.llm.tokens import slices
from pulseloom.operators.components import connected_components

WIDTH = 5
TREES, DEPTH, HASHES = 16, 6, 128
FIRST_TREES = 4
MIN_DEPTH = 3
NEIGHBOURS = 3
SLACK = 4.5  # standard deviations that an estimate may lie under the threshold
BEFORE = 4  # shared shingles before one that are looked at to tell whether a pair has met already
WIDE_SLACK = 8.5  # the same in the complete search: under 1e-11 of the true pairs lie below at 80 % and 85 %
# what is known of common shingles only orders them: the search is complete whatever these are
COMMON_SAMPLE, COMMON_LEAST, COMMON_MOST = 25_000, 3, 1_000_000
LIKELY_BITS = 1 << 23  # of the bitmap that tells which texts may be needed: a megabyte, whatever the input

_rng = np.random.Generator(np.random.PCG64(20240607))
_MULTIPLIERS = _rng.integers(1, 1 << 63, HASHES // 2, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
# fixed values: white space is the blank and the bytes 9 to 13
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, in a row; and where each text's begin (one more than texts)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    inside = _WORD[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False  # no word reaches over from the text before
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    # a word's hash from sums of its bytes times powers of an odd number, brought to the power zero
    powers = np.full(n, _BASE)
    inverse = np.full(n, _INVERSE)
    if n:
        powers[0] = inverse[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * np.cumprod(powers), out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * np.cumprod(inverse)[starts]) if n else np.zeros(0, np.uint64)
    of_text = np.searchsorted(starts, offsets)  # words before each text
    counts = np.diff(of_text)
    whole = counts >= width
    number = np.where(whole, counts - width + 1, np.minimum(counts, 1))
    first = np.cumsum(number) - number
    total = int(number.sum())
    out = np.zeros(total, np.uint64)
    if len(words):
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled += words[k:k + len(rolled)] * _STEPS[k]
        long = np.flatnonzero(whole)
        lengths = number[long]
        run = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(first[long], lengths) + run] = _mix(rolled[np.repeat(of_text[:-1][long], lengths) + run])
        for k in np.flatnonzero((counts > 0) & ~whole):
            own = words[of_text[k]:of_text[k + 1]]
            out[first[k]] = _mix(np.array([np.sum(own * _STEPS[8:8 + len(own)]) + np.uint64(len(own))], np.uint64))[0]
    bounds = np.append(first, total)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(total, bool)
    new[1:] = out[1:] != out[:-1]
    new[first[number > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[bounds]


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``HASHES`` 32-bit minima for each non-empty set (``starts`` without the end)."""
    result = np.zeros((len(starts), HASHES), np.uint32)
    for k, factor in enumerate(_MULTIPLIERS):
        halves = (shingles * factor).view(np.uint32).reshape(-1, 2)
        result[:, 2 * k:2 * k + 2] = np.minimum.reduceat(halves, starts, axis=0)
    return result


def common_shingles(docs: DataFrame, *, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in many texts of a sample, sorted, and in how many; of bounded number at any size of ``docs``."""
    def explode(batches):
        for batch in batches:
            for _, texts in slices(batch.column(0), 2_000_000):
                shingles, _ = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64))], names=["shingle"])

    rows = docs.count()
    one_in = max(1, rows // COMMON_SAMPLE)
    text = F.col(text_col).cast("string")
    sample = docs.filter(F.pmod(F.xxhash64(text), F.lit(one_in)) == 0).select(text.alias("text")).distinct()
    least = COMMON_LEAST
    counts = stored(sample.mapInArrow(explode, "shingle long").groupBy("shingle").count().filter(F.col("count") >= least), "common")
    while counts.filter(F.col("count") >= least).count() > COMMON_MOST:
        least *= 2
    table = counts.filter(F.col("count") >= least).toArrow()
    shingles, number = table.column("shingle").to_numpy().astype(np.int64).view(np.uint64), table.column("count").to_numpy().astype(np.int64)
    removed(counts)
    order = np.argsort(shingles)
    return shingles[order], np.minimum(number[order], (1 << 30) - 1)


def prefixes(shingles: np.ndarray, bounds: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set, by how common they are and then by hash; and where each set's begin.

    As many as it takes: a set that is similar to one of at most its size shares one of these with it.
    """
    sizes = np.diff(bounds)
    number = np.zeros(len(shingles), np.int64)
    known, times = common
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        hit = known[at] == shingles
        number[hit] = times[at[hit]]
    # sets are sorted by hash already, and a stable sort keeps that
    order = np.argsort((np.repeat(np.arange(len(sizes)), sizes) << 30) + number, kind="stable")
    lengths = np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)  # size - ceil(percent * size / 100) + 1
    starts = np.cumsum(lengths) - lengths
    taken = np.repeat(bounds[:-1] - starts, lengths) + np.arange(int(lengths.sum()))
    return shingles[order[taken]], np.append(starts, lengths.sum())


SIGNED = "doc_id long, text_key long, n_shingles long, node binary, keys array<binary>, sketch binary, prefix array<long>"


def signatures(docs: DataFrame, *, id_col: str, text_col: str, percent: int = 80) -> DataFrame:
    """``doc_id, text_key, n_shingles`` and, for non-empty sets, the node (a 128-bit hash of the set), tree keys, sketch, prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col=text_col))

    def sign(batches):
        common = shared.value
        for batch in batches:
            for at, texts in slices(batch.column(2), 2_000_000):
                shingles, bounds = shingle_sets(texts)
                sizes = np.diff(bounds)
                firsts, places = prefixes(shingles, bounds, common, percent)
                some = np.flatnonzero(sizes)
                nodes, keys, sketches = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                if len(some):
                    starts = bounds[:-1][some]
                    low = minima(shingles, starts)
                    both = np.stack([np.add.reduceat(_mix(shingles ^ np.uint64(salt)), starts) for salt in (0x1234567, 0x89ABCDEF01)], axis=1)
                    big = np.ascontiguousarray(low[:, :TREES * DEPTH].astype(">u4"))
                    bytes_ = np.ascontiguousarray((low & 0xFF).astype(np.uint8))
                    for row, k in enumerate(some.tolist()):
                        nodes[k] = both[row].tobytes()
                        raw = big[row].tobytes()
                        keys[k] = [bytes([t]) + raw[4 * DEPTH * t:4 * DEPTH * (t + 1)] for t in range(TREES)]
                        sketches[k] = bytes_[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(sizes.astype(np.int64)),
                     pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.binary())), pa.array(sketches, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(firsts.view(np.int64)))],
                    names=["doc_id", "text_key", "n_shingles", "node", "keys", "sketch", "prefix"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(sign, SIGNED)


def forest_candidates(nodes: DataFrame, *, trees: int = TREES, min_depth: int = MIN_DEPTH, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``a, b`` (a < b): pairs of nodes within ``neighbours`` places in some tree's order whose prefixes agree long enough, and
    whose ``part`` is not the same (null: none).

    All trees are sorted together by range, so a region of any size is spread over tasks; the few rows at the borders
    between ranges are paired afterwards.
    """
    prefix = 1 + 4 * min_depth  # a key is the tree's number and big-endian minima

    def pair(rows):
        for far in range(1, neighbours + 1):
            for (key, node, part), (key2, node2, part2) in zip(rows, rows[far:]):
                if key[:prefix] == key2[:prefix] and (part is None or part != part2):
                    yield (node, node2) if node < node2 else (node2, node)

    def neighbours_of(batches):
        range_, _ = attempt_name()
        last, edge, count = [], [], 0
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            if count < neighbours:
                edge += rows[:neighbours - count]
            count += len(rows)
            rows = last + rows
            # pairs among the rows kept from the batch before come again; they are the same pairs
            found = list(set(pair(rows)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary()), pa.nulls(len(found), pa.int64()),
                                                  pa.nulls(len(found), pa.binary()), pa.nulls(len(found), pa.int64())], names=["a", "b", "range", "key", "part"])
            last = rows[-neighbours:]
        rows = list(dict.fromkeys(edge + last))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), pa.nulls(len(rows), pa.binary()), pa.array([range_] * len(rows), pa.int64()),
                                              pa.array([r[0] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["a", "b", "range", "key", "part"])

    sorted_by = ["key", "tie", "node"]
    listed = nodes.select(F.explode(F.slice("keys", 1, trees)).alias("key"), "node", "part")
    ordered = listed.withColumn("tie", F.xxhash64(F.substring("key", 1, 1), "node")).repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by)
    found = stored(ordered.select("key", "node", "part").mapInArrow(neighbours_of, "a binary, b binary, range long, key binary, part long"), "neighbours")
    borders = found.filter(F.col("range").isNotNull())
    # a few rows for each range, of which each task had its own
    order = Window.partitionBy(F.lit(0)).orderBy("key", F.xxhash64(F.substring("key", 1, 1), "a"), "a")
    across = borders.select("a", "key", "part", *[F.struct(F.lead("a", k).over(order).alias("b"), F.lead("key", k).over(order).alias("k"), F.lead("part", k).over(order).alias("p")).alias(f"_{k}")
                                                  for k in range(1, neighbours + 1)])
    across = across.select(F.col("a").alias("x"), "key", "part", F.explode(F.array(*[f"_{k}" for k in range(1, neighbours + 1)])).alias("o"))
    across = across.filter((F.substring("key", 1, prefix) == F.substring("o.k", 1, prefix)) & (F.col("part").isNull() | (F.col("part") != F.col("o.p")))).select(
        F.least("x", "o.b").alias("a"), F.greatest("x", "o.b").alias("b"))
    return found.filter(F.col("range").isNull()).select("a", "b").unionByName(across).filter("a <> b").distinct()


def node_number() -> Column:
    """60 bits of a node's hash; nodes of equal numbers are all candidates."""
    return F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long")


def meetings(nodes: DataFrame, groups: DataFrame, percent: int, *, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``i, j``, numbers of nodes: every pair of nodes of different components that may satisfy ``100 * intersection >= percent * union``.

    The smaller set of a pair (n of n <= m shingles) shares one of its first n - ceil(2 p n / (100 + p)) + 1 with the first
    m - ceil(p m / 100) + 1 of the larger. Shingles met in one component only pair nothing, and are settled by partial sums.
    Of the others, the rows of each shingle's largest component never meet each other. A pair is needed once only, at the first
    shingle that it shares: where it shares one of the last ``BEFORE`` as well, it has met there already.
    ``spent`` are written tables that nobody needs any more once the prefixes are laid out; they are removed then.
    """
    of = groups.select("node", F.xxhash64("component").alias("c"))
    entries = stored(nodes.join(of, "node").select(node_number().alias("i"), "c", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("at", "t")), "prefixes")
    for table in spent:
        removed(table)
    several = entries.groupBy("t").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).filter("_low <> _high").select("t")
    shared = stored(entries.join(several, "t"), "shared_prefixes")
    removed(entries)  # by far the largest table, and not needed any more
    largest = shared.groupBy("t", "c").count().groupBy("t").agg(F.max(F.struct("count", "c"))["c"].alias("_of"))
    # one node's, and what two nodes of different components share is among them
    before = Window.partitionBy("i", "c", "n").orderBy("at").rowsBetween(-BEFORE, -1)
    met = stored(shared.join(largest, "t").withColumn("most", F.col("c") == F.col("_of")).drop("_of").withColumn("before", F.collect_list("t").over(before)),
                 "shared_prefixes")
    removed(shared)
    n, m = F.col("n"), F.col("m")
    least = lambda total, over: F.expr(f"({total} + {over} - 1) div {over}")
    left = met.filter(F.col("at") <= F.col("n") - least(f"{2 * percent} * n", 100 + percent))
    right = met.select("t", F.col("i").alias("j"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("at").alias("by"), F.col("most").alias("usual"), F.col("before").alias("earlier"))
    most = F.least(n - F.col("at"), m - F.col("by"))  # that they share, if this is the first
    possible = (F.col("c") != F.col("d")) & (n <= m) & (100 * n >= percent * m) & ((n < m) | (F.col("i") < F.col("j"))) & (
        most >= least(f"{percent} * (n + m)", 100 + percent)) & ~F.arrays_overlap("before", "earlier")
    return left.filter("not most").join(right, "t").filter(possible).select("i", "j").unionByName(
        left.filter("most").join(right.filter("not usual"), "t").filter(possible).select("i", "j"))


def prefix_candidates(nodes: DataFrame, groups: DataFrame, percent: int, *, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``a, b``: the nodes of every pair that meets, once. ``spent`` as in ``meetings``; ``groups`` holds all nodes."""
    found = meetings(nodes, groups, percent, spent=spent).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    named = groups.select(node_number().alias("i"), "node")
    return found.join(named.withColumnRenamed("node", "a"), "i").join(named.select(F.col("i").alias("j"), F.col("node").alias("b")), "j").select("a", "b").filter("a <> b")


def resembling(pairs: DataFrame, sketches: DataFrame, percent: int, slack: float = SLACK) -> DataFrame:
    """Pairs with the similarity that their sketches show, without those that can't reach the threshold."""
    need = percent / 100
    floor = need - slack * (need * (1 - need) / HASHES) ** 0.5

    def estimate(batches):
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            agree = (left == right).mean(axis=1)
            guess = (agree - 1 / 256) / (1 - 1 / 256)  # bytes also agree by chance
            keep = pa.array(guess >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(guess[guess >= floor])], names=["a", "b", "guess"])

    left, right = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(estimate, "a binary, b binary, guess double")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets satisfy ``100 * intersection >= percent * union``."""
    def compare(batches):
        for batch in batches:
            for at, left in slices(batch.column(2), 1_000_000):
                right = batch.column(3).slice(at, len(left))
                x, xs = shingle_sets(left)
                y, ys = shingle_sets(right)
                good = []
                for k in range(len(left)):
                    own, other = x[xs[k]:xs[k + 1]], y[ys[k]:ys[k + 1]]
                    if percent * max(len(own), len(other)) <= 100 * min(len(own), len(other)):
                        shared = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * shared >= percent * (len(own) + len(other) - shared):
                            good.append(at + k)
                if good:
                    yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good)) for k in (0, 1)], names=["a", "b"])

    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a binary, b binary")


def likely(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``source`` whose ``text_key`` may be among those of ``wanted``: all of these, and some others by chance.

    A bitmap of bounded size travels to the rows, so texts that nobody asks for are not shuffled.
    """
    bit = F.pmod("text_key", F.lit(LIKELY_BITS))
    maps = wanted.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    placed = source.withColumn("_bucket", F.bitmap_bucket_number(bit)).withColumn("_place", F.bitmap_bit_position(bit))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return placed.join(F.broadcast(maps), "_bucket").filter(F.getbit(byte, F.pmod("_place", F.lit(8)).cast("int")) == 1).select(*source.columns)


def near_duplicates(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    min_depth: int = MIN_DEPTH, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept``, a row for each row of ``docs``; ``text_key`` is the text's xxhash64.

    A component is named after its smallest ``doc_id``, which is the document kept (of rows that share it, the one with the
    smallest key; rows equal in both are one document, and all kept or none). Confirmation goes in three turns: first
    each node with its likest next neighbour, then what the whole forest, and last what the complete search finds between
    different components. A pair inside one component changes nothing, so all candidates count, but large groups don't confirm
    every pair. Written tables are removed as soon as the next ones are written, the wide ones first.
    """
    signed = stored(signatures(docs, id_col=id_col, text_col=text_col, percent=percent), "signatures")
    members = stored(signed.select("doc_id", "text_key", "n_shingles", "node"), "members")
    some = signed.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    wide = stored(some.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("_first"),
                                           F.first("keys").alias("keys"), F.first("sketch").alias("sketch"),
                                           F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix")), "nodes")
    removed(signed)
    nodes = stored(wide.select("node", "_first", "sketch"), "nodes")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_key"))

    def links_of(pairs):
        """The pairs that the texts of their nodes confirm, written; only texts of nodes that have candidates travel."""
        involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        first = stored(nodes.join(involved, "node").select("node", "_first.doc_id", "_first.text_key"), "involved")
        texts = stored(likely(source, first).join(first, ["doc_id", "text_key"]).select("node", "text").dropDuplicates(["node"]), "texts")
        links = stored(confirmed(pairs, texts, percent), "links")
        removed(first)
        removed(texts)
        return links

    unlinked = wide.withColumn("part", F.lit(None).cast("long"))
    first = stored(resembling(forest_candidates(unlinked, trees=FIRST_TREES, min_depth=min_depth, neighbours=1), nodes, percent), "candidates")
    likest = first.select("*", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.max(F.struct("guess", "a", "b")).alias("_m")).select("_m.a", "_m.b").distinct()
    links = links_of(likest)
    groups = stored(_components(nodes, links), "groups")
    parted = wide.join(groups.select("node", F.xxhash64("component").alias("part")), "node")
    more = stored(resembling(forest_candidates(parted, min_depth=min_depth, neighbours=neighbours), nodes, percent).select("a", "b"), "candidates")
    links = links.unionByName(links_of(more))
    groups = stored(_components(nodes, links), "groups")
    last = stored(resembling(prefix_candidates(wide, groups, percent, spent=(wide,)), nodes, percent, WIDE_SLACK).select("a", "b"), "candidates")
    groups = stored(_components(nodes, links.unionByName(links_of(last))), "groups")
    removed(nodes)
    named = groups.groupBy("component").agg(F.min("_first").alias("_kept"))
    result = members.join(groups.join(named, "component").select("node", "_kept"), "node", "left")
    own = F.struct("doc_id", "text_key")
    return result.select("doc_id", "text_key", "n_shingles", F.coalesce("_kept.doc_id", "doc_id").alias("component_id"),
                         (F.col("_kept").isNull() | F.col("doc_id").isNull() | (own == F.col("_kept"))).alias("kept"))


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = connected_components(nodes, edges, keys=[], id_col="node")
    return nodes.select("node", "_first").join(found, "node").select("node", "_first", "component")
