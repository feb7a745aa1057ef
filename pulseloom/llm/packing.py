"""Best-fit packing of token sequences by bin completion.

Only the number of pieces of each length matters for the packing, and there are at most ``capacity`` lengths: Spark
counts them, the driver packs the counts, and tasks give every piece its place from its rank among the pieces of its
length. What the driver holds is bounded by ``capacity``, not by the corpus.

Texts longer than ``capacity`` are cut from their end, so that only a text's first piece may be shorter. Null and empty
texts are their end id alone. Rows with equal or null ids are documents of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pulseloom.llm.common import stored
from pulseloom.llm.tokens import kept_encoder, slices

CAPACITY = 1024
END_ID = 2
NODES = 1500     # fillings that the search opens before it keeps the best packing so far
FILLINGS = 12    # undominated fillings tried for one largest piece
BUCKETS = 64     # parts in which the pieces of one length are ranked

Packing = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, pieces of it in a bin), ...), bins filled so


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by total length, and by pieces too long to share a bin with what must join them."""
    number = np.zeros(capacity + 2, np.int64)
    number[list(counts)] = list(counts.values())
    size, half = np.arange(capacity + 2), capacity // 2
    upto, length = np.cumsum(number), np.cumsum(number * size)
    k = np.array([0, *(s for s in counts if s <= half)])  # pieces under k are left out of account
    large = upto[capacity - k] - upto[half]
    room = capacity * large - (length[capacity - k] - length[half])
    small = length[half] - length[np.maximum(k - 1, 0)]
    needed = (upto[-1] - upto[capacity - k]) + large + np.maximum(0, -(-(small - room) // capacity))
    return int(max(-(-length[-1] // capacity), needed.max()))


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing over counts: equal bins are kept as one entry with their number."""
    open_bins: dict[int, list[list]] = {}  # by room left: [contents, number]
    rooms: list[int] = []

    def put(room: int, contents: tuple, number: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([contents, number])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                fits = capacity // size
                full, rest = divmod(left, fits)
                if full:
                    put(capacity - fits * size, ((size, fits),), full)
                if rest:
                    put(capacity - rest * size, ((size, rest),), 1)
                break
            room = rooms[k]
            contents, number = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[k]
            fits = room // size
            full = min(number, left // fits)
            if full:
                put(room - fits * size, contents + ((size, fits),), full)
                left -= full * fits
                number -= full
            if number and left and left < fits:
                put(room - left * size, contents + ((size, left),), 1)
                left, number = 0, number - 1
            if number:
                put(room, contents, number)
    return [(tuple(contents), number) for entries in open_bins.values() for contents, number in entries]


def fillings(largest: int, counts: dict[int, int], capacity: int, waste: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated ways to complete a bin that holds ``largest``, fullest first, that leave at most ``waste`` empty.

    A filling is dominated if another takes, for each of its pieces, one at least as long, or if a single piece of the
    length of two of its pieces could stand in for them: the smaller pieces then stay free for later bins.
    """
    room = capacity - largest
    have = dict(counts)
    have[largest] -= 1
    sizes = sorted((s for s, n in have.items() if n and s <= room), reverse=True)
    if not sizes:
        return [()] if room <= waste else []
    found: set[tuple[int, ...]] = set()

    def longest(limit: int) -> int | None:
        at = bisect_left(ascending, limit + 1) - 1
        return ascending[at] if at >= 0 else None

    ascending = sizes[::-1]
    budget = 4000

    def extend(taken: tuple[int, ...], left: int) -> None:
        nonlocal budget
        budget -= 1
        top = min(taken[-1], left) if taken else left
        at = bisect_left(ascending, top + 1) - 1
        while at >= 0 and ascending[at] - (1 if taken else 0) >= 0 and taken.count(ascending[at]) >= have[ascending[at]]:
            at -= 1
        if at < 0 or budget <= 0:
            if left <= waste:
                found.add(taken)
            return
        tried = 0
        while at >= 0 and tried < 6:
            size = ascending[at]
            at -= 1
            if taken.count(size) >= have[size]:
                continue
            tried += 1
            extend(taken + (size,), left - size)
            # a shorter piece here is worth a look only if it lets another fill the bin better
            if left - size == 0:
                break

    extend((), room)
    kept: list[tuple[int, ...]] = []
    for filling in sorted(found, key=lambda f: (-sum(f), len(f), [-x for x in f])):
        if not any(dominates(other, filling) for other in kept):
            kept.append(filling)
            if len(kept) == most:
                break
    return kept


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` can be dealt out to those of ``a`` without any overflowing (first fit, longest first)."""
    room = sorted(a, reverse=True)
    for piece in sorted(b, reverse=True):
        for k, left in enumerate(room):
            if piece <= left:
                room[k] -= piece
                break
        else:
            return False
    return True


def _filled(path: tuple | None) -> Packing:
    """The fillings along a path of the search, first one first."""
    out = []
    while path:
        path, filling = path
        out.append(filling)
    return out[::-1]


def _without(counts: dict[int, int], packing: Packing) -> dict[int, int]:
    """The pieces that a packing leaves."""
    left = dict(counts)
    for contents, number in packing:
        for size, k in contents:
            left[size] -= k * number
    return {s: n for s, n in left.items() if n}


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Packing:
    """A packing into as few bins as the search finds; the fewest there can be if it ends within ``nodes``.

    Depth first over fillings around the longest piece left, each used for as many bins as the counts allow. The best-fit
    packing is the first incumbent; the rest of each node is also packed best-fit, which gives new incumbents. A branch
    is cut when the room it may still waste is less than its fillings waste, so nothing is searched at all where best fit
    already reaches the lower bound.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("lengths must lie between 1 and the capacity")
    best = best_fit(counts, capacity)
    fewest, bound, opened = sum(n for _, n in best), lower_bound(counts, capacity), 0
    # a branch waits as its last filling and the branch that it goes on from: what is left is counted when its turn comes, as
    # thousands of branches wait and each would hold a table of all lengths
    stack: list[tuple[tuple | None, int]] = [(None, 0)]
    while stack and fewest > bound and opened < nodes:
        path, used = stack.pop()
        opened += 1
        done = _filled(path)
        left = _without(counts, done)
        if not left:
            if used < fewest:
                best, fewest = done, used
            continue
        if used + lower_bound(left, capacity) >= fewest:
            continue
        rest = best_fit(left, capacity)
        if used + sum(n for _, n in rest) < fewest:
            best, fewest = done + rest, used + sum(n for _, n in rest)
        total = sum(s * n for s, n in left.items())
        waste = (fewest - 1 - used) * capacity - total
        largest = max(left)
        branches = []
        for filling in fillings(largest, left, capacity, waste):
            pieces = {largest: 1}
            for size in filling:
                pieces[size] = pieces.get(size, 0) + 1
            times, contents = min(left[s] // k for s, k in pieces.items()), tuple(pieces.items())
            for number in dict.fromkeys((times, 1)):
                branches.append(((path, (contents, number)), used + number))
        stack.extend(reversed(branches))
    return best


def token_pieces(docs: DataFrame, *, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``: every whole text in pieces."""
    def cut(batches):
        with kept_encoder(vocabulary) as own:
            for batch in batches:
                for at, texts in slices(batch.column(1)):
                    ids, counts = own.encode(texts)
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    sizes = counts + 1
                    number = -(-sizes // capacity)
                    doc = np.repeat(np.arange(len(sizes)), number)
                    piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                    first = sizes - (number - 1) * capacity
                    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                    length = np.where(piece == 0, first[doc], capacity)
                    ends = np.cumsum(length)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), length.tolist())]
                    columns = {"doc_id": batch.column(0).slice(at, len(texts)).take(pa.array(doc)).cast(pa.int64()),
                               "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                               "ids_crc32": pa.array(sums, pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def places(packing: Packing) -> tuple[np.ndarray, ...]:
    """For runs of ranks of each length: length and first rank as one key, first bin, pieces in a bin, place in the bin."""
    rows, ranks, base = [], {}, 0
    for contents, number in packing:
        offset = 0
        for size, k in contents:
            rows.append((size << 48 | ranks.get(size, 0), ranks.get(size, 0), base, k, offset, size))
            ranks[size] = ranks.get(size, 0) + k * number
            offset += size * k
        base += number
    return tuple(np.array(column, np.int64) for column in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 6


def assign(pieces: DataFrame, *, capacity: int = CAPACITY, order: list[str], length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` must be cheap to read again (a written table).

    Pieces of one length are ranked in ``BUCKETS`` parts, so a length that a third of all pieces have is no single task.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    runs = places(bin_completion(histogram, capacity))
    bucket = F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int")
    dealt = pieces.withColumn("_bucket", bucket)
    before = dealt.groupBy(length_col, "_bucket").count().select(
        length_col, "_bucket", (F.sum("count").over(Window.partitionBy(length_col).orderBy("_bucket")) - F.col("count")).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_bucket").orderBy(*order)) - 1)
    # at most capacity x BUCKETS rows of three numbers: 1.6 MB
    ranked = ranked.join(F.broadcast(before), [length_col, "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = pieces.columns
    at, out = names.index(length_col), pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        key, first, base, in_bin, offset, size = runs
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            run = np.searchsorted(key, length << 48 | rank, side="right") - 1
            turn = rank - first[run]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), pa.array(base[run] + turn // in_bin[run]),
                 pa.array(offset[run] + turn % in_bin[run] * size[run])], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, F.col("_rank").cast("long")).mapInArrow(place, out)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from placed pieces with ``ids``: at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"),
        F.transform("_p", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("pieces"))


def packed(docs: DataFrame, *, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces with their places in the packed sequences."""
    pieces = stored(token_pieces(docs, vocabulary=vocabulary, capacity=capacity, with_ids=with_ids), "pieces")
    return assign(pieces, capacity=capacity, order=["doc_id", "piece", "ids_crc32"])
