"""Token ids in files of Simple-8b words: a selector and as many ids as fit, 64 bits each.

File: the magic, then eight counts, then (little-endian, in this order) the block table, the words, the escapes and the
document table. A block holds ``BLOCK`` ids (the last one of a file fewer); its row in the block table says where its
words and its escapes begin, so that any block can be decoded alone, and all of them at once with array operations.
The low four bits of a word are its selector: how many ids follow and how many bits each has. Selector 0 is an escape:
the rest of the word is the number of an entry in the escape table, which holds ids of more than 60 bits whole.

Documents lie in ascending ``doc_id`` order over all files of a folder; those of equal id by text. Null and empty texts
hold the end id alone. Rows with a null id have no place in that order: they are left out. A lost task writes its files anew under the same names and with the same bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pulseloom.llm.common import attempt_name, read_file, run_folder, stored, write_file
from pulseloom.llm.tokens import kept_encoder, slices

MAGIC = b"S8BTOK01"
BLOCK = 4096
RUN = 256 * BLOCK  # ids that are packed or unpacked at once
IDS_PER_FILE = 16_000_000
# fixed values: ids in a word and bits of each, by selector; 0 is the escape, 1 is not used
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_LIMITS = np.uint64(1) << np.arange(1, 61, dtype=np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8) + 1  # bits of ids under 65,536
MANIFEST = "file string, shard long, roll long, n_docs long, n_ids long, n_bytes long"
DECODED = "doc_id long, start long, n_tokens long, ids array<long>"


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and the first word and first escape of each block, for non-negative ids."""
    n = len(ids)
    rows = max(1, -(-n // BLOCK))
    wide = np.zeros((rows, BLOCK + 60), np.uint64)
    flat = np.zeros(rows * BLOCK, np.uint64)
    flat[:n] = ids
    wide[:, :BLOCK] = flat.reshape(rows, BLOCK)
    bits = np.full((rows, BLOCK + 60), 255, np.uint8)
    need = _SMALL[flat] if flat.max() < len(_SMALL) else np.searchsorted(_LIMITS, flat, side="right").astype(np.uint8) + 1
    need[n:] = 255
    bits[:, :BLOCK] = need.reshape(rows, BLOCK)
    # the widest of the next c ids, from the widest of the next power of two
    most, power = {1: bits[:, :BLOCK]}, {1: bits}
    for p in (2, 4, 8, 16, 32):
        low = power[p // 2]
        power[p] = np.maximum(low[:, :-(p // 2)], low[:, p // 2:])
    choice = np.zeros((rows, BLOCK), np.uint8)
    for s in range(15, 1, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        widest = np.maximum(power[p][:, :BLOCK], power[p][:, c - p:c - p + BLOCK]) if c > 1 else most[1]
        choice[widest <= BITS[s]] = s
    step = COUNTS[choice].astype(np.int64)
    left = np.minimum(BLOCK, np.maximum(0, n - np.arange(rows) * BLOCK))
    at, visited, alive = np.zeros(rows, np.int64), [], np.flatnonzero(left > 0)
    while len(alive):  # all blocks go on by a word at a time
        visited.append(alive * BLOCK + at[alive])
        at[alive] += step[alive, at[alive]]
        alive = alive[at[alive] < left[alive]]
    places = np.sort(np.concatenate(visited)) if visited else np.zeros(0, np.int64)
    block, inside = places // BLOCK, places % BLOCK
    selector = choice[block, inside]
    words = selector.astype(np.uint64)
    row = wide.reshape(-1)
    for s in range(2, 16):
        here = np.flatnonzero(selector == s)
        if len(here):
            at, own = block[here] * wide.shape[1] + inside[here], words[here]
            for k in range(int(COUNTS[s])):
                own |= row[at + k] << np.uint64(4 + int(BITS[s]) * k)
            words[here] = own
    escaped = np.flatnonzero(selector == 0)
    escapes = wide[block[escaped], inside[escaped]]
    first_word = np.searchsorted(block, np.arange(rows))
    first_escape = np.searchsorted(block[escaped], np.arange(rows))
    words[escaped] |= (np.arange(len(escaped)) - first_escape[block[escaped]]).astype(np.uint64) << np.uint64(4)
    return words, escapes, first_word, first_escape


def unpack_blocks(words: np.ndarray, escapes: np.ndarray, first_word: np.ndarray, first_escape: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; the reverse of ``pack_blocks``."""
    selector = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    starts = ends - counts
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in range(2, 16):
        here = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s]) if len(here) else 0):
            ids[starts[here] + k] = words[here] >> np.uint64(4 + int(BITS[s]) * k) & mask
    escaped = np.flatnonzero(selector == 0)
    if len(escaped):
        block = np.searchsorted(first_word, escaped, side="right") - 1
        ids[starts[escaped]] = escapes[first_escape[block] + (words[escaped] >> np.uint64(4)).astype(np.int64)]
    return ids


class Packer:
    """The contents of one file: ids are packed as soon as they fill a block, only words and escapes are kept."""

    def __init__(self):
        self.rest = np.zeros(0, np.uint64)  # less than a block
        self.ids = self.words = self.escapes = 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.doc_ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.sizes.append(sizes)
        self.ids += len(ids)
        held = np.concatenate([self.rest, ids.astype(np.uint64)]) if len(self.rest) else ids
        full = len(held) // BLOCK * BLOCK
        for at in range(0, full, RUN):
            self._pack(held[at:min(at + RUN, full)])
        self.rest = held[full:].astype(np.uint64)

    def _pack(self, ids: np.ndarray) -> None:
        words, escapes, first_word, first_escape = pack_blocks(ids)
        self.parts.append((words, escapes, first_word + self.words, first_escape + self.escapes))
        self.words += len(words)
        self.escapes += len(escapes)

    def chunks(self) -> list[bytes]:
        if len(self.rest) or not self.parts:
            self._pack(self.rest)
        words, escapes, first_word, first_escape = ([p[k] for p in self.parts] for k in range(4))
        docs, blocks = sum(map(len, self.doc_ids)), sum(map(len, first_word))
        head = np.array([BLOCK, docs, self.ids, blocks, self.words, self.escapes, 0, 0], "<u8")
        out = [MAGIC, head.tobytes()]
        for arrays, kind in ((first_word, "<u8"), (first_escape, "<u8"), (words, "<u8"), (escapes, "<u8"), (self.doc_ids, "<i8"), (self.sizes, "<u8")):
            out += [array.astype(kind).tobytes() for array in arrays]
        return out


def file_chunks(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
    packer = Packer()
    packer.add(doc_ids, sizes, ids)
    return packer.chunks()


def file_parts(data: bytes, most: int = RUN):
    """Document ids, ids per document, and their ids, for the documents of a file in parts of about ``most`` ids.

    Only the blocks that a part touches are decoded for it.
    """
    if data[:8] != MAGIC:
        raise ValueError("not a file of packed token ids")
    block_ids, docs, total, blocks, words, escapes, _, _ = (int(x) for x in np.frombuffer(data, "<u8", 8, 8))
    at, tables = 72, []
    for kind, count in (("<u8", blocks), ("<u8", blocks), ("<u8", words), ("<u8", escapes), ("<i8", docs), ("<u8", docs)):
        tables.append(np.frombuffer(data, kind, count, at))
        at += 8 * count
    first_word, first_escape, word, escape, doc_ids, sizes = tables
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    if (int(ends[-1]) if docs else 0) != total or blocks != max(1, -(-total // block_ids)):
        raise ValueError("a file of packed token ids is damaged")
    word_ends, escape_ends = np.append(first_word[1:], words).astype(np.int64), np.append(first_escape[1:], escapes).astype(np.int64)
    done = 0
    while done < docs:
        start = int(ends[done - 1]) if done else 0
        to = max(done + 1, int(np.searchsorted(ends, start + most, side="right")))
        end = int(ends[to - 1])
        a, b = start // block_ids, max(start // block_ids + 1, -(-end // block_ids))
        w, x = int(first_word[a]) if a < blocks else words, int(first_escape[a]) if a < blocks else escapes
        ids = unpack_blocks(word[w:word_ends[b - 1]], escape[x:escape_ends[b - 1]], first_word[a:b].astype(np.int64) - w,
                            first_escape[a:b].astype(np.int64) - x) if end > start else np.zeros(0, np.uint64)
        if len(ids) < end - a * block_ids:
            raise ValueError("a file of packed token ids is damaged")
        yield doc_ids[done:to], sizes[done:to], ids[start - a * block_ids:end - a * block_ids]
        done = to


def parse_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a file."""
    parts = list(file_parts(data))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return tuple(np.concatenate([p[k] for p in parts]) if parts else empty[k] for k in range(3))


def write_ids(docs: DataFrame, folder: str, *, vocabulary: str, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text", ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes the files; returns the manifest, a row for each file."""
    def write(batches):
        shard, attempt = attempt_name()
        roll, packer = 0, Packer()

        def close():
            name = f"part-{shard:06d}-{roll:04d}.s8b"
            chunks = packer.chunks()
            write_file(folder, name, chunks, attempt)
            return pa.RecordBatch.from_pydict({"file": [name], "shard": [shard], "roll": [roll], "n_docs": [sum(map(len, packer.doc_ids))],
                                               "n_ids": [packer.ids], "n_bytes": [sum(map(len, chunks))]})
        with kept_encoder(vocabulary) as own:
            for batch in batches:
                for at, texts in slices(batch.column(1), min(4_000_000, ids_per_file)):
                    ids, counts = own.encode(texts)
                    packer.add(batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64), counts + 1,
                               np.insert(ids, np.cumsum(counts), end_id))
                    if packer.ids >= ids_per_file:
                        yield close()
                        roll, packer = roll + 1, Packer()
        if packer.ids:
            yield close()

    ordered = (docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
               .repartitionByRange(id_col).sortWithinPartitions(id_col, text_col))
    return stored(ordered.mapInArrow(write, MANIFEST), "s8b-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: the ids in all files before. One row per file, of millions of ids each."""
    return manifest.withColumn("base", F.sum("n_ids").over(
        Window.partitionBy(F.lit(0)).orderBy("shard", "roll")) - F.col("n_ids"))


def read_ids(manifest: DataFrame, folder: str, row, schema: str) -> DataFrame:
    """Reads the files back. ``row(doc_ids, starts, sizes, ids)`` makes a record batch of some documents of a file."""
    def read(batches):
        for batch in batches:
            for file in batch.to_pylist():
                base = file["base"]
                for doc_ids, sizes, ids in file_parts(read_file(folder, file["file"])):
                    yield row(doc_ids, base + np.cumsum(sizes) - sizes, sizes, ids)
                    base += int(sizes.sum())

    files = max(1, manifest.count())
    return with_bases(manifest).select("file", "base").repartition(files).mapInArrow(read, schema)


def decoded(doc_ids, starts, sizes, ids) -> pa.RecordBatch:
    """Each document with its ids."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids.astype(np.int64)), pa.array(starts), pa.array(sizes), lists],
                                      names=["doc_id", "start", "n_tokens", "ids"])


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digests(doc_ids, starts, sizes, ids) -> pa.RecordBatch:
    """Each document with the crc32 of its ids as little-endian unsigned 32-bit integers."""
    from zlib import crc32
    raw, ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(sizes)
    sums = [crc32(raw[e - 4 * s:e]) for e, s in zip(ends.tolist(), sizes.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids.astype(np.int64)), pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    folder = run_folder(docs.sparkSession, "s8b")
    return read_ids(write_ids(docs, folder, vocabulary=vocabulary), folder, digests, DIGESTS)
