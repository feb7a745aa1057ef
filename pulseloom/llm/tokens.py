"""Encoding of whole texts by a public byte-level BPE, in batches inside tasks.

A boundary of the tokenizer's first split always lies before a single blank between two characters that are no white
space, whatever stands further away. Texts are cut there, and each chunk (a word with its blank) is encoded once per
task by the tokenizers library and remembered; the ids of a text are those of its chunks in a row. A text with any
other white space next to a blank is encoded whole. The memory is emptied when it is full, which changes no result.
"""

from __future__ import annotations

import os
import unicodedata
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# what a task remembers: the chunks it met first stay, later ones are dropped from time to time
CHUNKS_STAY, CHUNKS_MOST = 400_000, 700_000
CHARS_MOST = 20_000_000


class _Numbers(dict):
    """Chunks by number; a new chunk takes the next one."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


def _joins(c: str) -> bool:
    """Whether a blank next to ``c`` may belong to a longer run of white space, or ``c`` is of a doubtful kind."""
    return not c.isalnum() and not "!" <= c <= "~" and (c.isspace() or unicodedata.category(c)[0] in "CZ")


class Encoder:
    """``encode(texts)`` gives all ids in a row and the number of ids of each text; null and empty texts have none.

    Make one in each task: it is not sent from the driver, and its memory ends with the task.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # each word comes once: what it would remember is never asked for
        size = self.tokenizer.get_vocab_size()
        self.blank = np.fromiter(((self.tokenizer.id_to_token(i) or "?")[0] == "\u0120" for i in range(size)), bool, size)
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.chars, self.used = _Numbers(), 0, 0
        self.first = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.odd = np.zeros(1024, bool)
        self.ids = np.zeros(4096, np.uint32)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        grown = np.zeros(max(size, 2 * len(array)), array.dtype)
        grown[:len(array)] = array
        return grown

    def _learn(self) -> None:
        new = self.numbers.new
        if not new:
            return
        self.numbers.new = []
        # a chunk that begins a text is kept with a blank before it, which no other chunk has
        bare = [c[1:] if c[:1] == " " else c for c in new]
        odd = np.array([not w or not ("!" <= w[0] <= "~" and "!" <= w[-1] <= "~") and (_joins(w[0]) or _joins(w[-1])) for w in bare])
        alone = np.fromiter((c[:1] == " " for c in new), bool, len(new))
        lengths = np.zeros(len(new), np.int64)
        found: dict[int, list[int]] = {int(k): self.tokenizer.encode(new[k][1:], add_special_tokens=False).ids
                                       for k in np.flatnonzero(alone & ~odd)}
        rest = np.flatnonzero(~alone & ~odd)
        # all others in rows of a few dozen: an id that begins with a blank begins a chunk
        lines = [" " + " ".join([new[k] for k in rest[i:i + 50]]) for i in range(0, len(rest), 50)]
        done = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.array([i for e in done for i in e.ids], np.uint32)
        begins = np.flatnonzero(self.blank[ids])
        lengths[rest] = np.diff(begins, append=len(ids))
        for k, own in found.items():
            lengths[k] = len(own)
        at, total = len(self.numbers) - len(new), int(lengths.sum())
        self.first, self.length, self.odd = (self._room(a, len(self.numbers)) for a in (self.first, self.length, self.odd))
        self.ids = self._room(self.ids, self.used + total)
        self.first[at + rest] = self.used + np.cumsum(lengths[rest]) - lengths[rest]
        self.ids[self.used:self.used + len(ids)] = ids
        end = self.used + len(ids)
        for k, own in found.items():
            self.first[at + k] = end
            self.ids[end:end + len(own)] = own
            end += len(own)
        self.length[at:at + len(new)] = lengths
        self.odd[at:at + len(new)] = odd
        self.used += total
        self.chars += sum(map(len, new))

    def _make_room(self) -> None:
        if self.chars > CHARS_MOST:
            self._empty()
        elif len(self.numbers) > CHUNKS_MOST:
            for chunk in list(islice(self.numbers, CHUNKS_STAY, None)):
                del self.numbers[chunk]
                self.chars -= len(chunk)
            self.used = int(self.first[:CHUNKS_STAY].max() + self.length[:CHUNKS_STAY].max())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self._make_room()
        counts = np.zeros(len(texts), np.int64)
        given = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        if not len(given):
            return np.zeros(0, np.uint32), counts
        texts = texts.take(pa.array(given))
        words = pc.split_pattern(texts, " ")
        starts = words.offsets.to_numpy().astype(np.int64)
        starts = starts[:-1] - starts[0]
        coded = words.flatten().dictionary_encode()
        look = self.numbers.__getitem__
        known = np.fromiter(map(look, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        chunks = known[coded.indices.to_numpy()]
        heads = coded.dictionary.take(pa.array(coded.indices.to_numpy()[starts])).to_pylist()
        chunks[starts] = [look(" " + word) for word in heads]
        self._learn()
        lengths = self.length[chunks]
        ids = self.ids[spread(self.first[chunks], lengths)]
        own = np.add.reduceat(lengths, starts)
        odd = np.logical_or.reduceat(self.odd[chunks], starts)
        if odd.any():
            pieces = np.split(ids, np.cumsum(own)[:-1])
            for k in np.flatnonzero(odd):
                whole = self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids
                pieces[k] = np.array(whole, np.uint32)
                own[k] = len(whole)
            ids = np.concatenate(pieces)
        counts[given] = own
        return ids, counts


_KEPT: dict[str, Encoder] = {}  # of this worker process, between its tasks


@contextmanager
def kept_encoder(path: str):
    """An encoder that still knows the words of the tasks this process ran before; its memory ends with the process.

    It is taken out for a task and put back when that ends well, so none is used that broke off halfway.
    """
    own = _KEPT.pop(path, None) or Encoder(path)
    yield own
    _KEPT[path] = own


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``first[k], first[k] + 1, ...`` (``lengths[k]`` of them) for all k in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def slices(texts: pa.Array, size: int = 4_000_000):
    """Parts of ``texts`` of about ``size`` bytes, with the number of texts before: arrays stay small whatever a batch holds."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size)))
        yield at, texts.slice(at, to - at)
        at = to
