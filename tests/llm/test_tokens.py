"""Encoding, Simple-8b files and packing against the tokenizer and brute force."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pulseloom.llm import packing, simple8b, tokens
from pulseloom.llm.common import run_folder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " "), (4, "a  b\n\n c "), (5, "same text"), (6, "same text"), (9, "é😀 <|endoftext|> 'll it's"), (7, "word " * 3000 + "end")]


def frame(spark, rows):
    clashing = "doc_id long, text string, start long, length long, sequence_id string, ids string, file string"
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z") for i, t in rows], clashing)


@pytest.fixture(scope="module")
def plain():
    return tokens.Encoder(VOCABULARY).tokenizer


def test_chunks_give_the_ids_of_whole_texts(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS_STAY", 50)
    monkeypatch.setattr(tokens, "CHUNKS_MOST", 200)
    random.seed(1)
    texts = ["".join(random.choice("ab 1.'\n\t é́—s😀 \x1c\x85") for _ in range(random.randint(0, 20))) for _ in range(1500)] + [t for _, t in ODD]
    own = tokens.Encoder(VOCABULARY)
    for part in range(0, len(texts), 300):  # the memory is emptied on the way
        ids, counts = own.encode(pa.array(texts[part:part + 300], pa.string()))
        at = 0
        for text, count in zip(texts[part:part + 300], counts):
            assert ids[at:at + count].tolist() == (plain.encode(text, add_special_tokens=False).ids if text else [])
            at += count


def test_words_are_learnt_once_for_all_tasks_of_a_process(plain, monkeypatch):
    """The next task knows the words of the one before; an encoder that broke off is not used again."""
    monkeypatch.setattr(tokens, "_KEPT", {})
    text = "some words é to remember"
    ids = plain.encode(text, add_special_tokens=False).ids
    with tokens.kept_encoder(VOCABULARY) as first:
        assert first.encode(pa.array([text]))[0].tolist() == ids
    with tokens.kept_encoder(VOCABULARY) as second:
        assert second is first and "remember" in second.numbers
        assert second.encode(pa.array([text]))[0].tolist() == ids
    with pytest.raises(ValueError):
        with tokens.kept_encoder(VOCABULARY) as broken:
            raise ValueError
    with tokens.kept_encoder(VOCABULARY) as fresh:
        assert broken is first and fresh is not first and not fresh.numbers


def test_slices_cover_all():
    texts = pa.array(["x" * 10, None, "y" * 50, "", "z"])
    got = [(at, len(part)) for at, part in tokens.slices(texts, 12)]
    assert sum(n for _, n in got) == 5 and [at for at, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2 ** 63 - 1)), max_size=300), st.integers(1, 30))
def test_words_round_trip(values, times):
    ids = np.array(values * times, np.uint64)
    assert (simple8b.unpack_blocks(*simple8b.pack_blocks(ids)) == ids).all()


def test_damaged_files_are_refused():
    data = b"".join(simple8b.file_chunks(np.array([1]), np.array([3]), np.array([5, 6, 7], np.uint64)))
    doc, sizes, ids = simple8b.parse_file(data)
    assert (doc.tolist(), sizes.tolist(), ids.tolist()) == ([1], [3], [5, 6, 7])
    with pytest.raises(ValueError):
        simple8b.parse_file(b"something else, and long enough to have a head of counts" * 3)


def test_files_hold_all_documents_in_order(spark, plain):
    folder = run_folder(spark, "test")
    manifest = simple8b.write_ids(frame(spark, ODD), folder, vocabulary=VOCABULARY, ids_per_file=5)
    assert manifest.count() > 2
    rows = {r.doc_id: r for r in simple8b.read_ids(manifest, folder, simple8b.decoded, simple8b.DECODED).collect()}
    at = 0
    for i, text in sorted(ODD):
        ids = (plain.encode(text, add_special_tokens=False).ids if text else []) + [0]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids) == (at, len(ids), ids)
        at += len(ids)


def test_writers_keep_the_words_between_tasks(spark, monkeypatch):
    """The task that writes token files takes the encoder of the process and puts it back."""
    taken = []

    class Docs:  # runs the task here, as a worker would
        sparkSession = spark

        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, write, schema):
            for text in ("some words to remember", "words to remember"):
                batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text])})
                assert [b.column("n_docs").to_pylist() for b in write(iter([batch]))] == [[1]]
                taken.append(dict(tokens._KEPT))

    monkeypatch.setattr(tokens, "_KEPT", {})
    monkeypatch.setattr(simple8b, "stored", lambda df, name: df)
    monkeypatch.setattr(simple8b, "attempt_name", lambda: (0, "test"))
    simple8b.write_ids(Docs(), run_folder(spark, "test"), vocabulary=VOCABULARY)
    assert taken[0][VOCABULARY] is taken[1][VOCABULARY] and "remember" in taken[0][VOCABULARY].numbers


def test_digests_of_repeated_ids_and_of_nothing(spark):
    rows = simple8b.token_digests(frame(spark, [(1, "b"), (1, "a"), (1, "a"), (None, "lost")]), VOCABULARY).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in rows) == [(1, 0, 2), (1, 2, 2), (1, 4, 2)]
    assert simple8b.token_digests(frame(spark, []), VOCABULARY).count() == 0


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in {room: n for n, room in enumerate(bins)}.values():
            if bins[b] + items[k] <= capacity:
                bins[b] += items[k]
                go(k + 1, bins)
                bins[b] -= items[k]
        go(k + 1, bins + [items[k]])
    go(0, [])
    return best[0]


def used(counts, capacity, result):
    got = {}
    for contents, number in result:
        assert sum(s * k for s, k in contents) <= capacity
        for s, k in contents:
            got[s] = got.get(s, 0) + k * number
    assert got == {s: n for s, n in counts.items() if n}
    return sum(n for _, n in result)


def test_bin_completion_finds_the_fewest_bins():
    random.seed(2)
    plainly, searched = 0, 0
    for _ in range(150):
        capacity = random.choice([20, 30, 50])
        items = [random.randint(3, capacity * 2 // 3) for _ in range(random.randint(1, 11))]
        counts = {s: items.count(s) for s in items}
        best = fewest(items, capacity)
        assert packing.lower_bound(counts, capacity) <= best
        plainly += used(counts, capacity, packing.best_fit(counts, capacity)) - best
        searched += used(counts, capacity, packing.bin_completion(counts, capacity)) - best
    assert searched == 0 < plainly
    assert packing.bin_completion({}) == []
    with pytest.raises(ValueError):
        packing.bin_completion({1025: 1})


def test_branches_that_wait_hold_no_counts():
    rng = np.random.default_rng(5)
    counts = {s: int(n) for s, n in zip(range(1, 1025), rng.integers(1, 200, 1024))}
    tracemalloc.start()
    found = packing.bin_completion(counts, 1024, 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used(counts, 1024, found) <= sum(n for _, n in packing.best_fit(counts, 1024))
    assert peak < 6_000_000  # 13 MB with a table of counts for each branch, and more with each node


def test_dominated_fillings_are_left_out():
    assert packing.dominates((7,), (4, 3)) and not packing.dominates((4, 3), (7,))
    assert packing.fillings(10, {10: 1, 7: 1, 4: 1, 3: 1}, 17, waste=2)[0] == (7,)


def test_pieces_fill_sequences_without_gaps(spark, plain):
    docs = frame(spark, ODD + [(8, "hot " * 40)] * 50)
    pieces = packing.token_pieces(docs, vocabulary=VOCABULARY, capacity=64).cache()
    placed = packing.assign(pieces, capacity=64, order=["doc_id", "piece", "ids_crc32"]).cache()
    rows, total = placed.collect(), 0
    for i, text in ODD:
        ids = (plain.encode(text, add_special_tokens=False).ids if text else []) + [2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum((r.ids for r in own), []) == ids and all(r.length == 64 for r in own[1:]) and own[0].start == 0
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    by_sequence = {}
    for r in rows:
        total += r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    whole = packing.sequences(placed).collect()
    assert len(whole) == len(by_sequence) and sum(len(s.ids) for s in whole) == total
    lengths = [r.length for r in rows]
    assert len(by_sequence) == packing.lower_bound({n: lengths.count(n) for n in lengths}, 64)
    assert packing.packed(frame(spark, []), vocabulary=VOCABULARY).count() == 0
