"""Near duplicates, contamination, fingerprints and quality against brute force."""

import collections
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pulseloom.llm import decontaminate, fingerprints, neardup, quality
from pulseloom.llm.common import next_smaller

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, node string, keys string, score double, words string, item_id string, term long, length string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", "k", 0.5, "w", "i", 1, "l") for i, t in rows], CLASHING)


def prose(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        k = rng.randrange(len(words))
        words[k] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(words)


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(4)
    rows, i = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three")], 10
    for _ in range(25):
        base = prose(rng, rng.choice([8, 40, 200, 600]))
        for _ in range(rng.choice([1, 2, 4])):
            rows.append((i, rng.choice([base, base.upper(), edited(rng, base, rng.choice([1, 3, 8]))])))
            i += 1
    common = prose(rng, 60)  # a passage that many documents share
    rows += [(i + k, prose(rng, 80) + " " + common) for k in range(30)]
    base = prose(rng, 300)
    rows += [(1000 + k, edited(rng, base, 2)) for k in range(40)]  # one group of many near copies
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_components_are_those_of_all_pairs(spark, copies, percent):
    sets, want = components(copies, percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, copies), percent=percent).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("percent, own", [(80, 12), (85, 9)])
def test_pairs_in_a_family_just_under_the_threshold_are_found(spark, percent, own):
    # all share 88 or 91 of 100 shingles (0.786 or 0.835); documents 2k and 2k + 1 of the first 160 share two more (0.818 or 0.869)
    rng = random.Random(11)
    common = prose(rng, 104 - own)
    word = lambda: f"w{rng.randrange(10 ** 12)}"
    rows = []
    for k in range(1600):
        two = rows[-1][1].split()[104 - own:106 - own] if k < 160 and k % 2 else [word(), word()]
        rows.append((k, " ".join([common, *two, *[word() for _ in range(own - 2)]])))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), percent=percent).collect()}
    assert got == {k: k - k % 2 if k < 160 else k for k in range(1600)}


def test_repeated_and_missing_ids_have_rows_of_their_own(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (7, "other words are here now"), (None, "a b c d e f"), (9, "a b c d e f")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 5 and [r.component_id for r in got if r.doc_id == 9] == [7]
    assert all(r.kept for r in got if r.doc_id != 9) and not any(r.kept for r in got if r.doc_id == 9)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_a_pair_meets_at_few_of_its_shared_shingles(spark):
    rng = random.Random(21)
    base = prose(rng, 400)
    rows = [(i, edited(rng, base, 4)) for i in range(1, 61)] + [(i, edited(rng, base, 1)) for i in range(101, 105)]
    signed = neardup.signatures(frame(spark, rows), id_col="doc_id", text_col="text", percent=85).cache()
    nodes = signed.drop("keys")
    alone = nodes.select("node", F.col("node").alias("component"))
    met = neardup.meetings(nodes, alone, 85).cache()
    pairs = met.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().count()
    assert pairs > 1000 and met.count() < 1.2 * pairs  # at each shared shingle of both prefixes before
    ids = {r.node: r.doc_id for r in nodes.collect()}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in neardup.prefix_candidates(nodes, alone, 85).collect()}
    sets = {i: shingles(t) for i, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert alike and alike <= found


def test_spent_tables_are_removed_and_few_texts_travel(spark, copies, monkeypatch):
    written, moved, stored, likely = [], [], neardup.stored, neardup.likely

    def kept(df, name):
        table = stored(df, name)
        written.append((name, table.inputFiles()))
        return table

    def counted(source, wanted):
        rows = likely(source, wanted)
        asked = {r.text_key for r in wanted.collect()}
        keys = [r.text_key for r in rows.select("text_key").collect()]
        assert asked == asked & set(keys)
        moved.append((len(keys), source.filter(F.col("text_key").isin(list(asked))).count()))
        return rows

    monkeypatch.setattr(neardup, "stored", kept)
    monkeypatch.setattr(neardup, "likely", counted)
    rows = neardup.near_duplicates(frame(spark, copies), percent=85).collect()
    there = collections.Counter(name for name, files in written if any(os.path.exists(re.sub("^file:/+", "/", f)) for f in files))
    assert len(rows) == len(copies) and not set(there) & {"common", "signatures", "nodes", "involved", "texts", "prefixes"}
    assert there["shared_prefixes"] <= 1
    assert moved and all(n <= needed + 1 for n, needed in moved)  # one may come by chance
    assert any(needed < len(copies) for _, needed in moved)


def test_all_asked_texts_are_likely(spark):
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, neardup.LIKELY_BITS, *range(32760, 32780), *[random.Random(2).randrange(-2 ** 63, 2 ** 63) for _ in range(3)]]
    source = spark.createDataFrame([(k,) for k in keys] + [(k + 40_000,) for k in range(32760, 32780)] + [(None,)], "text_key long")
    assert {r.text_key for r in neardup.likely(source, source.filter(F.col("text_key").isin(keys))).collect()} == set(keys)


def weighted(words):
    return collections.Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else collections.Counter([tuple(words)] * bool(words))


def resembling(docs, items, threshold=0.8):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = {}
    for d, text in docs:
        words = split(text)
        for i, item in items:
            own = split(item)
            if not own:
                continue
            b, best = weighted(own), 0
            for s in range(-len(own) + 1, len(words)):
                a = weighted(words[max(0, s):max(0, s + len(own))])
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= threshold:
                want[d, i] = best
    return want


def test_every_window_that_resembles_an_item_is_found(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, n, 300)) for k, n in enumerate([3, 1, 12, 30, 30, 59, 120])] + [(20, None), (21, ""), (22, "same same same same same same same")]
    docs = [(1, None), (2, ""), (3, "short"), (4, "same " * 30)]
    for k in range(60):
        item = (items[rng.randrange(7)][1]).split(" ")
        how = k % 5
        if how == 1:
            item.insert(len(item) // 2, "new")
        elif how == 2 and len(item) > 8:
            del item[len(item) // 3]
        elif how == 3:
            item = [w.upper() + "!!" for w in item]
        elif how == 4:
            item = item[:len(item) * 2 // 3]
        docs.append((10 + k, prose(rng, rng.randrange(60), 300) + " " + ",\n".join(item) + " " + prose(rng, rng.randrange(60), 300)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame(spark, docs), benchmark).collect()}
    want = resembling(docs, items)
    assert len(want) > 30 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contamination_without_ids_or_items(spark):
    rng = random.Random(6)
    text = prose(rng, 20)
    benchmark = spark.createDataFrame([(1, text), (1, text), (2, text)], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, [(None, text), (5, text), (5, text)]), benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (0, 2), (5, 1), (5, 2)]
    assert decontaminate.contaminated(frame(spark, []), benchmark).count() == 0
    assert decontaminate.contaminated(frame(spark, [(5, text)]), benchmark.limit(0)).count() == 0


def test_fingerprints_of_edits_and_neighbours(spark):
    rng = random.Random(7)
    rows = [(2 * k, prose(rng, rng.choice([5, 50, 400]), 900)) for k in range(60)] + [(1, None), (3, ""), (5, "é😀" * 10)]
    rows += [(1001, rows[7][1])]
    got = {r.doc_id: r for r in fingerprints.edited_and_next(frame(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    seen = {}
    for k, (i, text) in enumerate(order):
        following, third = order[(k + 1) % len(order)][1], len(text) // 3
        changed = text[:len(text) - third] + following[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert seen.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if changed == text:
            assert got[i].near_edited == 1
    assert len(set(seen.values())) == len(seen)
    long = [r for r in got.values() if r.n_chars > 1000]
    assert sum(r.near_edited for r in long) > 2 * sum(r.near_next for r in long)


def test_fingerprints_of_one_document_and_of_none(spark):
    only, = fingerprints.edited_and_next(frame(spark, [(4, "one two three four")])).collect()
    assert only.near_next == 1 and only.edited_sha256 == hashlib.sha256(b"one two threone tw").hexdigest()
    assert fingerprints.edited_and_next(frame(spark, [])).count() == 0
    repeated = fingerprints.edited_and_next(frame(spark, [(4, "b c d e"), (4, "a b c d"), (4, "a b c d"), (None, "x")])).collect()
    assert [r.n_chars for r in repeated] == [7, 7]


def test_lexicon_is_the_band(spark):
    rows = [(k, " ".join(["all"] + (["many"] if k % 20 == 0 else []) + (["rare"] if k == 3 else []))) for k in range(1000)]
    known = {r.term for r in fingerprints.lexicon(frame(spark, rows)).collect()}
    hashed = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in ("all", "many", "rare")}
    assert known == {hashed["many"]}


def test_next_smaller_wraps(spark):
    ids = [5, -3, 100, 7, 2 ** 40]
    got = {r.doc_id: r.next_doc_id for r in next_smaller(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, y string"), "doc_id", ["y"]).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(rng, rng.randrange(20, 200))
        rows.append((i, text if good else rng.choice([text.upper() + "!!", text.replace(" ", "$$ "), " | ".join(text.split(" "))])))
        labels.append((i, int(good), None))
    return rows, labels


def test_quality_is_learnt_and_held_out_rows_are_judged(spark):
    rows, labels = labelled(random.Random(8), 800)
    docs, marks = frame(spark, rows + [(9001, None), (9002, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks)
    assert model.rules
    out = quality.scored(docs, model, docs.columns, score_col="own").withColumn("held", quality.held_out())
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 802 and all(0 <= r.own <= 1 and r.score == 0.5 and r.length == "l" for r in got.values())
    held = [(got[i].own >= quality.THRESHOLD) == bool(q) for i, q, _ in labels if got[i].held]
    assert len(held) > 150 and sum(held) / len(held) > 0.97
    # the labels of held-out rows change nothing
    other = quality.train(docs, marks.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert other == model


def test_quality_with_one_class_or_no_labels(spark):
    rows, labels = labelled(random.Random(9), 40)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = quality.train(frame(spark, rows), marks.filter("quality = 1"))
    none = quality.train(frame(spark, rows), marks.limit(0))
    assert not one.rules and not none.rules and none.intercept > 0
    assert quality.scored(frame(spark, []), one, ["doc_id"]).count() == 0
    assert quality.scored(frame(spark, [(None, None)]), one, ["doc_id"]).first().score > 0.7
