"""The mix of sources against a plain version."""

import hashlib
import random
import re

import pytest

from pulseloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, quality double, size string, target string, taken string, copies string, key string, _p string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, w, "a", "b", "c", "d", "e", "f") for i, t, s, w in rows], SCHEMA)


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and most * sizes[s] * share < left * weight[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else float(left) * weight[s] / share for s in names}
        full |= over


def plain(rows, seed="1"):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = plain_targets(sizes) if rows else {}
    out = []
    for source in sizes:
        r = target[source] / sizes[source] if sizes[source] else 0.0
        whole, p = int(r), r - int(r)
        own = []
        for i, t, s, _ in rows:
            if s == source:
                key = f"{seed}:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}"
                u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                own.append(((u / (1 - u)) / (p / (1 - p)) if p else 0.0, key, i, size(t)))
        left, before = target[source] - whole * sizes[source], 0
        for _, _, i, n in sorted(own, key=lambda o: o[:2]):
            more = p > 0 and abs(before + n - left) <= abs(before - left)
            out.append((i, n, sizes[source], target[source], whole * n + (n if more else 0)))
            before += n
    return sorted(out, key=str)


def mixed(spark, rows, parts=3, **how):
    return mixing.mix(frame(spark, rows).repartition(parts), **how)


def listed(df):
    return sorted((tuple(r) for r in df.drop("copies").collect()), key=str)


def rows_of(number, sources, seed=3):
    pick = random.Random(seed)
    return [(i, " ".join(["w"] * int(pick.paretovariate(1.1))), pick.choice(sources), pick.random()) for i in range(number)]


ODD = [(None, "a b", "s1", None), (None, "a b", "s1", 0.0), (5, "a b c", "s2", -1.0), (5, "a b c", "s2", 2.0), (5, "x", "s2", float("nan")),
       (9, None, "s3", 1.0), (10, "", "s3", 1.0), (11, " \t\n\x0b ", None, 1.0), (12, "é ü 日本 x", None, 1.0), (13, "long " * 50_000, "Z", 1.0)]


@pytest.mark.parametrize("rows", [[], ODD, rows_of(400, ["a", "b", "c", "d", "e", None]) + ODD,
                                  rows_of(300, ["hot"] * 30 + ["a", "B", "é"])], ids=["none", "odd", "many", "hot"])
def test_the_mix_equals_the_plain_one(spark, rows):
    got = listed(mixed(spark, rows))
    assert got == plain(rows) and got == listed(mixed(spark, rows, 1))
    for _, size, source_size, target, taken in got:
        assert 0 <= taken <= 3 * size and target <= 3 * source_size


def test_targets_share_all_words(spark):
    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 5}, {"a": 1000, "b": 1}, {"x": 0}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(table, (5, 2, 1), 3).collect()}
        assert got == plain_targets(sizes) and round(sum(got.values()), 6) == sum(sizes.values())


def test_each_source_comes_near_its_target(spark):
    rows = rows_of(2000, ["a", "b", "c", "d"])
    taken, target, largest = {}, {}, {}
    for r in mixed(spark, rows).join(frame(spark, rows).select("doc_id", "source"), "doc_id").collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]], largest[r["source"]] = r["target"], max(largest.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in taken)


def test_weights_make_probabilities_unequal(spark):
    rows = [(i, "w " * 10, "b" if i % 2 else "a", 1.0 + i % 5) for i in range(3000)]
    took, expected = {}, {}
    for r in mixed(spark, rows, 2, weight_col="quality").collect():
        group = r["doc_id"] % 10  # a source and a weight
        took.setdefault(group, []).append(r["taken"] / r["size"])
        expected[group] = r["copies"]
        assert r["taken"] <= 3 * r["size"] and abs(r["taken"] / r["size"] - r["copies"]) < 1
    assert all(len({round(x, 6) for g, x in expected.items() if g % 2 == source}) == 5 for source in (0, 1))
    for source, share in ((0, 5 / 7), (1, 2 / 7)):
        assert abs(sum(expected[g] for g in expected if g % 2 == source) / 10 - share) < 0.001
    for group, own in took.items():  # Pareto order keeps the probabilities asked for
        assert abs(sum(own) / len(own) - expected[group]) < 0.1


def test_odd_weights_take_nothing_or_count_alike(spark):
    got = mixed(spark, ODD, weight_col="quality").collect()
    assert sum(r["taken"] for r in got if r["doc_id"] is None and r["size"] == 2) <= 6 * 2
    assert all(r["taken"] == 0 for r in got if r["doc_id"] == 5 and r["copies"] == 0)
    assert listed(mixed(spark, ODD, 1, weight_col="quality")) == listed(mixed(spark, ODD, 4, weight_col="quality"))
