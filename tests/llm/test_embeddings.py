"""Clusters by bisectors and whitening against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pulseloom.llm import centroids, whitening
from pulseloom.llm.vectors import integers

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, n string, id string, vec string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", "e", "f") for i, v in rows], SCHEMA)


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) if abs(x) < 1e15 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    place = [list(v) for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(place)), key=lambda c: (square(v, place[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        for c, own in groups.items():
            place[c] = [sum(x) // len(own) for x in zip(*own)]
    most = (1 << 63) - 1
    out = [(i, nearest(v), square(v, place[nearest(v)])) for i, v in kept]
    within = {c: sum(d for _, x, d in out if x == c) for c in range(len(place))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in place]
    return sorted(((i, c, min(d, most), min(within[c], most), min(sum(within.values()), most), digest[c]) for i, c, d in out), key=str)


def clusters(spark, rows, **how):
    return sorted((tuple(r) for r in centroids.bisector_clusters(frame(spark, rows), **how).collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=6), st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=30))
def test_the_tournament_finds_the_nearest_and_the_smaller_number(places, points):
    won = centroids.tournament(np.array(points), *centroids.bisectors(places, False))
    for x, c in zip(points, won.tolist()):
        assert c == min(range(len(places)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(x, places[k])), k))


def test_clusters_equal_the_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.standard_normal(4) + 3 * (i % 3), 1).tolist()) for i in range(120)]
    rows += [(7, rows[7][1]), (None, [0.5, 0.5, 0.5, 0.5]), (200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 1.0, 1.0]),
             (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [1.0] * 5)] + [(300 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(50)]
    assert clusters(spark, rows, k=7, dims=4) == plain_clusters(rows, 7, 3, 4, 64)
    assert clusters(spark, rows, k=1, dims=4, rounds=1) == plain_clusters(rows, 1, 1, 4, 64)


def test_clusters_of_huge_entries_stay_exact(spark):
    rows = [(i, [x * 10.0 ** (5 * (i % 9)), float(i)]) for i, x in enumerate(np.random.default_rng(1).standard_normal(60).tolist())]
    rows.append((99, [1.7e308, -1.7e308]))
    assert clusters(spark, rows, k=5, dims=2) == plain_clusters(rows, 5, 3, 2, 64)


def test_few_vectors_and_none(spark):
    one = [(3, [1.0, 2.0])]
    assert clusters(spark, one, k=16, dims=2) == plain_clusters(one, 16, 3, 2, 64)
    assert clusters(spark, [(1, None)], k=4, dims=2) == [] and clusters(spark, [], k=4, dims=2) == []


def test_integers_are_floors_at_any_size():
    x = np.array([[0.999, -0.001], [2.0 ** 60, -1e300]])
    assert integers(x[:1], 64).tolist() == [[63, -1]]
    assert integers(x, 64, 5).tolist() == [[68, 4], [2 ** 66 + 5, int(-1e300) * 64 + 5]]


MATRICES = {
    "normal": lambda g: g.standard_normal((200, 24)),
    "falling": lambda g: g.standard_normal((200, 24)) * np.logspace(0, -8, 24),
    "rising": lambda g: g.standard_normal((200, 24)) * np.logspace(-8, 0, 24),
    "equal values": lambda g: np.linalg.qr(g.standard_normal((24, 24)))[0] * 3,
    "close values": lambda g: np.diag(np.r_[5 + 1e-12 * np.arange(10), np.ones(14)]) @ np.linalg.qr(g.standard_normal((24, 24)))[0],
    "rank 3": lambda g: g.standard_normal((50, 3)) @ g.standard_normal((3, 24)),
    "unit": lambda g: np.eye(24), "zero": lambda g: np.zeros((30, 5)), "one": lambda g: np.ones((4, 1)),
    "glued": lambda g: np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values_and_directions(name):
    factor = np.linalg.qr(MATRICES[name](np.random.default_rng(3)), mode="r")
    want = np.linalg.svd(factor, compute_uv=False)
    diagonal, upper, mirrors = whitening.bidiagonal(factor)
    own = np.sqrt(np.maximum(whitening.squared_singular_values(diagonal, upper), 0))
    assert np.abs(own - want).max() <= 1e-13 * max(want[0], 1e-300)
    values, axes, total = whitening.directions(factor, 8)
    assert len(values) == min(8, int((want > 1e-12 * max(want[0], 1e-300)).sum()))
    assert np.allclose(total, (factor ** 2).sum(), rtol=1e-13)
    assert np.abs(axes @ axes.T - np.eye(len(values))).max(initial=0) < 1e-13
    for value, axis in zip(values, axes):
        assert np.linalg.norm(factor.T @ (factor @ axis) - value * axis) < 1e-13 * values[0]


def test_small_values_keep_their_digits():
    diagonal, upper = np.logspace(0, -12, 20), np.logspace(-3, -15, 19)
    own = np.sqrt(whitening.squared_singular_values(diagonal, upper))
    # the product of all is the determinant, the smallest counts as much as the greatest
    assert np.isclose(np.log(own).sum(), np.log(diagonal).sum(), rtol=0, atol=1e-12)


def check_whitening(got, rows, k=8):
    x = np.array([np.floor(1024 * np.array(v)) + 100_000 for _, v in rows])
    n = len(x)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1]))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    want = (x - x.mean(axis=0)) @ axes / np.sqrt(values)
    assert len(got) == n * len(values) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    sums = x.astype(int).sum(axis=0)
    deviation = {i: int(((n * v.astype(int) - sums) ** 2).sum()) for (i, _), v in zip(rows, x)}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in got)
    trace = np.trace(np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1]))
    place = {i: at for at, (i, _) in enumerate(rows)}
    for c in range(1, len(values) + 1):
        own = np.zeros(n)
        for r in got:
            if r["component"] == c:
                own[place[r["vec_id"]]] = r["whitened"]
                assert np.isclose(r["explained"], values[c - 1] / trace, rtol=1e-10)
        assert min(np.abs(own - want[:, c - 1]).max(), np.abs(own + want[:, c - 1]).max()) < 1e-8


def test_whitening_equals_eigenvectors_on_any_layout(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(10) * np.arange(1, 11)).tolist()) for i in range(200)]
    rows += [(500 + i, rows[0][1]) for i in range(60)]
    odd = [(900, None), (901, [1.0] * 9 + [None]), (902, [float("nan")] * 10), (903, [float("inf")] * 10), (904, [1.0, 2.0]), (905, [])]
    for parts in (1, 7):
        check_whitening(whitening.whiten(frame(spark, rows + odd).repartition(parts, "vec_id")).collect(), rows)


def test_factors_are_joined_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "JOINED_BYTES", 1)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(3) * [3, 2, 1]).tolist()) for i in range(90)]
    check_whitening(whitening.whiten(frame(spark, rows).repartition(9)).collect(), rows, 3)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []
    flat = whitening.whiten(frame(spark, [(1, [0.0, 5.0]), (None, [1.0, 5.0])])).collect()
    assert sorted((r["component"], abs(round(r["whitened"], 9)), r["explained"]) for r in flat) == [(1, 1.0, 1.0)] * 2


def test_whitening_of_huge_entries(spark):
    got = whitening.whiten(frame(spark, [(1, [1e17, 1.0]), (2, [-1e17, 2.0]), (3, [0.0, 0.0])])).collect()
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {(1 << 63) - 1}
    assert max(r["identity_error"] for r in got) < 1e-4
