import numpy as np
import pytest
from pyspark.sql import functions as F

import reference_loops as ref
from pulseloom.operators import clusters as cl, components as co, diversify as dv, grouping as gr, hierarchy as hi, similarity as si

VEC = dict(keys=["s"], id_col="id", vec_col="v")


def frame(spark, vectors, **more):
    names = list(more)
    rows = [("s", i, [float(x) for x in v], *[more[n][i] for n in names]) for i, v in enumerate(vectors)]
    kinds = {"p": "double", "flag": "boolean", "src": "string"}
    return spark.createDataFrame(rows, "s string, id bigint, v array<double>" + "".join(f", {n} {kinds[n]}" for n in names)).repartition(3)


def cloud(seed, n, dims=6, copies=0):
    """Random vectors; the first of them is repeated ``copies`` times: one value fills a third of the rows."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    return np.vstack([v, np.repeat(v[:1], copies, axis=0)]) if copies else v


@pytest.mark.parametrize("block", [2048, 7])
def test_pairs(spark, block):
    v = cloud(1, 40, copies=20)
    v[5] = 0
    sims = ref.unit(v) @ ref.unit(v).T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if sims[i, j] > 0.6}
    got = si.similar_pairs(frame(spark, v), 0.6, block_rows=block, **VEC).collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want)


def test_vectors_of_other_length_never_match(spark):
    df = frame(spark, [[1, 0], [1, 0], [1, 0, 0]])
    assert [(r.id_a, r.id_b) for r in si.similar_pairs(df, 0.5, **VEC).collect()] == [(0, 1)]


@pytest.mark.parametrize("seed, block", [(2, 2048), (2, 9), (3, 9)])
def test_near_duplicates(spark, seed, block):
    v = cloud(seed, 40, dims=4, copies=20)
    priority = [float(x) for x in np.random.default_rng(seed).integers(0, 6, len(v))]
    got = gr.near_duplicates(frame(spark, v, p=priority), 0.7, priority_col="p", ordinal_col="id", block_rows=block, **VEC).collect()
    assert {r.id: r.leader_id for r in got} == ref.greedy_leaders(v, priority, 0.7)


def test_chain_is_not_transitive(spark):
    angle = np.radians([0, 25, 50])
    v = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    first = gr.near_duplicates(frame(spark, v, p=[3.0, 2.0, 1.0]), 0.88, priority_col="p", ordinal_col="id", **VEC).collect()
    assert {r.id: r.leader_id for r in first} == {0: 0, 1: 0, 2: 2}
    middle = gr.near_duplicates(frame(spark, v, p=[2.0, 3.0, 1.0]), 0.88, priority_col="p", ordinal_col="id", **VEC).collect()
    assert {r.id: r.leader_id for r in middle} == {0: 1, 1: 1, 2: 1}
    merged = co.merge_groups(frame(spark, v, flag=[False] * 3), 0.85, flag_col="flag", **VEC).collect()
    assert {r.component for r in merged} == {0}


@pytest.mark.parametrize("block", [2048, 7])
def test_components(spark, block):
    v = cloud(4, 30, dims=4, copies=15)
    flags = [bool(i % 3 == 0) for i in range(len(v))]
    got = co.merge_groups(frame(spark, v, flag=flags), 0.75, flag_col="flag", block_rows=block, **VEC).collect()
    assert [r.component for r in sorted(got, key=lambda r: r.id)] == ref.components(v, flags, 0.75)


@pytest.mark.parametrize("pool", [1000, 12])
def test_diversify(spark, pool):
    v = cloud(5, 40, dims=2, copies=20)
    rel = [float(x) for x in np.random.default_rng(5).integers(0, 9, len(v))]
    got = dv.diversify(frame(spark, v, p=rel), 8, 0.7, relevance_col="p", ordinal_col="id", pool_rows=pool, **VEC).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.pick)] == ref.mmr(v, rel, 8, 0.7)


def test_diversify_passes_short_groups(spark):
    got = dv.diversify(frame(spark, cloud(6, 4), p=[0.0] * 4), 5, relevance_col="p", ordinal_col="id", **VEC).collect()
    assert sorted((r.id, r.pick) for r in got) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_clusters_and_noise(spark):
    rng = np.random.default_rng(7)
    tight = lambda centre: np.array(centre) + rng.normal(scale=0.02, size=(4, 3))
    v = np.vstack([tight([1, 0, 0]), tight([0, 1, 0]), [[-1, -1, 0.5]]])
    got = cl.density_clusters(frame(spark, v), **VEC).collect()
    assert [r.cluster_id for r in sorted(got, key=lambda r: r.id)] == [0] * 4 + [1] * 4 + [-1]
    two = cl.density_clusters(frame(spark, v[:2]), **VEC).collect()
    assert [r.cluster_id for r in two] == [0, 0]


@pytest.mark.parametrize("seed", [8])
def test_clusters_of_a_large_group(spark, seed):
    rng = np.random.default_rng(seed)
    v = np.vstack([rng.normal(size=(1, 5)) + rng.normal(scale=0.15, size=(8, 5)) for _ in range(4)] + [rng.normal(size=(6, 5))])
    whole = cl.density_clusters(frame(spark, v), **VEC).collect()
    parts = cl.density_clusters(frame(spark, v), block_rows=13, **VEC).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def plain_tree(weights):
    """Kruskal over all pairs in the order of (weight, ends)."""
    n, kept = len(weights), []
    part = list(range(n))
    for w, i, j in sorted((int(weights[i, j]), i, j) for i in range(n) for j in range(i + 1, n)):
        if part[i] != part[j]:
            kept.append((w, i, j))
            part = [part[i] if p == part[j] else p for p in part]
    return kept


@pytest.mark.parametrize("ties", [False, True])
def test_spanning_tree_is_the_one_of_the_order(ties):
    weights = cl.weights_of(ref.unit(cloud(10, 25, copies=8)) @ ref.unit(cloud(10, 25, copies=8)).T)
    weights = weights // 10 ** 9 if ties else weights
    assert sorted(cl.spanning_edges(np.minimum(weights, weights.T))) == plain_tree(np.minimum(weights, weights.T))


def hierarchy_labels(spark, n, edges, min_size, epsilon):
    table = spark.createDataFrame([("s", *e) for e in edges], "s string, _q long, _a long, _b long")
    points = spark.createDataFrame([("s", i) for i in range(n)], "s string, _id long")
    got = hi.labels(points, table, keys=["s"], min_size=min_size, density=cl.density("_q"), merges=cl.near("_q", epsilon))
    return [r.cluster_id for r in sorted(got.collect(), key=lambda r: r._id)]


def nested(seed, n, levels):
    """Distances of points in nested groups: many clusters inside clusters, many equal distances."""
    rng = np.random.default_rng(seed)
    where = rng.integers(0, 3, size=(n, levels))
    apart = np.array([[int((where[i] == where[j]).cumprod().sum()) for j in range(n)] for i in range(n)])
    noise = rng.integers(0, 4, size=(n, n)) * 10 ** 5
    weights = 10 ** 9 // 4 ** apart + np.minimum(noise, noise.T)
    np.fill_diagonal(weights, 0)
    return weights


@pytest.mark.parametrize("seed, n, levels, min_size, epsilon", [(4, 120, 5, 3, 0.1)])
def test_hierarchy_without_a_group_in_one_task(spark, seed, n, levels, min_size, epsilon):
    tree = plain_tree(nested(seed, n, levels))
    assert hierarchy_labels(spark, n, tree, min_size, epsilon) == cl.flat_clusters(n, tree, min_size, epsilon).tolist()


def test_hierarchy_of_a_long_chain(spark):
    """Clusters that join one big one after another: the masses inside are carried along one chain."""
    edges, point = [], 0
    for k in range(12):
        size = 3 + k % 3
        edges += [(1000 + 10 * k + j, point + j, point + j + 1) for j in range(size - 1)]
        if point:
            edges.append((10 ** 6 * (k + 1), 0, point))
        point += size
    assert hierarchy_labels(spark, point + 1, sorted(edges), 3, 0.05) == cl.flat_clusters(point + 1, sorted(edges), 3, 0.05).tolist()


@pytest.mark.parametrize("block", [2048, 9])
def test_vectors_without_a_direction_are_noise(spark, block):
    v = np.vstack([cloud(21, 20, dims=3, copies=6), np.zeros((3, 3))])
    got = [r.cluster_id for r in sorted(cl.density_clusters(frame(spark, v), block_rows=block, **VEC).collect(), key=lambda r: r.id)]
    assert got[-3:] == [-1] * 3 and len({got[i] for i in range(20, 26)} | {got[0]}) == 1


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_best_query(spark, limit):
    docs, queries = cloud(11, 30), cloud(12, 4)
    q = spark.createDataFrame([("s", [float(x) for x in v]) for v in queries], "s string, vec array<double>")
    got = si.best_query_similarity(frame(spark, docs), q, key="s", id_col="id", vec_col="v", broadcast_bytes=limit, chunk_rows=7).collect()
    want = (ref.unit(docs) @ ref.unit(queries).T).max(axis=1)
    assert np.allclose([r.relevance_score for r in sorted(got, key=lambda r: r.id)], want)


def test_search_in_chunks(spark):
    docs = frame(spark, cloud(13, 30, copies=15))
    queries = docs.filter("id < 3").select(F.col("id").alias("query_id"), F.col("v").alias("query_vec"))
    once = si.vector_search(docs, queries, 4, id_col="id", vec_col="v").collect()
    rounds = si.vector_search(docs, queries, 4, id_col="id", vec_col="v", broadcast_bytes=60, chunk_rows=7).collect()
    key = lambda rows: sorted((r.query_id, r.rank, r.id) for r in rows)
    assert key(once) == key(rounds) and len(once) == 12


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_search_holds_a_strip_of_queries(metric):
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(2000, 8)), rng.normal(size=(5000, 8))
    table = lambda m, id_, vec: pa.table({id_: pa.array(range(len(m))), vec: pa.array(m.tolist())})
    rows, queries = table(vectors, "id", "_vec"), table(asked, "query_id", "_q")
    tracemalloc.start()
    got = si._nearest(3, metric)(rows, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6, peak  # all products at once are 80 MB, their order as much
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    want = {"cosine": lambda: 1 - unit(asked) @ unit(vectors).T, "dot": lambda: 1 - asked @ vectors.T,
            "l2": lambda: ((asked[:, None, :] - vectors[None]) ** 2).sum(2)}[metric]()
    best = np.argsort(want, axis=1)[:, :3]
    assert got["query_id"].to_pylist() == np.repeat(np.arange(5000), 3).tolist() and got["id"].to_pylist() == best.ravel().tolist()
    assert np.allclose(got["distance"].to_numpy(), np.take_along_axis(want, best, 1).ravel())


def test_similar_sets_are_all_found(spark):
    import random
    rng, rows = random.Random(1), []
    for k in range(60):
        base = [f"w{rng.randrange(80)}" for _ in range(rng.randrange(1, 40))]
        for c in range(rng.randrange(1, 4)):
            rows.append((4 * k + c, [w for w in base if rng.random() > 0.1 * c] + ([f"x{rng.randrange(5)}"] if c == 2 else [])))
    rows += [(1000, []), (1001, None)]
    df = spark.createDataFrame(rows, "id bigint, t array<string>")
    for threshold in (0.5, 0.7, 0.95, 1.0):
        pairs, copies = gr.similar_sets(df, threshold, id_col="id", tokens_col="t")
        first = {}
        for i, words in rows:
            if words:
                first.setdefault(frozenset(words), i)
        want = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and len(s & t) / len(s | t) >= threshold}
        assert {(r.id_a, r.id_b) for r in pairs.collect()} == want
        assert {r.id: r.representative for r in copies.collect()} == {i: first[frozenset(w)] for i, w in rows if w}


@pytest.mark.parametrize("lexicon,block", [(1 << 20, 512), (20, 3)])
def test_sets_of_pairs_travel_once_for_a_family(spark, monkeypatch, lexicon, block):
    import random
    rng = random.Random(5)
    monkeypatch.setattr(gr, "LEXICON_ROWS", lexicon)
    monkeypatch.setattr(gr, "SLICE_TOKENS", 50)
    sets = {k: frozenset(f"f{k // 20}-{w}" for w in range(60) if rng.random() > 0.08) for k in range(80)}
    df = spark.createDataFrame([(k, list(s)) for k, s in sets.items()], "id bigint, t array<string>")
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert len(want) > 300
    pairs, _ = gr.similar_sets(df, 0.8, id_col="id", tokens_col="t")
    assert {(r.id_a, r.id_b): round(r.jaccard, 9) for r in pairs.collect()} == want
    # families of twenty and their pairs: each set is read once per family and pair of blocks
    links = spark.createDataFrame(list(want), "id_a bigint, id_b bigint")
    rows = spark.createDataFrame([(k, sorted(hash(w) for w in s)) for k, s in sets.items()], "_id bigint, _set array<long>")
    counted = gr._shared_tokens(links, rows, block)
    assert {(r.id_a, r.id_b): round(r.both / (r.na + r.nb - r.both), 9) for r in counted.collect()} == want


def test_sets_are_not_shuffled_and_rounds_leave_nothing(spark, monkeypatch):
    """Sets stay in the files they are written to; candidates come in rounds, and what a round made is gone after the last one."""
    import random
    from pathlib import Path

    from pulseloom.session import ensure_checkpoint_dir
    rng = random.Random(9)
    sets = {k: frozenset(f"f{k // 12}-{w}" for w in range(5 + 30 * (k // 12)) if rng.random() > 0.1) | {f"own-{k}"} for k in range(60)}
    rows = [(k, sorted(s)) for k, s in sets.items()] + [(100 + k, sorted(sets[k])) for k in range(0, 60, 7)] + [(None, ["lost", "row"]), (200, None), (201, [])]
    df = spark.createDataFrame(rows, "id bigint, t array<string>").repartition(3, "id")
    made, copies = gr.distinct_sets(df, id_col="id", tokens_col="t")
    assert {r["_id"] for r in made.collect()} == set(sets) and len(copies.collect()) == 60 + 9 + 1
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert len(want) > 80
    rounds, alike = [], getattr(gr, "_alike", None)
    monkeypatch.setattr(gr, "ROUND_LEAST", 400, raising=False)
    monkeypatch.setattr(gr, "_alike", lambda *a: rounds.append(1) or alike(*a), raising=False)
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    pairs, _ = gr.similar_sets(df, 0.8, id_col="id", tokens_col="t")
    assert {(r.id_a, r.id_b): round(r.jaccard, 9) for r in pairs.collect()} == want
    assert 2 < len(rounds) < 40 and len(set(folder.glob("table-*")) - before) <= 5


def test_copies_of_equal_sets_read_no_sets(spark):
    """Who is equal to whom is told by the keys that are written beside the sets."""
    df = spark.createDataFrame([(3, ["a", "b"]), (1, ["b", "a", "a"]), (2, ["c"]), (None, ["c"]), (4, [])], "id bigint, t array<string>")
    copies = gr.similar_sets(df, 0.7, id_col="id", tokens_col="t")[1]
    assert "_set" not in copies._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(r) for r in copies.collect()), key=str) == [(1, 1), (2, 2), (3, 1), (None, 2)]


def test_long_sets_are_told_apart_by_their_sketches(spark):
    """Two long sets with little in common never meet as whole sets; the sketch grows with the set, and folds to a smaller one."""
    rng = np.random.default_rng(4)
    base = rng.integers(-2**62, 2**62, 9000)
    rows = [(k, sorted({*base[:3000].tolist(), *base[3000 + 1500 * k:3000 + 1500 * (k + 1)].tolist()})) for k in range(4)]
    rows += [(4, sorted(base[:4400].tolist())), (5, sorted(base[:30].tolist())), (6, sorted(base[:40].tolist())), (4, sorted(base[:4400].tolist()))]
    sets = spark.createDataFrame(rows, "_id bigint, _set array<long>")
    every = [(a, b) for a in range(5) for b in range(a + 1, 5)] + [(5, 6)]  # of like sizes, as those that are nominated
    found = gr._alike(spark.createDataFrame(every + every[:3], "id_a bigint, id_b bigint"), gr._sketches(sets), 0.74, 3)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 4, 2), (5, 6, 1)]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_components_of_stars_paths_and_hubs(spark, monkeypatch, hot):
    monkeypatch.setattr(co, "HOT_ROWS", hot)
    monkeypatch.setattr(co, "HOT_SHARE", 50)
    edges = [(500, i) for i in range(200)] + [(i, i + 1) for i in range(600, 700)] + [(0, 499), (499, 900), (901, 900), (800, 800), (950, 951), (951, 950)]
    nodes = range(1000)
    part = {i: i for i in nodes}
    for _ in nodes:
        before = dict(part)
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
        if part == before:
            break
    table = spark.createDataFrame([("s", a, b) for a, b in edges], "s string, src long, dst long")
    got = co.connected_components(spark.createDataFrame([("s", i) for i in nodes], "s string, id long"), table, keys=["s"], id_col="id").collect()
    assert {r.id: r.component for r in got} == part


def test_pointers_are_followed_in_few_rounds(spark, monkeypatch):
    """A chain of sixteen takes three written rounds, not five, and ends at its root; so does every short one beside it."""
    from pulseloom.operators import hierarchy
    written, stored = [], hierarchy.stored
    monkeypatch.setattr(hierarchy, "stored", lambda df: written.append(1) or stored(df))
    rows = [(1, i, max(i - 1, 0)) for i in range(17)] + [(2, 5, 5), (2, 6, 5)]
    found = hierarchy.roots(spark.createDataFrame(rows, "g int, _c long, _to long"), ["g"]).collect()
    assert {(r["g"], r["_c"], r["_root"]) for r in found} == {
        (1, i, 0) for i in range(17)} | {(2, 5, 5), (2, 6, 5)}
    assert len(found) == len(rows) and len(written) == 4
