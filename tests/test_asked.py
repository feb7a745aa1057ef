"""Query tables, language profiles, candidate pairs and chains of near duplicates."""

import re

import numpy as np
import pytest
import reference_loops as ref
from pulseloom.operators import asked as ak, grouping as gr, profiles as pf, similarity as si


def plain_match(query, texts):
    groups = [[w.lower() for w in part.split() if w.upper() != "AND"] for part in re.split(r"\s+OR\s+", (query or "").strip(), flags=re.IGNORECASE)]
    groups = [g for g in groups if g]
    texts = [(t or "").lower() for t in texts]
    return not groups or any(all(any(w in t for t in texts) for w in g) for g in groups)


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_queries_as_rows(spark, limit):
    posts = [(1, "The cat sat", None, "x"), (2, "A dog", "concatenate THE thing", "x"), (3, None, None, "x"), (4, "İstanbul ÉTÉ", "the", "x"), (6, "dog", "cat", "x"), (5, "", " ", "x")]
    queries = ["cat", "the cat", "dog OR cat", "THE and DOG or été", "dog dog", None, "  ", "and", "or", "nowhere", "cat nowhere OR dog", "a b OR OR c", "cat or", "tHe AND cAt AND dog"]
    p = spark.createDataFrame(posts, "id long, title string, body string, query string")
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = sorted((r["query_id"], r["id"]) for r in ak.matching(p, q, id_col="id", attributes=["title", "body"], words_bytes=limit).distinct().collect())
    assert got == sorted({(k, i) for k, text in enumerate(queries) for i, *texts, _ in posts if plain_match(text, texts)})
    assert ak.matching(p.limit(0), q, id_col="id", attributes=["title"]).count() == 0 and ak.matching(p, q.limit(0), id_col="id", attributes=["title"]).count() == 0


def test_matches_are_not_shuffled_and_rows_of_one_id_are_one_post(spark, monkeypatch):
    monkeypatch.setattr(ak, "OUT_ROWS", 3)
    posts = spark.createDataFrame([(k, f"cat {'dog' if k % 2 else 'owl'}") for k in range(20)], "id long, body string")
    queries = spark.createDataFrame([(1, "cat"), (2, "cat OR dog"), (3, "owl dog"), (4, None), (5, "cat cat OR owl")], "query_id int, query string")
    found = ak.matching(posts, queries, id_col="id", attributes=["body"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(q, k) for q in (1, 2, 4, 5) for k in range(20)}
    # the words of a post may stand in several of its rows
    more = posts.unionByName(spark.createDataFrame([(0, "dog"), (0, "dog"), (1, "none")], "id long, body string"))
    rows = [tuple(r) for r in ak.matching(more, queries, id_col="id", attributes=["body"]).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(q, k) for q in (1, 2, 4, 5) for k in range(20)} | {(3, 0)}


def test_what_many_queries_find_takes_little_room(spark, tmp_path, monkeypatch):
    """Queries that share an alternative hand on the same posts in runs: a file of them took over a byte for each match."""
    words = ["the", "of", "ox", "sea", "rye"]
    texts = [" ".join(w for k, w in enumerate(words) if (i * (k + 3)) % (k + 2) == 0) + f" n{i % 300}" for i in range(400)]
    asked = [(k, f"the OR n{k % 300}") for k in range(1000)] + [(1000 + k, q) for k, q in enumerate(["sea OR ox OR the AND n7 OR rye", "of AND ox OR sea AND of OR of", None, "nowhere"])] + [(None, "rye or ox or rye")]
    p, q = spark.createDataFrame(list(enumerate(texts)), "id long, body string").coalesce(1), spark.createDataFrame(asked, "query_id int, query string")
    want = sorted(((k, i) for k, text in asked for i, body in enumerate(texts) if plain_match(text, [body])), key=str)
    for rows, cells in ((1 << 18, 1 << 23), (100, 1), (1000, 1 << 12)):
        monkeypatch.setattr(ak, "OUT_ROWS", rows)
        monkeypatch.setattr(ak, "CELLS", cells, raising=False)
        found = ak.matching(p, q, id_col="id", attributes=["body"])
        if cells == 1 << 23:
            found.write.parquet(str(tmp_path / "found"))
            assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < len(want) / 3
            found = spark.read.parquet(str(tmp_path / "found"))
        assert sorted(((r["query_id"], r["id"]) for r in found.collect()), key=str) == want


def test_profiles_decide_or_stay_silent(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and then the other " * 3, "le renard brun saute par dessus le chien paresseux et puis les autres " * 3
    known = pf.learnt(spark.createDataFrame([(en, "en"), (fr, "fr"), (None, "en"), ("x", None)], "t string, l string"), text_col="t", language_col="l").cache()
    assert known.groupBy("language").count().count() == 2 and known.filter("rank >= 400").count() == 0
    texts = [("the dog and the fox", "en"), ("les chiens et le renard", "fr"), (None, None), ("", None), ("12 34", None), ("a", None), ("漢字漢字", None), (en * 3000, "en")]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["detected"] for r in pf.detected(rows, known, text_col="t").collect()}
    assert got == {k: want for k, (_, want) in enumerate(texts)}
    assert [r["k"] for r in pf.in_language(rows, known, "fr", text_col="t").collect()] == [1]
    assert pf.detected(rows, known.limit(0), text_col="t").filter("detected is not null").count() == 0


def test_candidate_pairs_are_right_and_nearly_all(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    v = np.vstack([c + rng.normal(scale=0.25, size=(8, 16)) for c in centres] + [np.repeat(centres[:1], 30, axis=0), np.zeros((2, 16))])
    df = spark.createDataFrame([("s", i, [float(x) for x in row]) for i, row in enumerate(v)], "s string, id long, v array<double>")
    how = dict(keys=["s"], id_col="id", vec_col="v")
    sims = ref.unit(v) @ ref.unit(v).T
    want = {(i, j) for i in range(480) for j in range(i + 1, 480) if sims[i, j] > 0.88}
    pairs, members = si.similar_classes(df, 0.88, recall=0.95, block_rows=20, **how)
    got = {(r.id_a, r.id_b) for r in pairs.collect()}
    assert {p for p in got if p[1] < 480} <= want and len(got & want) >= 0.9 * len(want)
    assert max(j for _, j in got) <= 480  # thirty equal vectors are one class
    rep = {r.id: r.representative for r in members.collect()}
    assert len(rep) == len(v) and {rep[i] for i in range(480, 510)} == {480}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    turns = []
    real = gr._alternating
    monkeypatch.setattr(gr, "_alternating", lambda *a: turns.append(1) or real(*a))
    n = 40
    edges = [("s", i + 1, i) for i in range(n)] + [("s", 60, 3), ("s", 60, 4), ("s", 61, 60)]
    nodes = spark.createDataFrame([("s", i) for i in [*range(n + 1), 60, 61, 70]], "s string, _id long")
    kept = {r["_id"] for r in gr._first_independent(nodes, spark.createDataFrame(edges, "s string, _id long, _p long"), ["s"]).collect()}
    assert kept == {i for i in range(0, n + 1, 2)} | {61, 70}
    assert len(turns) <= 2


def test_copies_for_buckets_are_few_and_made_in_parts(spark, monkeypatch):
    # a vector travels once for each code: at 100,000 rows there were 564 such copies
    bits, tables = si._tables_for(100_000, 0.4, 0.95)
    assert tables * (1 + si.PROBES) <= 120 and 100_000 * 0.5 ** bits < 4096
    monkeypatch.setattr(si, "COPY_CELLS", 5000)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    df = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)], "g int, id long, v array<float>")
    how = dict(keys=["g"], id_col="id", vec_col="v")
    exact = {(r.id_a, r.id_b) for r in si.similar_pairs(df, 0.5, **how).collect()}
    found = {(r.id_a, r.id_b) for r in si.candidate_pairs(df, 0.5, block_rows=16, **how).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    assert exact == {(a, b) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T > 0.5, 1)))} and found <= exact and len(found) >= 0.9 * len(exact)


def test_pairs_meet_once_and_copies_of_a_round_are_few(spark, monkeypatch):
    """Tables come in rounds, each of a few copies of a vector, and a pair is handed on by the first bucket where it meets, not by each."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 12))
    v = np.vstack([c + rng.normal(scale=0.4, size=(6, 12)) for c in centres] + [np.repeat(centres[:1], 20, axis=0), np.zeros((2, 12))]).astype(np.float32)
    df = spark.createDataFrame([("s", k, x.tolist()) for k, x in enumerate(v)] + [("t", 900, v[0].tolist()), ("t", 901, v[0].tolist()), ("s", None, v[0].tolist())], "s string, id long, v array<float>")
    how = dict(keys=["s"], id_col="id", vec_col="v")
    exact = {(r.id_a, r.id_b) for r in si.similar_pairs(df, 0.7, **how).collect()}
    handed, stored = [], getattr(si, "stored", None)
    monkeypatch.setattr(si, "stored", lambda d: handed.append(stored(d)) or handed[-1], raising=False)
    monkeypatch.setattr(si, "MEETINGS", 100, raising=False)
    monkeypatch.setattr(si, "_tables_for", lambda *a: (5, 17))
    found = [(r.id_a, r.id_b) for r in si.candidate_pairs(df, 0.7, block_rows=16, **how).collect()]
    assert len(found) == len(set(found)) and set(found) <= exact and len(found) >= 0.9 * len(exact)
    rounds = [[(r.s, r.id_a, r.id_b) for r in d.collect() if r.id_a is not None and r.id_b is not None] for d in handed]
    assert len(rounds) >= 17 * (1 + si.PROBES) / 6
    assert sum(map(len, rounds)) == len({p for r in rounds for p in r})


@pytest.mark.parametrize("cells", [1 << 21, 100])
def test_copies_for_blocks_are_few(spark, monkeypatch, cells):
    # a vector of a group of 50 blocks travelled 50 times
    monkeypatch.setattr(si, "BUNDLE_CELLS", cells)
    v = np.random.default_rng(13).normal(size=(200, 6))
    df = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)] + [(2, 0, v[0].tolist()), (None, 1, v[0].tolist())], "g int, id long, v array<double>")
    rows = df.selectExpr("g", "id as _id", "v as _vec", "6 as _dim", "case when g = 1 then 200L end as _rows")
    assert si._block_tasks(rows, ["g"], 4, 8).count() == 200 * (8 if cells > 100 else 12) + 2
    how = dict(keys=["g"], id_col="id", vec_col="v")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    got = [(r.id_a, r.id_b) for r in si.similar_pairs(df, 0.5, block_rows=4, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(unit @ unit.T > 0.5, 1)))))
    best = {r.id: r.best for r in si.best_partner(df.filter("g = 1"), block_rows=4, **how).collect()}
    assert np.allclose([best[k] for k in range(200)], (unit @ unit.T - 2 * np.eye(200)).max(axis=1))
