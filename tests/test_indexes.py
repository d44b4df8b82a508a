"""Kept indexes against fresh ones."""

import random

import numpy as np
import pytest

from loamfield.operators import cells, postings, search

WORDS = [f"w{i}" for i in range(30)] + ["the"] * 20


def _bm25(spark, docs, queries):
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    return sorted(tuple(r) for r in search.bm25(df, queries, 5).select("query", "doc", "score", "rank").collect())


def test_changed_postings_equal_a_fresh_index(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 25)))
    queries = spark.createDataFrame([(i, text() + " nowhere") for i in range(6)] + [(99, "")], "query long, text string")
    index, held = postings.create(spark, buckets=3), {}
    kind = "doc_id long, text string"
    assert postings.search(spark, index, queries).collect() == []
    for step in range(5):
        new = {rng.randrange(40): text() for _ in range(12)}
        old = {rng.randrange(40) for _ in range(6)} - set(new)
        rows = [(i, t) for i, t in new.items()] + [(None, "the w1"), (next(iter(new)), None)]
        postings.change(spark, index, added=spark.createDataFrame(rows, kind), removed=spark.createDataFrame([(i,) for i in old] + [(777,)], "doc_id long"))
        held = {i: t for i, t in held.items() if i not in old} | new
        got = postings.search(spark, index, queries, 5).select("query", "doc", "score", "rank").collect()
        assert sorted(tuple(r) for r in got) == _bm25(spark, held, queries)
    # a change that stops before its row in the log counts for nothing
    docs = spark.createDataFrame([(1, "the w1 w2")], kind)
    commit = postings._commit
    try:
        postings._commit = lambda *a: (_ for _ in ()).throw(RuntimeError())
        with pytest.raises(RuntimeError):
            postings.add(spark, index, docs)
    finally:
        postings._commit = commit
    got = postings.search(spark, index, queries, 5).select("query", "doc", "score", "rank").collect()
    assert sorted(tuple(r) for r in got) == _bm25(spark, held, queries)
    small = postings.compact(spark, index)
    got = postings.search(spark, small, queries, 5).select("query", "doc", "score", "rank").collect()
    assert sorted(tuple(r) for r in got) == _bm25(spark, held, queries)
    postings.remove(spark, small, spark.createDataFrame([(i,) for i in held], "doc_id long"))
    assert postings.search(spark, small, queries).collect() == []


def test_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    v = centres[rng.integers(20, size=3000)] + 0.3 * rng.normal(size=(3000, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(5000, None), (5001, []), (5002, [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [0.0] * 16), (5005, [float("nan")] * 16)]
    docs = spark.createDataFrame(rows + odd, "doc long, embedding array<double>")
    queries = docs.filter("doc % 50 = 0").withColumnRenamed("doc", "query")
    index = cells.build(docs, cells=40)
    assert index.rows(spark).count() == 3001  # a vector of zeros has a place too
    exact = search.dense(docs, queries)
    got = cells.recall(cells.search(index, queries, probes=8), exact).first()
    assert got.n_queries == 60 and got.recall >= 0.9
    every = cells.search(index, queries, probes=40)
    assert sorted(tuple(r) for r in every.collect()) == sorted(tuple(r) for r in exact.select("query", "doc", "score", "rank").collect())


def test_cells_in_pieces_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "PIECE", 60)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(150)] + [(200 + i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc long, embedding array<double>")
    queries = docs.filter("doc % 3 = 0").withColumnRenamed("doc", "query")
    index = cells.build(docs, cells=4)
    cells.add(index, docs.filter("doc < 30").selectExpr("doc + 1000 as doc", "embedding"), 1)
    cells.remove(index, docs.filter("doc % 10 = 1").select("doc"), 2)
    left = index.rows(spark).select("doc", "embedding")
    assert left.count() == 210 - 21 + 30
    want = sorted(tuple(r) for r in search.dense(left, queries, 4).select("query", "doc", "score", "rank").collect())
    assert sorted(tuple(r) for r in cells.search(index, queries, 4, probes=4).collect()) == want


def test_cells_need_vectors(spark):
    with pytest.raises(ValueError):
        cells.build(spark.createDataFrame([(1, None)], "doc long, embedding array<double>"))


def test_neighbour_graph_and_layout(spark):
    rng = np.random.default_rng(4)
    v = np.eye(8)[np.arange(90) % 3] + 0.1 * rng.normal(size=(90, 8))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc long, embedding array<double>")
    near = cells.neighbours(cells.build(docs, cells=6), docs, 6, probes=6)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    want = {(i, j, r + 1) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(90), -s[i]))[:6].tolist())}
    rows = near.collect()
    assert {(r.src, r.dst, r["rank"]) for r in rows} == want
    links = cells.fuzzy(near)
    got = {(r.src, r.dst): r.weight for r in links.collect()}
    assert set(got) == {(min(i, j), max(i, j)) for i, j, _ in want} and all(0 < w <= 1 + 1e-12 for w in got.values())
    assert all(max(got[min(i, j), max(i, j)] for j in range(90) if (i, j, 1) in want) > 1 - 1e-9 for i in range(90))  # the nearest
    start = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(90)], "node long, position array<double>")
    at = {r.node: np.array(r.position) for r in cells.layout(links, start, rounds=25, rate=1.0).collect()}
    p = np.array([at[i] for i in range(90)])
    far = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    kept = np.mean([j % 3 == i % 3 for i in range(90) for j in np.argsort(far[i])[:6]])
    assert kept > 0.9


def test_a_change_writes_texts_once(spark, monkeypatch):
    names, real = [], postings.staged
    monkeypatch.setattr(postings, "staged", lambda df, name, *at: (names.append(name), real(df, name, *at))[1])
    index = postings.create(spark, buckets=3)
    rows = [(1, "b a b"), (1, "a"), (2, None), (2, None), (3, "c c c a"), (4, "")]
    postings.add(spark, index, spark.createDataFrame(rows, "doc_id long, text string"))
    held = lambda name, *c: {tuple(r) for r in postings._table(spark, index, name, [1]).select(*c).collect()}
    assert held("postings", "term", "doc", "tf", "len") == {("b", 1, 2, 3), ("a", 1, 1, 3), ("c", 3, 3, 4), ("a", 3, 1, 4)}
    assert held("counts", "term", "n") == {("a", 2), ("b", 1), ("c", 1)} and held("docs", "doc", "len") == {(1, 3), (2, 0), (3, 4), (4, 0)}
    assert names == ["repeated"]  # the documents' own rows serve the postings and counts: no table of tokens beside them
