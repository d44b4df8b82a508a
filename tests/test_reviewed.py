"""What the review of round 3 found, each on a small table that the code before failed on."""

import duckdb
import numpy as np

from loamfield import staging
from loamfield.operators import cells, chunking, mixtures, search
from loamfield.plans import catalogue


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_multihop_judgements_beyond_four_digits(spark, tmp_path):
    spark.range(10_003).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp_ntz '2024-01-01' as o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert _rows(catalogue.QUERIES["multihop_judgements"](spark, str(tmp_path))) == sorted(con.execute(catalogue.ORACLES["multihop_judgements"]).fetchall())


def test_dense_scores_few_pairs_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (60, 3)).astype(float)  # many ties
    v = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(m)] + [(60, None, 1), (61, [1.0], 1)], "doc long, embedding array<double>, label int").coalesce(1)
    q = v.filter("doc < 20 or doc > 59").withColumnRenamed("doc", "query")
    monkeypatch.setattr(search, "SCORES", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        got, tagged = (_rows(search.dense(v, q, 4, match=x).drop("rank")) for x in (None, "label"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    norm = np.linalg.norm(m, axis=1)
    s = np.round(np.divide(m[:20] @ m.T, norm[:20, None] * norm, out=np.zeros((20, 60)), where=norm[:20, None] * norm > 0), 6)
    want = lambda pool: sorted((i, int(j), float(s[i, j])) for i in range(20) for j in sorted(pool(i), key=lambda j: (-s[i, j], j))[:4])
    near = lambda rows: [(a, b, round(c, 6)) for a, b, c in rows if a < 60]
    assert near(got) == want(lambda i: range(60))
    assert near(tagged) == want(lambda i: range(i % 3, 60, 3))
    assert [x for x in got if x[0] == 61] == [(61, 61, 1.0)]


def test_cell_search_sends_a_query_by_shelf(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((300, 4))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "doc long, embedding array<double>")
    kept = []

    def staged(df, name, at=None):
        out = staging.staged(df, name, at)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(cells, "staged", staged)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    s = np.round(unit @ unit.T, 6)
    want = sorted((i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), -s[i]))[:3])
    for least in (1024, 40):  # one shelf and block; eight of each and more
        monkeypatch.setattr(cells, "LEAST_ROWS", least, raising=False)
        index = cells.build(v, cells=20)
        got = cells.search(index, v.withColumnRenamed("doc", "query"), 3, probes=20)
        assert _rows(got.select("query", "doc")) == want
        some = _rows(cells.search(index, v.withColumnRenamed("doc", "query"), 3, probes=6).select("query", "doc"))
        assert len(set(some) & set(want)) > 0.7 * len(want)
    assert [n for name, n in kept if name == "routed"] == [300] * 4


def test_chunks_leave_a_task_by_the_few(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab cd " * 40) for i in range(30)] + [(None, "x"), (98, None), (99, " ")], "doc_id long, text string").coalesce(1)
    seen = []
    monkeypatch.setattr(chunking, "_batch", lambda rows, made=chunking._batch: seen.append(len(rows)) or made(rows), raising=False)
    monkeypatch.setattr(chunking, "HELD", 7, raising=False)
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, **k: run.append(f), raising=False)
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, f, schema, *a, **k: run.append(f), raising=False)
    chunking.chunk(docs, "code", 5, 1)
    monkeypatch.undo()
    monkeypatch.setattr(chunking, "HELD", 7)
    got = [b for b in run[0](iter(docs.toArrow().to_batches()))]
    assert max(b.num_rows for b in got) <= 7
    want = [(i, j, 3 * j, 3 * j + 2, ("ab", "cd")[j % 2]) for i in range(30) for j in range(80)] + [(None, 0, 0, 1, "x")]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


def test_mixtures_take_few_rows_at_a_time(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, embedding array<double>").coalesce(1)
    count = lambda x: {(0, 0): np.array([1.0]), (1, 0): x.sum(axis=0)}
    got = mixtures._summed(v, 2, count, mixtures.NUMBERS // 5)
    assert got[0, 0].tolist() == [10.0] and got[1, 0].tolist() == [1225.0, 50.0]


def test_synonyms_take_one_pass_and_sums_are_dealt(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the house of the king"), (2, "le roi"), (3, None), (4, "in the end and the")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "the king"), (8, "end")], "query long, text string")
    groups = spark.createDataFrame([(1, "the"), (1, "le"), (1, "of the"), (2, "and"), (2, "in the")], "group_id int, term string")
    each = sorted((r.doc, r.term) for r in search.expanded(search.token_table(docs).select("doc", "t"), groups).collect() if r.doc == 2)
    assert each == [(2, "le"), (2, "of"), (2, "roi"), (2, "the"), (2, "the")]
    monkeypatch.setattr(search, "SUMS", 1, raising=False)
    few, many = (_rows(search.bm25(docs, asked, groups=groups)) for _ in range(2))
    assert few == many and {r[1] for r in few if r[0] == 7} == {1, 2, 4}
    assert search.dealt(4, asked) == max(spark.sparkContext.defaultParallelism, 8)


def test_neighbours_write_links_once_and_as_they_come(spark, monkeypatch):
    from loamfield.operators import graph

    rows, real = {}, graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: (t := real(df, name), rows.setdefault(name, t.count()))[0])
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 3), (3, 4), (4, 4)], "src long, dst long")
    got = graph.neighbours(edges, spark.createDataFrame([(1,), (4,)], "node long"), 2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 1), (1, 3, 2), (4, 2, 2), (4, 3, 1)]
    assert rows == {"links": 6, "front": 2}
