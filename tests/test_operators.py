"""Operators whose results SQL doesn't tell."""

import pytest

from loamfield.operators import chunking, graph, ingest, metrics, retrieval, search
from loamfield.sources import mail, web


def test_recursive_chunks_fit_and_lose_nothing():
    text = "\n\n".join("Sentence number one is here. And another one follows it. " * n for n in (1, 3, 40)) + "x" * 700
    parts = chunking.recursive(text, 200)
    assert all(0 < len(p) <= 200 for p in parts)
    squeeze = lambda s: "".join(s.split()).replace(".", "")
    assert squeeze("".join(parts)) == squeeze(text)
    assert chunking.recursive("  ", 10) == [] and chunking.fixed("", 10, 2) == []
    with pytest.raises(ValueError):
        chunking.chunk(None, size=10, overlap=10)


def test_mmr_and_redundancy(spark):
    rows = [(1, 1, 1, 0.9, [1.0, 0.0]), (1, 2, 2, 0.89, [1.0, 0.01]), (1, 3, 3, 0.5, [0.0, 1.0])]
    hits = spark.createDataFrame(rows, "query long, doc long, rank int, score double, embedding array<double>")
    assert [r.doc for r in retrieval.mmr(hits, 2).orderBy("place").collect()] == [1, 3]
    assert sorted(r.doc for r in retrieval.drop_redundant(hits).collect()) == [1, 3]


def test_dense_blocks_agree(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, [1.0])]
    v = spark.createDataFrame(rows, "doc long, embedding array<double>")
    q = v.filter("doc % 10 = 0").withColumnRenamed("doc", "query")
    assert sorted(search.dense(v, q, 3).collect()) == sorted(search.dense(v, q, 3, block=2).collect())


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 4), (1, 3, 1)], "q long, i long, c long")
    assert sorted(r.i for r in retrieval.budget(rows, "q", "i", "c", 10).collect()) == [0, 2, 3]


def test_synonyms_are_symmetric(spark):
    t = spark.createDataFrame([(1, "car"), (2, "auto"), (3, "sky")], "key long, term string")
    g = spark.createDataFrame([(1, "car"), (1, "auto")], "group_id long, term string")
    assert sorted((r.key, r.term) for r in search.synonyms(t, g).collect()) == [(1, "auto"), (1, "car"), (2, "auto"), (2, "car"), (3, "sky")]


def test_pagerank_keeps_all_mass(spark):
    n = spark.createDataFrame([(i,) for i in range(4)], "node long")
    e = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 2), (2, 9)], "src long, dst long")
    assert abs(sum(r.score for r in graph.pagerank(n, e, 10).collect()) - 1) < 1e-9
    assert {r.node: r.degree for r in graph.degrees(n, e).collect()} == {0: 2, 1: 3, 2: 4, 3: 0}


def test_roles_and_files(spark, tmp_path):
    d = spark.createDataFrame([(1, None), (2, "Admin, dev"), (3, "ops")], "id long, allowed_roles string")
    assert sorted(r.id for r in ingest.visible(d, ["DEV"]).collect()) == [1, 2]
    assert [r.id for r in ingest.visible(d, []).collect()] == [1]
    (tmp_path / "a.TXT").write_text("x")
    (tmp_path / "b.md").write_text("y")
    assert [r.length for r in web.files(spark, str(tmp_path), [".txt"]).collect()] == [1]


def test_entry_has_sql_only_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_code_chunks_keep_separators():
    text = "import a\nclass A:\n    x = 1\ndef f():\n    return 1\n" + "y = 2\n" * 30
    parts = chunking.code(text, 60)
    assert all(len(p) <= 60 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert any(p.startswith("class A") for p in parts) and any(p.startswith("def f") for p in parts)


def test_breadcrumbs_close_deeper_headings(spark):
    rows = [(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, None, None), (1, 3, 1, "C"), (1, 4, 3, "D"), (1, 5, 2, "E")]
    s = spark.createDataFrame(rows, "doc long, place int, level int, heading string")
    assert [r.path for r in chunking.breadcrumbs(s).orderBy("place").collect()] == ["A", "A > B", "A > B", "C", "C > D", "C > E"]


def test_merged_sections_begin_at_headings(spark):
    rows = [(1, 0, None, None, "x"), (1, 1, 1, "A", "y"), (1, 2, 3, "B", "z")]
    s = spark.createDataFrame(rows, "doc long, place int, level int, heading string, text string")
    assert [r.text for r in chunking.merged(s).orderBy("part").collect()] == ["x", "A\n\nz"]  # a heading's own section gives its heading alone


def test_markdown_and_mail_sections(spark):
    raw = b"From: a@b.c\nTo: d@e.f\nSubject: Hi\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nContent-Type: text/plain; charset=utf-8\n\nHello there\n"
    files = spark.createDataFrame([("m.md", b"intro\n# One\nbody\n## Two\n"), ("n.md", None)], "path string, content binary")
    assert [(r.heading, r.level, r.text) for r in mail.markdown(files).orderBy("place").collect()] == [(None, None, "intro"), ("One", 1, "body"), ("Two", 2, "")]
    mails = mail.mails(spark.createDataFrame([("a.eml", raw), ("b.eml", None)], "path string, content binary")).orderBy("place").collect()
    assert [(r.place, r.heading) for r in mails] == [(0, "headers"), (1, "text/plain")] and mails[1].text == "Hello there" and "Subject: Hi" in mails[0].text


def test_federated_ties_go_to_the_better_score(spark):
    a = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.4, 2)], "query long, doc long, score double, rank int")
    b = spark.createDataFrame([(1, 20, 0.9, 1)], "query long, doc long, score double, rank int")
    assert [(r.doc, r.store) for r in search.federate([a, b]).orderBy("rank").collect()] == [(20, 1), (10, 0), (11, 0)]


def test_gate_wants_equal_queries(spark):
    t = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 2.0)], "run string, query long, ms double")
    assert metrics.repeat_gate(t).first()[:] == (2, 2.0, False, False)
