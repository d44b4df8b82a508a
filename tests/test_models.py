"""Operators with a model or a solver inside, on small cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamfield.operators import answers, communities, entities, governance, ingest, semantic, tree
from loamfield.streaming import events


def _letters():
    def count(texts):  # within a function, so that workers get it by value
        return [[float(t.lower().count(c)) for c in "abcxyz"] for t in texts]

    return count


letters = _letters()


def test_sentences_and_groups(spark):
    t = "Dr. Who came. He left! Why?  No one, e.g. Ann, knows.\nEnd"
    assert semantic.split_sentences(t) == ["Dr. Who came", "He left", "Why", "No one, e.g. Ann, knows", "End"]
    assert spark.createDataFrame([(t,), (None,)], "t string").select(semantic.sentences(F.col("t"))).first()[0] == semantic.split_sentences(t)
    parts = ["aaa"] * 3 + ["xyz"] * 3
    assert semantic.groups(parts, letters(parts), least=1) == [["aaa"] * 3, ["xyz"] * 3]
    assert semantic.groups(parts, letters(parts), least=12) == [parts] and semantic.groups([], []) == [] and semantic.groups(["a"], []) == [["a"]]
    assert all(len(" ".join(g)) <= 7 for g in semantic.groups(parts, letters(parts), least=1, most=7))


def test_semantic_chunks(spark):
    rows = [(1, "aaa aaa. aaa b. xyz xyz. xyz z."), (2, None), (3, "  "), (None, "one.")]
    got = semantic.semantic_chunks(spark.createDataFrame(rows, "doc_id long, text string"), letters, percentile=0.5, least=1).collect()
    texts = dict(rows)
    assert [(r.doc_id, r.text) for r in got if r.doc_id == 1] == [(1, "aaa aaa aaa b"), (1, "xyz xyz xyz z.")] and {r.doc_id for r in got} == {1, None}
    assert all(texts[r.doc_id][r.start_pos :].startswith(r.text.split(" ")[0]) for r in got)
    again = semantic.refine(spark.createDataFrame([(1, 0, "aaa. aaa. xyz. xyz"), (1, 1, "ab")], "doc_id long, chunk_index int, text string"), letters, percentile=0.5, least=1)
    assert [r.text for r in again.orderBy("chunk_index").collect()] == ["aaa aaa", "xyz xyz", "ab"]


def test_token_windows():
    spans = [(2, 4), (5, 7), (8, 9), (11, 12), (13, 15)]
    assert semantic.token_windows(16, spans, 2) == [(0, 8), (8, 13), (13, 16)]
    assert semantic.token_windows(16, spans, 3, 1) == [(2, 9), (8, 15)] and semantic.token_windows(5, [], 3) == []
    with pytest.raises(ValueError):
        semantic.token_windows(5, spans, 2, 2)


def test_token_chunks(spark):
    import public_tokenizers

    text = "alpha beta gamma delta epsilon " * 20
    got = semantic.token_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), 16, 4).orderBy("chunk_index").collect()
    assert [(a.end_pos, b.start_pos) for a, b in zip(got, got[1:])][:3] == [(16, 12), (28, 24), (40, 36)] and {r.doc_id for r in got} == {1}
    whole = semantic.token_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), 16, 0).orderBy("chunk_index").collect()
    assert "".join(r.text.replace(" ", "") for r in whole) == text.replace(" ", "")


def test_vectors(spark):
    m = np.array([[3.0, 0], [0, 4], [9, 9]])
    assert semantic.mean_pooled(m, [1, 1, 0]).tolist() == pytest.approx([0.6, 0.8]) and semantic.mean_pooled(np.zeros((2, 2))) is None
    a, b = np.arange(10.0).reshape(5, 2), -np.arange(10.0).reshape(5, 2)
    got = semantic.stitch([a, b], [0, 3], 8)
    assert got[:3].tolist() == a[:3].tolist() and got[5:].tolist() == b[2:].tolist()
    with pytest.raises(ValueError):
        semantic.stitch([a], [0], 8)
    docs = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string")
    late = semantic.late_chunks(docs, lambda t: ([(m.start(), m.end()) for m in re.finditer(r"\S+", t)], np.ones((4, 3))), 3, 1).collect()
    assert [(r.text, len(r.embedding)) for r in late] == [("one two three", 3), ("three four", 3)] and abs(sum(x * x for x in late[0].embedding) - 1) < 1e-9
    failing = semantic.late_chunks(docs, lambda t: 1 / 0, 3, 1).collect()
    assert [(r.text, r.embedding) for r in failing] == [("one two three", None), ("three four", None)]
    hits = spark.createDataFrame([(1, "abc", 7, "xyz. abc abc. zzz. ab."), (1, "abc", 8, "one")], "query long, question string, doc long, text string")
    assert {r.doc: r.text for r in semantic.compress(hits, letters, 2).collect()} == {7: "abc abc ab.", 8: "one"}
    assert {r.doc: r.text for r in semantic.compress(hits, letters, budget=1).collect()}[7] == "abc abc"


def test_mixtures():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in (-3, 0, 3)])
    r, _ = tree.mixture(x, 3)
    assert len({tuple(sorted(set(r.argmax(1)[i : i + 40].tolist()))) for i in (0, 40, 80)}) == 3 and np.allclose(r.sum(1), 1)
    of = tree.clusters(x)
    assert all(len(set(of[i : i + 40].tolist())) == 1 for i in (0, 40, 80)) and len(set(of.tolist())) == 3
    bics = {k: tree.mixture(x, k)[1] for k in (1, 2, 3)}
    assert min(bics, key=bics.get) == 3
    assert tree.cluster_count(250, {2: 5.0, 4: 1.0}) == 4 and tree.cluster_count(250, most=2) == 3 and tree.cluster_count(5000) == 50 and tree.cluster_count(2, {2: 0.0}) == 1 and tree.cluster_count(250, most=7) == 7
    nodes = tree.build([f"t{i}" for i in range(120)], x, lambda t: f"<{len(t)}>", lambda ts: [[float(i), 0.0, 0.0] for i in range(len(ts))])
    assert sum(len(c) for lv, _, _, c in nodes if lv == 1) == 120 and [n for _, n, _, _ in nodes] == list(range(len(nodes)))


def test_leiden(spark):
    cliques = [(5 * c + i, 5 * c + j, 1.0) for c in range(6) for i in range(5) for j in range(i)]
    ring = [(5 * c, (5 * c + 5) % 30, 1.0) for c in range(6)]
    of = communities.leiden(cliques + ring + [(3, 3, 9.0)])
    assert all(len({of[5 * c + i] for i in range(5)}) == 1 for c in range(6)) and len(set(of.values())) == 6
    rng = random.Random(3)
    for _ in range(20):
        edges = [(rng.randrange(25), rng.randrange(25), rng.random()) for _ in range(60)]
        got = communities.leiden(edges)
        real = [(a, b, w) for a, b, w in edges if a != b]
        alone = {x: i for i, x in enumerate(got)}
        assert communities.modularity(real, got) >= communities.modularity(real, alone) - 1e-9 and got == communities.leiden(edges)
        for c in set(got.values()):
            some = {x for x in got if got[x] == c}
            seen, todo = {min(some)}, [min(some)]
            while todo:
                x = todo.pop()
                for a, b, _ in real:
                    for u, v in ((a, b), (b, a)):
                        if u == x and v in some - seen:
                            seen.add(v), todo.append(v)
            assert seen == some
    df = spark.createDataFrame([(a, b) for a, b, _ in cliques], "src long, dst long")
    parts = spark.createDataFrame([(i, i // 5) for i in range(30)], "node long, component long")
    assert len({(r.component, r.community) for r in communities.communities(df, parts).collect()}) == 6


def test_answers():
    said = []
    model = lambda p: said.append(p) or ("not found" if "zzz" in p else f"a{len(said)}")
    assert answers.map_reduce("q", ["x", "zzz", "y"], model) == "a4" and answers.map_reduce("q", ["zzz"], lambda p: "Not found.") == "not found"
    assert answers.refine("q", ["x", "y"], lambda p: p.replace("\n\n", "|")) == "q|q|x|y" and answers.engine("chat")("q", ["x"], lambda p: p) == "q\n\nx"
    with pytest.raises(ValueError):
        answers.engine("none")
    found = {"q": [("t1", 0.5)], "weak bit": [("t2", 0.9), ("t1", 0.1)]}
    texts = iter(["weak bit", "sure"])
    got, held = answers.active("q", lambda p: next(texts), lambda s: 0.1 if "weak" in s else 1.0, lambda q: found.get(q, []))
    assert got == "sure" and held == [("t2", 0.9), ("t1", 0.5)]
    assert answers.confidence("a", ["x"], lambda p: "about 1.7") == 1.0 and answers.confidence("a", [], lambda p: "?") == 1.0 and answers.confidence("a", [], lambda p: "-2") == 0.0
    plan = iter(['{"sufficient": false, "queries": ["weak bit"]}', '{"sufficient": true}'])
    assert answers.research("q", lambda q: found[q], lambda p: next(plan)) == [("t2", 0.9), ("t1", 0.5)]
    made = iter(["x", " ", "y"])
    assert answers.hypothetical("q", lambda p: next(made), lambda ts: [[3.0, 0.0], [0.0, 4.0]][: len(ts)]) == pytest.approx([0.6, 0.8])
    assert answers.hypothetical("q", lambda p: 1 / 0, lambda ts: [[1.0, 2.0]]) == [1.0, 2.0]
    assert answers.self_query("q", lambda p: '{"query": "x", "filter": {"lang": "en", "bad": 1}}', ["lang"]) == ("x", {"lang": "en"}) and answers.self_query("q", lambda p: "?", []) == ("q", {})
    assert answers.metadata('{"a": "1", "b": 2, "c": "3"}', {"a": "0"}, ["a", "b"]) == {"a": "0"} and answers.metadata(None, {"k": "v"}) == {"k": "v"}
    assert answers.propositions("p", lambda p: '["a ", "", 3]') == ["a"] and answers.propositions("p", lambda p: 1 / 0) == ["p"]
    assert answers.resume("t", lambda p: '{"contact": {"name": "N"}, "skills": ["a", "b"], "work": ["w1", "w2"]}') == [("contact", "name: N"), ("work", "w1"), ("work", "w2"), ("skills", "a, b")] and answers.resume("t", lambda p: "") == [("text", "t")]
    assert answers.mind_map('{"topic": "a", "subtopics": [{"topic": "b", "subtopics": [{"topic": "c"}]}, {"topic": ""}]}') == (["a", "b", "c"], [("a", "b"), ("b", "c")])
    assert answers.redact_by_model("x", lambda p: "", str.upper) == "X" and answers.summary([], str, "old") == "old" and answers.relevance([1.0], [[1.0], [-1.0]], False) == 0.0
    assert answers.judged('{"a": 2, "b": 0.5}', ["a", "b"]) == {"a": 1.0, "b": 0.5} and answers.judged('{"a": true}', ["a"]) is None
    assert list(answers.stream(["s"], "xy")) == [("sources", ["s"]), ("delta", "x"), ("delta", "y")]


def test_models_in_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, prompt string")
    got = {r.id: r.reply for r in answers.replies(df, lambda p: p.upper() if p == "a" else 1 / 0).collect()}
    assert got == {1: "A", 2: None, 3: None}
    hits = spark.createDataFrame([(1, "q", d, "x" * d, 1.0) for d in range(1, 8)], "query long, question string, doc long, text string, score double")
    best = answers.rerank(hits, lambda q, t: [len(x) - 4 for x in t], 3, batch=2).orderBy("rank").collect()
    assert [r.doc for r in best] == [7, 6, 5] and best[0].relevance == pytest.approx(1 / (1 + math.exp(-3))) and best[0].score == 1.0
    chunks = spark.createDataFrame([("a", None), ("b", [1.0]), ("c", None)], "text string, embedding array<double>")
    assert {r.text: r.embedding for r in ingest.embedded(chunks, lambda ts: [[float(len(ts))]] * len(ts), 1).collect()} == {"a": [1.0], "b": [1.0], "c": [1.0]}


def test_requests_and_polls():
    assert governance.SearchOptions().faults() == [] and len(governance.SearchOptions(top_k=0, mmr_lambda=2, rrf_k=0).faults()) == 3 and governance.SearchOptions(mmr_candidates=3).faults()
    seen = []

    def apply(x):
        seen.append(x)
        if len(seen) == 2:
            raise RuntimeError("once")

    assert events.polled(None, lambda s: 1, apply, 3, wait=lambda s: None) == ["once"] and len(seen) == 3


def test_states_and_caches(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, hash string, at long")
    more = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id long, hash string, at long")
    assert {(r.id, r.hash) for r in ingest.merged_state(old, more, ["id"], "at").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    e = spark.createDataFrame([(" Ann ", "PERSON", "x" * 600), ("", "PERSON", "y"), ("Bob", "dog", None)], "name string, type string, description string")
    assert [(r.name, len(r.description)) for r in entities.clean(e, ["person"]).collect()] == [("Ann", 500)] and entities.clean(e).count() == 2
