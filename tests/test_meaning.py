"""Groups of sentences by expressions against the loop over sentences."""

import random

import pytest

from loamfield.operators import semantic


def _letters():
    def count(texts):  # within a function, so that workers get it by value
        return [[float(t.count(c)) for c in "abxyz"] for t in texts]

    return count


letters = _letters()


@pytest.mark.parametrize(("percentile", "least", "most"), [(0.25, 30, 80), (0.5, 1, 20), (0.9, 60, 1500), (0.0, 25, 40)])
def test_against_the_loop(spark, percentile, least, most):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abxyz") for _ in range(rng.randint(1, 9)))
    texts = [". ".join(" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(n)) for n in [1, 2, 3, 5, 8, 13, 40, 90] for _ in range(4)]
    texts += ["", None, " ! ", "same. same. same. same", "q. q. q", "Dr. No came. He left! ü ü. " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sorted(semantic.meaning_chunks(docs, letters, percentile, least, most).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        assert r.first == sum(r.n_sentences for r in got.get(r.doc_id, [])) and r.chunk_index == len(got.get(r.doc_id, []))
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        parts = semantic.split_sentences(t or "")
        want = semantic.groups(parts, letters(parts), percentile, least, most)
        assert [(r.n_sentences, r.text) for r in got.get(i, [])] == [(len(g), " ".join(g)) for g in want], i


def test_given_vectors_and_other_columns(spark):
    rows = [(1, "ab. ab. xy. xy", [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]], "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, vectors array<array<double>>, spans string")
    got = semantic.meaning_chunks(docs, None, 0.5, 1).orderBy("chunk_index").collect()
    assert [(r.first, r.n_sentences, r.text) for r in got] == [(0, 2, "ab ab"), (2, 2, "xy xy")]
    assert semantic.meaning_chunks(docs.limit(0), None).count() == 0


def test_spans_are_computed_once(spark):
    docs = spark.createDataFrame([(1, "ab. ab. xy", [[1.0, 0.0]] * 3), (2, "", []), (3, None, None)], "doc_id long, text string, vectors array<array<double>>")
    got = semantic.meaning_chunks(docs.repartition(2, "doc_id"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "aggregate(" in x]
    assert [(r.doc_id, r.text) for r in got.collect()] == [(1, "ab ab xy")]
