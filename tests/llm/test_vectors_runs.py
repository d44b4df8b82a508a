"""Whitening, periodic runs and exact search, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamfield.llm import periodicity, topk, whitening
from loamfield.llm.vectors import integers

SCHEMA = "vec_id long, embedding array<double>, score long, rank int, x string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "y") for i, v in rows], SCHEMA)


ODD = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [0.5, -0.25])]


# 11 --------------------------------------------------------------------------------------------------------------
def test_limb_sums_are_exact():
    rng = np.random.default_rng(3)
    for top in (300, 1 << 25, 1 << 44, (1 << 63) - 1):
        x = rng.integers(-top, top, (9000, 5), dtype=np.int64)
        sums = whitening.Sums(5)
        sums.add(x[:4000])
        sums.add(x[4000:])
        sums.rows()
        o = x.astype(object)
        assert (sums.products == o.T @ o).all() and (sums.sums == o.sum(axis=0)).all() and sums.n == 9000


def test_limb_sums_settle(monkeypatch):
    monkeypatch.setattr(whitening, "HELD", 2)
    monkeypatch.setattr(whitening, "SLAB", 7)
    x = np.random.default_rng(4).integers(-(2**40), 2**40, (100, 3), dtype=np.int64)
    sums = whitening.Sums(3)
    sums.add(x)
    sums.rows()
    o = x.astype(object)
    assert (sums.products == o.T @ o).all()


def test_eigen_and_rank():
    rng = np.random.default_rng(5)
    a = rng.integers(-1000, 1000, (6, 6))
    m = (a @ np.diag([10**6, 5000, 100, 10, 0, 0]) @ a.T).astype(object)
    assert whitening.rank(m) == 4
    e, x = whitening.eigen(m, 7)
    f = m.astype(np.float64) / 7
    assert np.allclose(x.T @ x, np.eye(6), atol=1e-14) and (np.diff(e) <= 0).all()
    assert np.allclose(f @ x, x * e, atol=1e-12 * e[0])
    assert whitening.rank(np.zeros((3, 3), object)) == 0


def brute_whitening(rows):
    x = [tuple(int(np.floor(256 * c)) for c in v) for v in rows]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit)]
    a = np.array(fit, np.float64)
    c = a - a.mean(axis=0)
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    dev = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x]
    proj = (np.array(x, np.float64) - a.mean(axis=0)) @ w[:, :4] / np.sqrt(e[:4])
    return n, dev, proj, e[:4] / e.sum()


def run11(spark, monkeypatch, rows):
    monkeypatch.setattr(whitening, "read", lambda s, d, name: vectors(spark, rows))
    return whitening.op11(spark, "")


def test_whitening(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = (rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.3, 0.1]).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[7]) for i in range(50)]
    got = run11(spark, monkeypatch, rows + [(1, None), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (4, [float("nan")] * 6), (5, [float("-inf")] + [0.0] * 5)]).collect()
    n, dev, proj, share = brute_whitening([v for _, v in rows])
    assert len(got) == 4 * len(rows)
    at = {i: k for k, (i, _) in enumerate(rows)}
    signs = {}
    for r in got:
        k, c = at[r.vec_id], r.component
        assert (r.n, r.deviation) == (n, dev[k])
        assert abs(r.explained / share[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        signs.setdefault(c, np.sign(r.whitened * proj[k, c - 1]))
        assert abs(r.whitened * signs[c] - proj[k, c - 1]) < 1e-8


def test_whitening_of_odd_tables(spark, monkeypatch):
    assert run11(spark, monkeypatch, []).collect() == []
    assert run11(spark, monkeypatch, ODD[:1] + ODD[2:5]).collect() == []
    assert run11(spark, monkeypatch, ODD[1:2]).collect() == []  # no dimension, no component
    same = run11(spark, monkeypatch, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in same)
    line = run11(spark, monkeypatch, [(i, [float(i), 2.0 * i]) for i in range(9)] + [(None, [1.0, 2.0])]).collect()
    assert len(line) == 20 and all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    assert {r.explained for r in line if r.component == 2} == {0.0}
    huge = run11(spark, monkeypatch, [(i, [1e12 * i, 3.0 * (i % 2)]) for i in range(5)]).collect()
    assert all(abs(r.identity_error) < 1e-4 for r in huge)
    assert {r.deviation for r in huge if r.vec_id == 0} == {None}


# 12 --------------------------------------------------------------------------------------------------------------
def brute_runs(w, least=6, times=4):
    n, out = len(w), {}
    for p in range(1, n):
        i = p
        while i < n:
            s = i
            while i < n and w[i] == w[i - p]:
                i += 1
            if i > s and i - s + p >= max(least, times * p):
                out.setdefault((s - p, i), p)
            i += 1
    return sorted((a, b - a, p) for (a, b), p in out.items())


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (5, 3), (1, 2), (12, 3)])
def test_runs(least, times):
    rng = random.Random(least * 10 + times)
    texts = []
    for _ in range(1500):
        n, k = rng.randrange(60), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 4:
            a, p = rng.randrange(n), rng.randrange(1, 6)
            for i in range(a, min(n, a + rng.randrange(40))):
                w[i] = w[a + (i - a) % p]
        assert periodicity.runs(w, least, times) == brute_runs(w, least, times)
        texts.append([b"%d" % x for x in w])
    assert periodicity._runs_of(texts, least, times) == [brute_runs(t, least, times) for t in texts]


def test_runs_with_equal_hashes():
    """Words that share a hash make windows longer, not runs."""
    rng = random.Random(8)
    for _ in range(200):
        w = [rng.randrange(4) for _ in range(rng.randrange(6, 50))]
        lo, hi = periodicity.windows(np.zeros(len(w), np.int64), np.zeros(len(w), np.int64))
        found = [r for a, b in zip(lo, hi) for r in ((a + s, n, p) for s, n, p in periodicity.runs(w[a:b]))]
        assert sorted(found) == brute_runs(w)


def test_long_runs():
    assert periodicity.runs([i % 7 for i in range(100_000)]) == [(0, 100_000, 7)]
    assert periodicity.runs([0] * 50_000) == [(0, 50_000, 1)]
    rng = random.Random(9)
    w = [rng.randrange(2) for _ in range(3000)]
    assert periodicity.runs(w, 2, 2) == brute_runs(w, 2, 2)


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(((-m, s, p) for s, m, p in found), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query(spark, docs_of, monkeypatch):
    rng = random.Random(10)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a a a a a a a"), (7, "ünï " * 9 + "çødé 中文 \x00  x"), (7, "go " * 4000), (7, "go " * 4000)]
    rows += [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(80)))) for i in range(10, 400)]
    rows.append((401, ("na " * 12 + "end ") * 30))
    monkeypatch.setattr(periodicity, "read", lambda s, d: docs_of(rows))
    got = [tuple(r)[:8] for r in periodicity.op12(spark, "").collect()]
    assert Counter(got) == Counter(brute_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 20
    monkeypatch.setattr(periodicity, "read", lambda s, d: docs_of([]))
    assert periodicity.op12(spark, "").collect() == []


def test_collapse_returns_texts(docs_of):
    r = periodicity.collapse(docs_of([(1, "x  buy now buy now\nbuy now buy now y")])).first()
    assert r.collapsed == "x buy now y" and [tuple(x) for x in r.runs] == [(1, 8, 2)] and r.n_words == 10


# 13 --------------------------------------------------------------------------------------------------------------
def brute_top(rows, k=10, every=100):
    kept = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for at, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        s = [(-sum(a * b for a, b in zip(x, y)), c is None, c or 0) for j, (c, y) in enumerate(kept) if j != at]
        out += [(q, r + 1, None if none else c, -v) for r, (v, none, c) in enumerate(sorted(s)[:k])]
    return Counter(out)


def run13(spark, rows, **kw):
    x = integers(vectors(spark, rows), topk.SCALE)
    return Counter(tuple(r) for r in topk.search(x.filter(F.col("id") % 100 == 0), x, **kw).collect())


def test_search(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(700, 12)) * np.linspace(2, 0.1, 12) * rng.lognormal(0, 0.7, (700, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(100, rows[100][1]), (100, rows[7][1]), (200, rows[300][1]), (-100, rows[9][1])]
    rows += [(None, rows[5][1]), (1, None), (2, [None] * 12), (900, [float("nan")] * 12), (0, [0.0] * 12)]
    want = brute_top(rows)
    assert run13(spark, rows) == want
    assert run13(spark, rows, block=600) == want  # many cells and blocks


def test_search_among_equals(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(300 + i, [0.0, -1.0]) for i in range(130)]
    assert run13(spark, rows, block=40) == brute_top(rows)


def test_search_of_few_and_huge(spark):
    assert run13(spark, []) == Counter()
    assert run13(spark, [(100, [1.0])]) == Counter()
    assert run13(spark, [(100, [1.0]), (3, [-2.0]), (5, [])]) == brute_top([(100, [1.0]), (3, [-2.0]), (5, [0.0])])
    far = [(0, [1e9, -3e9]), (1, [2e9, 1e8]), (2, [5e8, 5e8]), (3, [-1e9, 1e9])]
    top = (1 << 63) - 1
    assert run13(spark, far) == Counter([(0, r + 1, i, max(-top - 1, min(top, s))) for r, (s, i) in enumerate(sorted([(int(1024e9) * int(1024 * a) + int(-3072e9) * int(1024 * b), i) for i, (a, b) in far[1:]], key=lambda t: (-max(-top - 1, min(top, t[0])), t[1])))])


def test_search_agrees_with_sql(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(260, 8)))]
    rows += [(100, rows[3][1]), (7, None), (8, [1.0, None] * 4)]
    vectors(spark, rows).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "score").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.OP13_SQL})").fetchall()
    assert Counter(tuple(r) for r in topk.op13(spark, str(tmp_path)).collect()) == Counter(want)


def test_every_language_has_a_profile(spark):
    from loamfield.llm import langid

    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join([letters[i % 26] * 3 + letters[i // 26] * 3] * 9), f"l{i}", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(langid.learn(docs, size=12).langs) == 600


def test_toxicity_learns_what_only_pairs_tell():
    """A and B, and C and D, mark a document together; each of them alone is as common in clean documents."""
    from loamfield.llm import toxicity

    rng = random.Random(19)

    def doc(y):
        first, second = ("A", "B") if rng.random() < 0.5 else ("C", "D")
        cross = {"A": "D", "C": "B"}[first]
        marks = [first, second] if y else [first, cross]
        return toxicity.terms(" ".join([*marks, *(f"w{rng.randrange(60)}" for _ in range(12))]))

    labels = np.array([rng.random() < 0.4 for _ in range(3000)], float)
    rows = [doc(y) for y in labels]
    m = toxicity.fit(rows[:2000], labels[:2000])
    flat = toxicity.Machine(m.w0, m.w, np.zeros_like(m.v))

    def auc(machine):
        s, y = np.array([machine.score(r) for r in rows[2000:]]), labels[2000:] == 1
        return (s[y][:, None] > s[~y][None]).mean() + 0.5 * (s[y][:, None] == s[~y][None]).mean()

    assert auc(m) > 0.95 and auc(flat) < 0.7
