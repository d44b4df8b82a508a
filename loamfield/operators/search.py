"""Scoring and fusion: BM25, sparse dot products, exact nearest neighbours, reciprocal ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamfield.functions.text import tokens
from loamfield.session import spread
from loamfield.staging import staged

K1, B = 1.5, 0.75


#: Distinct query terms, and (query, term) rows, that are broadcast; more of them are joined by shuffle.
MOST_TERMS = 200_000
#: Scores by query and document that a task adds up, or so.
SUMS = 1 << 21
#: Pairs of vectors that a task of :func:`dense` scores at a time.
SCORES = 1 << 19


def token_table(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, t, len: each text's tokens."""
    t = spread(docs.select(doc, text), doc).select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("t"))
    return t.withColumn("len", F.size("t"))


def _tokens_of(docs: DataFrame) -> DataFrame:
    return docs if docs.columns == ["doc", "t", "len"] else token_table(docs)


def document_counts(docs: DataFrame) -> DataFrame:
    """term, df of texts or of a token table: only terms and counts are shuffled."""
    return _tokens_of(docs).select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def small(df: DataFrame, most: int):
    """``df``, and how to join it: rows in hand and broadcast where there are ``most`` at most, else a written table to shuffle."""
    rows = df.limit(most + 1).collect()
    if len(rows) <= most:
        return df.sparkSession.createDataFrame(rows, df.schema), F.broadcast
    return staged(df, "query-terms"), lambda x: x


def bm25_weight(n, df, tf, length, mean, k1: float = K1, b: float = B):
    """What a term adds to a document's score."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def top(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with ``rank`` from 1; ties go to the smaller ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, groups: DataFrame | None = None) -> DataFrame:
    """query, doc, score, rank. ``docs``: doc_id, text, or a :func:`token_table`; ``queries``: query, text; a query's tokens count
    once. Only postings of query terms are joined.

    ``groups`` (group_id, term) are synonyms: texts and queries gain the other members of each token's groups, which
    count in a document's length too.
    """
    t = _tokens_of(docs)
    if groups is not None:
        q, few = small(expanded(queries.select("query", tokens(F.col("text")).alias("t")), groups).distinct(), MOST_TERMS)
        n = t.count()
        ways = dealt(n, q)
        asked = few(q.select("term").distinct().withColumn("asked", F.lit(True)))
        # all other tokens of a text count as one term, null, so one pass gives lengths and counts of query terms
        own = expanded(t.select("doc", "t"), groups).join(asked, "term", "left").select("doc", F.when(F.col("asked"), F.col("term")).alias("term"))
        own = own.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
        lens = F.sum("tf").over(Window.partitionBy("doc"))
        own = staged(own.repartition(ways, "doc").withColumn("len", lens), "term-counts")
        total = own.agg(F.sum("tf")).first()[0]
        tf = own.filter("term is not null")
    else:
        q = queries.select("query", F.explode(tokens(F.col("text"))).alias("term"))
        q, few = small(q.distinct(), MOST_TERMS)
        n, total = t.agg(F.count(F.lit(1)), F.sum("len")).first()
        ways = dealt(n, q)
        # of all tokens only those of query terms leave a task
        met = t.select("doc", "len", F.explode("t").alias("term")).join(few(q.select("term").distinct()), "term", "left_semi")
        tf = staged(met.repartition(ways, "doc").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len")), "term-counts")
    df = few(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # no more terms than the queries have
    gain = bm25_weight(F.lit(n), F.col("df"), F.col("tf"), F.col("len"), F.lit((total or 0) / max(n, 1)), k1, b)
    scored = tf.join(df, "term").select("doc", "term", gain.alias("s"))
    hits = scored.repartition(ways, "doc").join(few(q), "term").groupBy("query", "doc").agg(F.round(F.sum("s"), 6).alias("score"))  # summed where they are
    return top(hits, ["query"], "score", "doc", k)


def dealt(n: int, q: DataFrame) -> int:
    """Tasks for the sums of ``n`` documents' scores by query (q: query and others): none has more than some ``SUMS``."""
    asking = q.select("query").distinct().count()
    return min(20_000, max(q.sparkSession.sparkContext.defaultParallelism, -(-n * asking // SUMS)))


def sparse(docs: DataFrame, queries: DataFrame, k: int = 10, terms: int = 256) -> DataFrame:
    """query, doc, score, rank by the dot product of ln(1 + tf) weights; each text keeps its heaviest ``terms`` terms (ties: the
    smaller), which are found within its row."""

    def weights(t, wanted=None, ways=None):
        s = t.filter("size(t) > 0").withColumn("s", F.when(F.size(F.array_distinct("t")) > terms, F.sort_array("t")))
        s = s.withColumn("at", F.expr("filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> s[i - 1])"))
        s = s.withColumn("x", F.expr("transform(at, (b, j) -> struct(b - coalesce(get(at, j + 1), size(s)) as neg, s[b] as term))"))
        # few enough terms need no ranking: each of their tokens counts one
        best = F.coalesce(F.slice(F.array_sort("x"), 1, terms), F.expr("transform(t, v -> struct(-1 as neg, v as term))"))
        s = s.select("doc", F.explode(best).alias("x")).select("doc", "x.term", "x.neg")
        s = s if wanted is None else s.join(wanted, "term", "left_semi").repartition(ways, "doc")
        return s.groupBy("doc", "term").agg(F.log1p(-F.sum("neg")).alias("w"))

    q = weights(queries.select(F.col("query").alias("doc"), tokens(F.col("text")).alias("t"))).select(F.col("doc").alias("query"), "term", F.col("w").alias("wq"))
    q, few = small(q, MOST_TERMS)
    t = _tokens_of(docs)
    ways = dealt(t.count(), q)
    met = weights(t, few(q.select("term").distinct()), ways)
    hits = met.repartition(ways, "doc").join(few(q), "term").groupBy("query", "doc").agg(F.round(F.sum(F.col("w") * F.col("wq")), 6).alias("score"))
    return top(hits, ["query"], "score", "doc", k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, least: float | None = None, match: str | None = None) -> DataFrame:
    """query, doc, score, rank: exact cosine neighbours (0 where a norm is 0 or dimensions differ).

    ``vectors``: doc, embedding and ``match``; ``queries``: query, embedding and ``match`` (rows must agree on it).
    Queries go out in blocks of ``block``, so what is sent is bounded; a task scores ``SCORES`` pairs at a time and keeps its own
    k best of each query, so the shuffle holds k rows for each query and task.
    """
    spark = vectors.sparkSession
    cols = [F.col("doc").cast("long").alias("doc"), "embedding"] + ([match] if match else [])
    n = queries.count()
    numbered = queries.withColumn("part_", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-n // block)))))
    out = None
    for i in range(max(1, -(-n // block))):
        rows = numbered.filter(F.col("part_") == i).collect()
        held = spark.sparkContext.broadcast(([r["query"] for r in rows], [r["embedding"] for r in rows], [r[match] if match else None for r in rows]))

        def run(batches, held=held):
            ids, vecs, tags = held.value
            by: dict[int, list[int]] = {}
            for j, v in enumerate(vecs):
                by.setdefault(len(v) if v is not None else 0, []).append(j)
            asked = {d: np.array([vecs[j] for j in js], np.float64) for d, js in by.items() if d}
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # k docs and scores of each query
            for b in batches:
                lists, docs = b.column("embedding"), b.column("doc").to_numpy(zero_copy_only=False)
                dims = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                tag = np.array([*b.column(match).to_pylist(), None], object)[:-1] if match else None
                for d, q in asked.items():
                    at = np.flatnonzero(dims == d)
                    if not len(at):
                        continue
                    m = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
                    long, doc = np.linalg.norm(m, axis=1), docs[at]
                    agree = {t: np.flatnonzero(tag[at] == t) for t in {tags[j] for j in by[d]} if t is not None} if match else {}
                    step = max(1, SCORES // len(at))
                    for a in range(0, len(q), step):
                        x = q[a : a + step]
                        norm = np.linalg.norm(x, axis=1)[:, None] * long[None]
                        score = np.round(np.divide(x @ m.T, norm, out=np.zeros(norm.shape), where=norm > 0), 6)
                        for row, j in zip(score, by[d][a : a + step], strict=True):
                            ok = agree.get(tags[j], at[:0]) if match else np.arange(len(row))
                            ok = ok if least is None else ok[row[ok] >= least]
                            if len(ok) > k:  # ties of the k-th stay until they are ordered
                                ok = ok[~(-row[ok] > np.partition(-row[ok], k - 1)[k - 1])]
                            old = best.get(j, (docs[:0], row[:0]))
                            some, s = np.concatenate([old[0], doc[ok]]), np.concatenate([old[1], row[ok]])
                            first = np.lexsort((some, -s))[:k]
                            best[j] = some[first], s[first]
            for a in range(0, len(ids), 1024):
                got = [(ids[j], *best[j]) for j in range(a, min(a + 1024, len(ids))) if j in best]
                if got:
                    who = np.repeat(np.array([g[0] for g in got], np.int64), [len(g[1]) for g in got])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([g[1] for g in got]), pa.int64()), pa.array(np.concatenate([g[2] for g in got]))], names=["query", "doc", "score"])

        found = vectors.select(*cols).mapInArrow(run, "query long, doc long, score double")
        out = found if out is None else out.unionByName(found)
    return top(out, ["query"], "score", "doc", k)


def scaled(hits: DataFrame, how: str) -> DataFrame:
    """Cosines on another store's scale: ``certainty`` (1 + c) / 2, ``distance`` 1 - c, or ``cosine`` itself."""
    c = F.col("score")
    return hits.withColumn("score", F.round({"cosine": c, "certainty": (1 + c) / 2, "distance": 1 - c}[how], 6))


def inner(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """query, doc, score, rank by the inner product of sparse vectors (doc or query, term, w); only positive products count,
    of ``least`` at least."""
    q = queries.select("query", "term", F.col("w").alias("wq"))
    hits = vectors.join(q, "term").groupBy("query", "doc").agg(F.round(F.sum(F.col("w") * F.col("wq")), 6).alias("score"))
    return top(hits.filter((F.col("score") > 0) & (F.col("score") >= least)), ["query"], "score", "doc", k)


def pooled_logits(logits: DataFrame, k: int = 256) -> DataFrame:
    """``key, term, w`` of logits (key, window, term, logit): the greatest positive one of each term over all tokens and
    windows as ln(1 + x), the k heaviest terms (ties: the smaller)."""
    w = logits.filter("logit > 0").groupBy("key", "term").agg(F.log1p(F.max("logit")).alias("w"))
    return top(w, ["key"], "w", "term", k).select("key", "term", "w")


def lookup(chunks: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The chunks that have one of the keys; keys without a chunk are left out."""
    return chunks.join(keys.select(on).distinct(), on, "left_semi").select(chunks.columns)


def fuse(lists: list[tuple[DataFrame, float]], k: int = 10, c: int = 60) -> DataFrame:
    """query, doc, score, rank by weighted reciprocal ranks of the lists (query, doc, rank from 1)."""
    every = None
    for hits, weight in lists:
        part = hits.select("query", "doc", (F.lit(float(weight)) / (max(1, c) + F.col("rank"))).alias("w"))
        every = part if every is None else every.unionByName(part)
    return top(every.groupBy("query", "doc").agg(F.round(F.sum("w"), 9).alias("score")), ["query"], "score", "doc", max(k, 0))


def best_of(lists: list[DataFrame], k: int = 10) -> DataFrame:
    """Variants of a query merged: the greatest score of each document."""
    every = lists[0].select("query", "doc", "score")
    for hits in lists[1:]:
        every = every.unionByName(hits.select("query", "doc", "score"))
    return top(every.groupBy("query", "doc").agg(F.max("score").alias("score")), ["query"], "score", "doc", k)


def synonyms(toks: DataFrame, groups: DataFrame) -> DataFrame:
    """``toks`` (key, term) with the other members of each term's groups (group_id, term) added."""
    pairs = groups.alias("a").join(groups.alias("b"), "group_id").filter("a.term <> b.term").select(F.col("a.term").alias("term"), F.col("b.term").alias("more")).distinct()
    return toks.unionByName(toks.join(pairs, "term").select(*[F.col("more").alias("term") if c == "term" else c for c in toks.columns]))


def expanded(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """``key, term`` of texts (key, t: array of tokens): the tokens, and the tokens of every other member of the groups
    (group_id, term) that a token or a phrase of neighbouring tokens belongs to, however long the phrase."""
    key = texts.columns[0]
    g = groups.select("group_id", F.lower("term").alias("term"))
    pairs = g.alias("a").join(g.alias("b"), "group_id").filter("a.term <> b.term").select(F.col("a.term").alias("term"), F.col("b.term").alias("other")).distinct()
    pairs, few = small(pairs.select("term", F.explode(tokens(F.col("other"))).alias("more")).groupBy("term").agg(F.collect_list("more").alias("more")), MOST_TERMS)
    longest = groups.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1

    def phrases(n):
        one = lambda i: F.struct(F.concat_ws(" ", *[F.get("t", i + j) for j in range(n)]).alias("term"), F.lit(False).alias("own"))
        return F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(0), F.size("t") - n), one)).otherwise(F.array().cast("array<struct<term: string, own: boolean>>"))

    spans = F.concat(F.transform("t", lambda v: F.struct(v.alias("term"), F.lit(True).alias("own"))), *[phrases(n) for n in range(2, longest + 1)])
    each = texts.filter("size(t) > 0").select(key, F.explode(spans).alias("x")).select(key, "x.term", "x.own").join(few(pairs), "term", "left")
    terms = F.when(F.col("own"), F.when(F.col("more").isNull(), F.array("term")).otherwise(F.concat(F.array("term"), "more"))).otherwise(F.col("more"))
    return each.filter("own or more is not null").select(key, F.explode(terms).alias("term"))


def federate(stores: list[DataFrame], k: int = 10, c: int = 60) -> DataFrame:
    """query, doc, score, store, rank: hits of several stores by reciprocal ranks; ties go to the better own score, then the
    earlier store, then the earlier rank."""
    every = None
    for i, hits in enumerate(stores):
        part = hits.select("query", "doc", "score", "rank", F.lit(i).alias("store"))
        every = part if every is None else every.unionByName(part)
    first = F.min(F.struct((-F.col("score")).alias("s"), "store", "rank"))
    merged = every.groupBy("query", "doc").agg(F.round(F.sum(1 / (c + F.col("rank"))), 9).alias("score"), first.alias("x"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "x.s", "x.store", "x.rank", "doc")
    return merged.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query", "doc", "score", F.col("x.store").alias("store"), F.col("place").alias("rank"))


def tags(hits: DataFrame, names: DataFrame, k: int = 1) -> DataFrame:
    """query, key, doc: the k keys with the best hits, each with its first value. ``names``: doc, key."""
    met = hits.join(names, "doc").withColumn("r", F.row_number().over(Window.partitionBy("query", "key").orderBy("rank"))).filter("r = 1")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter(F.col("r") <= k).select("query", "key", "doc")


def pooled(hits: DataFrame, owner, k: int = 10) -> DataFrame:
    """query, doc, score, rank of whole documents: the best of their chunks; ``owner`` gives a chunk's document."""
    return top(hits.groupBy("query", owner.alias("doc")).agg(F.max("score").alias("score")), ["query"], "score", "doc", k)
