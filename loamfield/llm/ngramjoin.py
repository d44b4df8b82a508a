"""Similarity join of documents on word shingles, with several global token orders.

Two sets with Jaccard similarity of at least t share a token among the first n - ceil(t n) + 1 tokens of each, whatever
order of all tokens is taken. So candidates have to meet in the prefixes of *every* order, and the orders are
intersected before anything is verified:

1. Equal sets are one class. A class with n - ceil(t n) + 1 tokens that no other class has can't link at all; the
   tokens below a bound of the hash prove that for most classes with little data. The bound falls with the size of the
   set, so a token counts only if it is below the bound of the largest set that could link: each partner shows it too.
2. Among the rest, the rarest-first order: prefix tokens that two classes share hold them together in a block.
3. Inside a block, candidates meet in the rarest-first prefix; prefixes by ascending and by descending hash must meet
   too; then the overlap is counted exactly, unless a link path joins the two already.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamfield.llm.common import split_by_partner, staged

U = np.uint64
#: Bits of a token in the proof that a class stands alone; a collision only weakens the proof.
PROOF_BITS = 44
#: Sets of fewer tokens show all of them for the proof.
PROOF_WHOLE = 80


@dataclass(frozen=True)
class Params:
    """Shingles of ``size`` words; sets link when 100 * intersection >= ``percent`` * union."""

    size: int = 5
    percent: int = 80

    def prefix(self, n):
        """Tokens of a set of n among which it shares one with any set that it links with."""
        return n - -(-self.percent * n // 100) + 1

    @property
    def proof_below(self) -> int:
        """Bound of the tokens that a large set shows for the proof: about twice its prefix."""
        return (1 << PROOF_BITS) * min(100, 2 * (100 - self.percent) + 2) // 100


CONTRACT = Params(4, 85)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes, ascending. Fewer words than ``size``: the whole sequence is one; no words: none."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, U)
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(w), len(w))], U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), U, len(w))
    n = len(h) - size + 1
    x = h[:n] * U(0x9E3779B97F4A7C15)
    for i in range(1, size):
        x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) + h[i : n + i]
    x = (x ^ (x >> U(32))) * U(0x94D049BB133111EB)
    return np.unique(x ^ (x >> U(29)))


def _sketches(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, tk, n, fp1, fp2 (together the set's 128-bit fingerprint) and the part of its tokens for the proof."""
    schema = "doc_id long, tk long, n long, fp1 long, fp2 long, part array<long>"
    kind = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("part", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            ns, one, two, parts = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), p.size)
                d = xxhash.xxh3_128_digest(s.tobytes())
                ns.append(len(s))
                one.append(int.from_bytes(d[:8], "little", signed=True))
                two.append(int.from_bytes(d[8:], "little", signed=True))
                v = (s >> U(64 - PROOF_BITS)).astype(np.int64)
                parts.append(v if len(v) < PROOF_WHOLE else v[: np.searchsorted(v, p.proof_below)])
            at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tk"), pa.array(ns, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(at, flat)], schema=kind)

    return docs.mapInArrow(run, schema)


def _full_sets(texts: DataFrame, p: Params) -> DataFrame:
    """cid, n, tokens (array of long) from cid, text."""
    kind = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                sets = [shingles(t.as_py(), p.size).view(np.int64) for t in c.column("text")]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([c.column("cid"), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(sets))], schema=kind)

    return texts.mapInArrow(run, "cid long, n long, tokens array<long>")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, root`` (the smallest node of its component) for all nodes of ``edges`` (a, b): large stars and small stars.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest; rounds grow with the
    logarithm of the longest path. All stays distributed and each round is a written table. Rounds go on until nothing
    changes; RuntimeError if ``rounds`` don't do.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't stable after {rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _verify(cids: np.ndarray, sets: list[np.ndarray], p: Params) -> np.ndarray:
    """The smallest cid that each set of a block is linked with, through links."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((cids, size))
    cids, sets, size = cids[order], [sets[i] for i in order], size[order]
    flat = np.concatenate(sets)
    names, dense, df = np.unique(flat, return_inverse=True, return_counts=True)
    at = np.concatenate([[0], np.cumsum(size)])
    need = p.prefix(size)
    orders = []
    for key in ((np.arange(len(names)), df), (np.arange(len(names)),), (-np.arange(len(names)),)):
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort(key)] = np.arange(len(names))
        orders.append([np.sort(rank[dense[at[i] : at[i + 1]]])[: need[i]] for i in range(n)])
    root = np.arange(n)
    index: dict[int, list[int]] = {}
    mark = np.zeros(len(names), bool)
    for x in range(n):
        met = [index[t] for t in orders[0][x].tolist() if t in index]
        if met:
            cand = np.unique(np.concatenate([np.asarray(m) for m in met]))
            cand = cand[(100 * size[cand] >= p.percent * size[x]) & (root[cand] != root[x])]
            for o in orders[1:]:
                if len(cand):
                    mark[o[x]] = True
                    cand = cand[[bool(mark[o[c]].any()) for c in cand]]
                    mark[o[x]] = False
            mark[dense[at[x] : at[x + 1]]] = True
            for k in range(0, len(cand), 256):
                some = cand[k : k + 256]
                some = some[root[some] != root[x]]
                if not len(some):
                    continue
                rows = np.concatenate([dense[at[c] : at[c + 1]] for c in some])
                same = np.add.reduceat(mark[rows].astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
                for c in some[same * (100 + p.percent) >= p.percent * (size[some] + size[x])]:
                    if root[c] != root[x]:
                        root[root == root[c]] = root[x]
            mark[dense[at[x] : at[x + 1]]] = False
        for t in orders[0][x].tolist():
            index.setdefault(t, []).append(x)
    least: dict[int, int] = {}
    for c, r in zip(cids.tolist(), root.tolist(), strict=True):
        least[r] = min(c, least.get(r, c))
    out = np.array([least[r] for r in root.tolist()], np.int64)
    back = np.empty(n, np.int64)
    back[order] = out
    return back


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, tk, n_shingles, component_id`` for each row of ``docs`` (doc_id, text); tk tells apart the texts of a
    repeated doc_id.

    Null text and text without words have no shingles and stand alone. Words are parted by ASCII white space, A-Z is
    lower-cased. component_id is the smallest doc_id that links reach, the document's own included; a null doc_id
    counts only where there is no other. Repeated rows are equal sets. An empty table gives none.
    """
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tk"), "text")
    every = staged(_sketches(docs, p), "sketches")
    classes = every.filter("n > 0").groupBy("fp1", "fp2").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tk")).alias("rep"), F.first("part").alias("part"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    prefix = F.col("n") - F.ceil(F.lit(p.percent) * F.col("n") / 100) + 1

    small = 100 * F.col("n") < F.lit(p.percent * PROOF_WHOLE)  # all that could link show all their tokens
    each = classes.select("cid", small.alias("small"), F.explode(F.array_distinct("part")).alias("t"))
    tokens = each.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("cid").alias("cid"), F.min("small").alias("small"))
    alone = tokens.filter("c = 1").filter(F.col("small") | (F.col("t") < p.proof_below)).groupBy("cid").agg(F.count(F.lit(1)).alias("alone"))
    alive = classes.select("cid", "n", "rep").join(alone, "cid", "left").filter(F.coalesce("alone", F.lit(0)) < prefix)
    alive = alive.select("cid", F.col("rep.doc_id").alias("d_"), F.col("rep.tk").alias("t_"))
    alive = staged(alive, "alive")
    some, _ = split_by_partner(docs, F.col("tk"), alive, F.col("t_"))
    texts = some.join(alive, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("tk") == F.col("t_"))).select("cid", "text")
    sets = staged(_full_sets(texts, p).dropDuplicates(["cid"]), "sets")

    each = sets.select("cid", F.explode("tokens").alias("t"))
    shared = each.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranks = each.join(shared, "t").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("by_df"))  # bounded by the set
    heads = sets.select("cid", "n").join(ranks, "cid").withColumn("take", prefix - (F.col("n") - F.size("by_df"))).filter("take > 0")
    posts = staged(heads.select("cid", F.explode(F.slice("by_df", F.lit(1), F.col("take").cast("int"))).alias("x")).select("cid", F.col("x.t").alias("t")), "postings")
    hubs = posts.groupBy("t").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("t", "hub")
    blocks = staged(components(posts.join(hubs, "t").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()), "blocks")

    def check(group: pd.DataFrame) -> pd.DataFrame:
        cids = group["cid"].to_numpy(np.int64)
        return pd.DataFrame({"cid": cids, "head": _verify(cids, [np.asarray(t, np.int64) for t in group["tokens"]], p)})

    linked = sets.join(blocks, sets["cid"] == blocks["node"]).select("cid", "root", "tokens").groupBy("root").applyInPandas(check, "cid long, head long")
    heads = classes.select("cid", "fp1", "fp2", "least").join(staged(linked, "linked"), "cid", "left").withColumn("head", F.coalesce("head", "cid"))
    best = heads.groupBy("head").agg(F.min("least").alias("component_id"))
    ids = heads.select("head", "fp1", "fp2").join(best, "head").select("fp1", "fp2", "component_id")
    out = every.select("doc_id", "tk", "n", "fp1", "fp2").join(ids, ["fp1", "fp2"], "left")
    return out.select("doc_id", "tk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, CONTRACT).drop("tk")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; the columns of ``docs``.

    Rows that repeat doc_id and text stay or go together. A group without any doc_id stays whole.
    """
    found = near_duplicates(docs.select("doc_id", "text"), Params())
    gone = found.filter("not (doc_id <=> component_id)").select(F.col("doc_id").alias("g_"), F.col("tk").alias("k_")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.xxhash64("doc_id", "text").alias("tk_"), F.col("doc_id").alias("d_"))
    gone = staged(gone, "gone")
    some, rest = split_by_partner(rows, F.col("tk_"), gone, F.col("k_"))
    kept = some.join(gone, F.col("d_").eqNullSafe(F.col("g_")) & (F.col("tk_") == F.col("k_")), "left_anti")
    return kept.unionByName(rest).select("row_.*")
