"""Toxicity by a factorization machine over hashed terms.

A document is a set of hashed words. The score is the logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j,
with x_i the same for all terms of a document; the pairs let an insult count for more beside a group's name than
either does alone. Rare words that no training document has fall into untrained buckets and add nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamfield.llm.common import documents

BITS = 18
RANK = 6
#: Labelled rows that are learned from, as expected from a hash of doc_id, for each label: the documented bound.
TRAIN_PER_LABEL = 6000
EPOCHS = 12
#: A term counts only if so many training documents have it, and its presence goes with the label beyond chance, alone or in a pair: the
#: chi-square of the two (10.8 is passed by one term in a thousand without any tie). Else the small weights of a long text's
#: ordinary words would add up to more than what marks it.
LEAST_DOCS = 4
LEAST_CHI2 = 10.8
#: Pairs of the so many most frequent terms, of those that at most half of the training documents have, are tested too: two
#: terms stay, if their presence together goes with the label by so much more (chi-square) than that of each.
PAIR_TERMS = 3000
LEAST_PAIR = 80.0
_STRIP = b".,;:!?\"'()[]{}<>*#$%&|-_"


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed words of a text, lower-cased, without punctuation at their ends."""
    if not text:
        return np.zeros(0, np.int64)
    seen = {w.strip(_STRIP) for w in set(text.lower().encode("utf-8", "surrogatepass").split())}
    seen.discard(b"")
    return np.fromiter((xxhash.xxh3_64_intdigest(w) & ((1 << BITS) - 1) for w in seen), np.int64, len(seen))


class Machine:
    """Weights of one trained machine; arrays over hashed terms, so its size doesn't depend on the corpus."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, ids: np.ndarray) -> float:
        ids = ids[self.w[ids] != 0] if len(ids) else ids
        z = self.w0 + float(self.w[ids].sum())
        if len(ids) > 1:
            v = self.v[ids]
            z += 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def _tie(rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Chi-square, with the correction for small counts, of each term's presence and the label."""
    n, n1 = len(rows), float(labels.sum())
    pos = np.zeros(len(seen))
    for r, y in zip(rows, labels, strict=True):
        if y:
            pos[r] += 1
    x, far = seen.astype(np.float64), np.abs(pos * n - seen * n1) - n / 2
    below = x * (n - x) * n1 * (n - n1)
    return np.divide(n * np.maximum(far, 0) ** 2, below, out=np.zeros(len(seen)), where=below > 0)


def _paired(rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Terms that tell something only beside another: an insult is one beside a group's name, and neither is alone."""
    n, n1 = len(rows), float(labels.sum())
    some = np.flatnonzero((seen >= LEAST_DOCS) & (seen <= n / 2))
    some = np.sort(some[np.argsort(-seen[some], kind="stable")[:PAIR_TERMS]])
    if len(some) < 2 or not 0 < n1 < n:
        return some[:0]
    at = np.full(len(seen), -1)
    at[some] = np.arange(len(some))
    both, pos = np.zeros((len(some),) * 2, np.float32), np.zeros((len(some),) * 2, np.float32)
    for a in range(0, n, 1024):  # counts below 2^24 are exact
        x = np.zeros((min(1024, n - a), len(some)), np.float32)
        for i, r in enumerate(rows[a : a + 1024]):
            mine = at[r]
            x[i, mine[mine >= 0]] = 1
        both += x.T @ x
        y = x[labels[a : a + 1024] == 1]
        pos += y.T @ y
    far = np.maximum(np.abs(pos * n - both * n1) - n / 2, 0)
    below = both * (n - both) * (n1 * (n - n1))
    chi = np.divide(n * far * far, below, out=np.zeros_like(far), where=(below > 0) & (both >= LEAST_DOCS))
    own = tie[some]
    np.fill_diagonal(chi, 0)
    return some[(chi >= LEAST_PAIR + own[:, None] + own[None, :]).any(axis=1)]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adaptive gradient steps over small batches, the same for equal input; classes weigh alike up to a factor of 3."""
    size = 1 << BITS
    rng = np.random.default_rng(seed)
    seen = np.zeros(size, np.int32)
    for r in rows:
        seen[r] += 1
    tie = _tie(rows, labels, seen)
    used = (seen >= LEAST_DOCS) & (tie >= LEAST_CHI2)
    paired = _paired(rows, labels, seen, tie)
    used[paired] = True
    rows = [r[used[r]] for r in rows]
    w, v = np.zeros(size, np.float32), np.where(used[:, None], rng.normal(0, 0.01, (size, RANK)), 0).astype(np.float32)
    v[paired] *= 30  # what tells by its pairs begins with some
    w[used] = 1e-9  # trained at all
    gw, gv, g0 = np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32), 1e-6
    w0, n = 0.0, len(rows)
    if not n:
        return Machine(-2.0, w, v)
    share = float(labels.mean())
    weight = np.where(labels == 1, min(3.0, max(1.0, (1 - share) / max(share, 1e-6))), 1.0)
    # log-odds of presence start the linear weights near their place, so few passes do
    pos = np.zeros(size)
    for r, y in zip(rows, labels, strict=True):
        if y:
            pos[r] += 1
    np_, nn = max(labels.sum(), 1), max(n - labels.sum(), 1)
    odds = np.log((pos + 0.5) / (np_ + 1)) - np.log((seen - pos + 0.5) / (nn + 1))
    sure = np.minimum(1, np.minimum(seen, 400) / 40.0)
    w[used] = (odds * sure * (np.abs(odds) > 1.5))[used].astype(np.float32) * 0.7 + 1e-9
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            batch = order[at : at + 64]
            ids = np.concatenate([rows[i] for i in batch]) if len(batch) else np.zeros(0, np.int64)
            lens = np.array([len(rows[i]) for i in batch])
            doc = np.repeat(np.arange(len(batch)), lens)
            vi = v[ids]
            total = np.zeros((len(batch), RANK), np.float32)
            np.add.at(total, doc, vi)
            square = np.bincount(doc, (vi**2).sum(axis=1), len(batch))
            z = w0 + np.bincount(doc, w[ids], len(batch)) + 0.5 * ((total**2).sum(axis=1) - square)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * weight[batch] / 8
            g0 += float(err.sum() ** 2)
            w0 -= 0.1 * float(err.sum()) / np.sqrt(g0)
            e = err[doc].astype(np.float32)
            uniq, inv = np.unique(ids, return_inverse=True)
            dw = np.bincount(inv, e, len(uniq)).astype(np.float32) + 1e-4 * w[uniq]
            dv = np.zeros((len(uniq), RANK), np.float32)
            np.add.at(dv, inv, e[:, None] * (total[doc] - vi))
            dv += 1e-3 * v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            w[uniq] -= 0.05 * dw / np.sqrt(gw[uniq])
            v[uniq] -= 0.02 * dv / np.sqrt(gv[uniq])
    w[used & (w == 0)] = 1e-9
    return Machine(w0, w, v)


def _is_held() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> Machine:
    """A machine from about ``per_label`` labelled documents of each label, chosen by a hash of their ids.

    Labels that are null teach nothing; of labels that contradict each other for a document the greatest holds.
    """
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~_is_held())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("toxic") == y) & (F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < min(1.0, per_label / n) * (1 << 20)))
    chosen = labels.filter(keep)

    def hashed(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "ids": [np.sort(terms(t)).tolist() for t in b["text"]]})

    text = documents(docs).join(F.broadcast(chosen), "doc_id")  # bounded by 2 x per_label rows
    got = text.mapInPandas(hashed, "doc_id long, toxic int, ids array<int>").toPandas()
    got = got.sort_values(["doc_id", "toxic"], kind="stable")
    return fit([np.asarray(x, np.int64) for x in got["ids"]], got["toxic"].to_numpy(np.float64))


def rate(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``; nothing but text decides.

    Null and empty texts have no terms and get the score of w0 alone. Repeated rows get equal results; an empty
    table gives none. Other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))  # 2^BITS x (RANK + 1) floats

    def run(batches):
        m = Machine(*held.value)
        for b in batches:
            s = np.array([m.score(terms(t)) for t in b["text"]], np.float64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return documents(docs).mapInPandas(run, "doc_id long, score double, predicted int")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rate(docs, machine).select("doc_id", _is_held().alias("held_out"), "score", "predicted")
