"""Language by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3), most frequent first. A document's own
list is compared with each profile: every n-gram is out of place by the difference of its two ranks, or by the
profile's size if the profile lacks it; the language with the least sum wins (ties: the first by name).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamfield.llm.common import documents

#: Most frequent n-grams in a profile.
PROFILE = 400
#: Training documents of a language, as expected from a hash of doc_id: the documented bound of what is learned from.
TRAIN_PER_LANG = 4000
#: Texts are counted in pieces of so many characters, so that memory stays bounded.
PIECE = 1 << 18
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 for what isn't a letter."""
    if not _FOLD:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(out)
    return _FOLD[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of the letters of a text as numbers (21 bits a letter; 1: a run of other characters), and their counts.

    Pieces of a long text begin with the last two letters of the piece before, and each n-gram counts where it ends, so
    the counts are those of the whole.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    past = np.zeros(1, np.uint64)
    for at in range(0, max(len(text), 1), PIECE):
        c = _fold()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        c = np.concatenate([past, c] if at + PIECE < len(text) else [past, c, np.zeros(1, np.uint64)])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        n = np.maximum(c, np.uint64(1))
        two = (n[:-1] << np.uint64(21)) | n[1:]
        three = (two[:-1] << np.uint64(21)) | n[2:] if len(n) > 2 else two[:0]
        mid = c[1:-1] != 0
        one, two, mid, three = n[len(past) :][c[len(past) :] != 0], two[len(past) - 1 :], mid[max(0, len(past) - 2) :], three[max(0, len(past) - 2) :]
        every = np.concatenate([one, two, three[mid]])
        every.sort()
        new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        found.append((every[new], np.diff(np.append(new, len(every)))))
        past = c[-2:]
    return _merged(found)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first (ties: the smaller number)."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


class Profiles:
    """Profiles of all languages side by side, as one sorted table of n-grams with a rank for each language."""

    def __init__(self, by_lang: dict[str, list[int]], size: int = PROFILE):
        self.langs = sorted(by_lang)
        self.size = size
        self.keys = np.unique(np.concatenate([np.asarray(by_lang[x], np.uint64) for x in self.langs])) if self.langs else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)
        for j, x in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, np.asarray(by_lang[x], np.uint64)), j] = np.arange(len(by_lang[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the winner's share of nearness, 1 - distance / the most possible."""
        if not text or not self.langs:
            return "und", 0.0
        keys, counts = grams(text)
        mine = ranked(keys, counts, self.size)
        if not len(mine):
            return "und", 0.0
        at = np.searchsorted(self.keys, mine)
        at[at == len(self.keys)] = len(self.keys)
        hit = np.zeros(len(mine), bool)
        ok = at < len(self.keys)
        hit[ok] = self.keys[at[ok]] == mine[ok]
        ranks = self.ranks[np.where(hit, at, len(self.keys))]
        far = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(mine))[:, None]), self.size)).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(mine)))


def _is_held(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, size: int = PROFILE, per_lang: int = TRAIN_PER_LANG) -> Profiles:
    """Profiles from about ``per_lang`` documents of each language (all, where there are fewer), chosen by a hash of
    their ids. ``docs``: doc_id, text, lang; rows with null text or lang teach nothing.

    Every language that a row is labelled with has a profile. What reaches the driver, and the tasks, is ``size`` n-grams of
    each, some 6 KB a language.
    """
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) * F.col("of_lang") < F.lit(per_lang << 20)
    chosen = docs.join(F.broadcast(counts), "lang").filter(drawn)  # a row for each language

    def tally(batches):
        total: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                total.setdefault(lang, []).append(grams(text))
                if len(total[lang]) >= 64:
                    total[lang] = [_merged(total[lang])]
        for lang, parts in total.items():
            k, n = _merged(parts)
            yield pd.DataFrame({"lang": lang, "gram": k.astype(np.int64), "n": n.astype(np.int64)})

    found = chosen.select("lang", "text").mapInPandas(tally, "lang string, gram long, n long")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by: dict[str, list[int]] = {}
    cut = found.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(32)))
    order = [F.desc("n"), F.asc("gram")]
    near = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("r") <= size)
    last = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= size)
    for r in last.orderBy("lang", "r").collect():
        by.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by, size)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    uniq, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return uniq, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``; nothing but text decides.

    Null text, and text without letters, is ``und`` with score 0. Repeated rows get equal results; an empty table
    gives none. Other columns aren't read.
    """

    def run(batches):
        _fold()
        for b in batches:
            got = [profiles.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return documents(docs).mapInPandas(run, "doc_id long, lang_pred string, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.filter(~_is_held()))
    out = identify(docs, profiles)
    return out.select("doc_id", _is_held().alias("held_out"), "lang_pred", "score")
