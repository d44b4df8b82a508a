"""Periodic runs of words: stretches that go on repeating what stands one period before.

A suffix automaton of the words has a state for each set of strings that end at the same places; a state's longest
string is its length, and its suffix link leads to the state whose places contain its own. The places are gathered up
the links, the smaller ordered set merged into the larger. Two places that become neighbours at a state lie a distance
p apart; if p does not exceed the state's length, the longest string meets its own copy and the two make a square of
period p, which that string cannot extend to the left. Where the words after the two places differ, the square cannot
be extended to the right either and is a run from its first word to its last. Every run is met so, at its last word
and the word one period before; where several periods fit one stretch, the smallest is its period.

Before that, words that can't be in a run are left out. Within a run of period q the words q apart are equal, so the
``k``-grams of all but its first period have the same ``k``-gram within the q words before them. Stretches of such
k-grams, with distances that fit their lengths, are all that the automaton has to read, with a period of words before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamfield.llm.common import documents, read, slices

#: A run has so many words at least, and so many periods.
LEAST = 6
TIMES = 4
#: Rounds of narrowing stretches; what is left after them is merely longer than it need be.
ROUNDS = 24
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Automaton:
    """Suffix automaton of a sequence: ``length``, ``link`` and, for the states of prefixes, ``end`` (else -1)."""

    def __init__(self, letters: list[int]):
        nxt: list[dict[int, int]] = [{}]
        link, length, end = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(letters):
            new = len(nxt)
            nxt.append({})
            length.append(i + 1)
            end.append(i)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    end.append(-1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
            last = new
        self.link, self.length, self.end = link, length, end


def runs(letters: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a sequence with ``least`` letters and ``times`` periods at least, by start,
    then period. ``times`` is 2 or more."""
    n = len(letters)
    if n < max(least, times):
        return []
    sam = Automaton(letters)
    link, length, end = sam.link, sam.length, sam.end
    del sam
    found: dict[tuple[int, int], int] = {}
    # ordered sets of places, as negative numbers: a prefix's own place is before all others of its state, so it is appended
    sets: list[list[int] | None] = [None] * len(link)

    def met(i: int, j: int, size: int) -> None:
        """Places i < j have become neighbours at a state of length ``size``."""
        p = j - i
        if p * (times - 1) <= size and size + p >= least and (j + 1 == n or letters[i + 1] != letters[j + 1]):
            key = (i - size + 1, j)
            if found.get(key, n) > p:
                found[key] = p

    for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        mine, size = sets[v], length[v]
        sets[v] = None
        if size + size // (times - 1) < least:
            continue  # no state of so short strings, or above it, can seed a run that is long enough
        if end[v] >= 0:
            if mine is None:
                mine = [-end[v]]
            else:
                met(end[v], -mine[-1], size)
                mine.append(-end[v])
        up = link[v]
        if mine is None or up <= 0:
            continue
        size = length[up]
        other = sets[up]
        if other is None:
            sets[up] = mine
            continue
        big, few = (other, mine) if len(other) >= len(mine) else (mine, other)
        sets[up] = big
        if size + size // (times - 1) < least:
            continue
        if len(few) * 16 > len(big):  # about as long: two sorted lists merge in a pass
            own = set(few)
            big.extend(few)
            big.sort()
            from_few = [x in own for x in big]
            for k in range(1, len(big)):
                if from_few[k] != from_few[k - 1]:
                    met(-big[k], -big[k - 1], size)
            continue
        before = None
        for k, x in enumerate(few):
            at = bisect_left(big, x)
            if at and big[at - 1] != before:
                met(-x, -big[at - 1], size)
            if at < len(big) and (k + 1 == len(few) or big[at] < few[k + 1]):
                met(-big[at], -x, size)
            big.insert(at, x)
            before = x
    return sorted((a, b - a + 1, p) for (a, b), p in found.items())


def windows(hashes: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges [a, b) in ascending order, none across documents, that hold every run as a whole.

    ``hashes``: a number for each word, equal for equal words; ``first``: for each word, where its document begins. Different
    words of equal numbers make ranges longer, never shorter.
    """
    k = max(1, min(3, min(max(least, times * q) - q for q in range(1, least + 1))))
    n = len(hashes) - k + 1
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    key = hashes.astype(np.uint64)
    gram = key[:n].copy()
    for i in range(1, k):
        gram = (gram ^ (gram >> np.uint64(29))) * _A + key[i : i + n] * _B
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    far = np.full(n, np.iinfo(np.int64).max)
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    at = np.arange(n)
    ok = (far <= at - first[:n]) & (first[:n] == first[k - 1 :])
    for _ in range(ROUNDS):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
        a, b = edges[::2], edges[1::2]
        most = (b - a + k - 1) // (times - 1)
        inside = np.flatnonzero(ok)
        bad = inside[far[inside] > np.repeat(most, b - a)]
        if not len(bad):
            break
        ok[bad] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
    a, b = edges[::2], edges[1::2]
    if not len(a):
        return none, none
    lo = np.maximum(first[a], a - (b - a + k - 1) // (times - 1))
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], (b + k - 1)[by]
    top = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] >= top[:-1]])
    heads = np.flatnonzero(new)
    return lo[heads], top[np.append(heads[1:] - 1, len(top) - 1)]


def _runs_of(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text's words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    words = [w for t in texts for w in t]
    hashes = np.fromiter(map(hash, words), np.int64, total)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = ends - sizes
    lo, hi = windows(hashes, np.repeat(starts, sizes), least, times)
    for a, b, d in zip(lo.tolist(), hi.tolist(), np.searchsorted(ends, lo, "right").tolist(), strict=True):
        names: dict[bytes, int] = {}
        letters = [names.setdefault(w, len(names)) for w in words[a:b]]
        at = a - int(starts[d])
        out[d] += [(at + s, n, p) for s, n, p in runs(letters, least, times)]
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs`` (doc_id, text).

    ``runs``: array of start, length, period, by start, then period; ``collapsed``: the words, joined by one space, without those
    that a run contains after its first period. ``change`` may alter a document's words beforehand.

    Null and empty texts have no words, no runs and collapse to the empty text. Rows are judged each for itself, so
    repeated rows give repeated results; null ids stay null; an empty table gives none. Other columns aren't read. A
    text is read as a whole by one task, which holds about 300 bytes a word of it where it is periodic.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                texts = [t.split() if t else [] for t in pc.cast(part.column("text"), pa.binary()).to_pylist()]
                if change is not None:
                    texts = [change(i, t) for i, t in zip(ids, texts, strict=True)]
                every = _runs_of(texts, least, times)
                kept = []
                for t, found in zip(texts, every, strict=True):
                    if found:
                        gone = np.zeros(len(t), bool)
                        for s, n, p in found:
                            gone[s + p : s + n] = True
                        t = [t[i] for i in np.flatnonzero(~gone).tolist()]
                    kept.append(b" ".join(t))
                ends = np.cumsum([0] + [len(x) for x in every]).astype(np.int32)
                flat = np.array([r for x in every for r in x], np.int64).reshape(-1, 3)
                found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), found, pa.array(kept, pa.binary()).cast(pa.string())], schema=kind)

    return documents(docs).mapInArrow(work, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the periodic stretch that the query's contract writes over a tenth of the documents, by their ids.

    A null id has no number and changes nothing.
    """
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    body = words[a : a + p]
    return words[:a] + (body * (-(-(n - a) // p)))[: n - a]


def op12(spark, sf_dir: str) -> DataFrame:
    found = collapse(read(spark, sf_dir), change=planted)
    best = F.expr("element_at(array_sort(transform(runs, r -> struct(-r.length as n, r.start as s, r.period as p))), 1)")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("1000 * -best.n div best.p").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))"), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
