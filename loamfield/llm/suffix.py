"""Exact removal of repeated byte strings with suffix arrays by induced sorting.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Shards of text are found so that
equal strings always meet: in every window of ``length`` bytes the least k-gram hash is the window's anchor, equal
windows have equal anchors at equal places, and the windows of one anchor are a run of text, a segment. Segments are
dealt by anchor; anchors that occur once have no repeat. Segments that are equal as a whole are one segment that
stands for several; the others of an anchor go into the shard's suffix array.

The array is built by classifying suffixes as smaller or larger than their successor, sorting the leftmost-smaller
substrings, naming them, sorting the string of names in turn, and inducing the order of all suffixes from theirs, a
bucket of equal first letters at a time. Common prefixes are computed in text order (permuted): where the letters
before a suffix and before its neighbour agree, the prefix is one shorter than that of the suffix before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamfield.llm.common import documents, split_by_partner, staged

U = np.uint64
LENGTH = 400
GRAM = 100
#: Bytes of segments in a shard, unless one anchor has more.
SHARD = 3 << 19
_B = 0x9E3779B97F4A7C15
_SALT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


# ---- suffix arrays ---------------------------------------------------------------------------------------------


def _seeded(t: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """An array with the leftmost-smaller suffixes, in the order given, at the ends of their buckets; 0 elsewhere."""
    sa, c = np.zeros(len(t), np.int32), t[lms]
    counts = np.bincount(c, minlength=len(ends))
    o = np.argsort(c, kind="stable")
    sa[np.repeat(ends - np.cumsum(counts), counts) + np.arange(len(lms))] = lms[o]
    return sa


def _induce_names(s: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Like :func:`_induce`, of a string of names: a name's bucket is small, so suffixes are put in one by one."""
    sa = _seeded(s, ends, lms).tolist()
    before = np.concatenate([[-1], s[:-1]])
    is_small = np.concatenate([[False], small[:-1]])
    letter = np.where(is_small, -1, before).tolist()  # of the suffix one longer, if that is a larger one
    edge = [0, *ends[:-1].tolist()]
    for i in sa:  # larger suffixes, from the front; the loop meets what it has put in
        c = letter[i]
        if c >= 0:
            sa[edge[c]] = i - 1
            edge[c] += 1
    letter = np.where(is_small, before, -1).tolist()
    edge = (ends - 1).tolist()
    for i in reversed(sa):  # smaller suffixes, from the back
        c = letter[i]
        if c >= 0:
            sa[edge[c]] = i - 1
            edge[c] -= 1
    return np.array(sa, np.int32)


def _sorted_substrings(s: np.ndarray, letters: int, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the leftmost-smaller substrings of a string of names, their names): three letters at a time, for those
    that still tie. Where one ends its suffix is of the smaller kind, which stands above a larger one of equal letter."""
    m, base = len(lms), np.int64(letters + 2)
    size = np.append(np.diff(lms) + 1, 1)
    pad = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    name, order, live, d = np.zeros(m, np.int64), np.arange(m), np.arange(m), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for k in range(d, d + 3):
            inside = k < size[live]
            key = key * base + np.where(inside, pad[np.where(inside, lms[live] + k, 0)], np.where(k == size[live], letters, letters + 1))
        o = np.lexsort((key, name[live]))
        live, key = live[o], key[o]
        group = name[live]  # a name is the place of its group's first member
        lead = np.concatenate([[True], group[1:] != group[:-1]])
        new = lead | np.concatenate([[True], key[1:] != key[:-1]])
        i = np.arange(len(live))
        within = np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(lead, i, 0))
        order[group + i - np.maximum.accumulate(np.where(lead, i, 0))] = live
        name[live] = group + within
        heads = np.flatnonzero(new)
        many = np.diff(np.append(heads, len(live)))
        live = live[np.repeat(many > 1, many)]
        d += 3
        live = live[size[live] >= d]
    places = name[order]
    return order, np.cumsum(np.concatenate([[0], places[1:] != places[:-1]]))


def _induce(t: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in the order given, a bucket of equal first letters at a time.

    Letters are bytes, which a stable argsort of numpy deals by radix, so all is linear.
    """
    n, letters = len(t), len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    sa = _seeded(t, ends, lms)
    counts = np.bincount(t[lms], minlength=letters)
    lms_from = (ends - counts).tolist()
    head = starts.copy()
    present = np.flatnonzero(ends > starts).tolist()
    ends_l, starts_l = ends.tolist(), starts.tolist()

    def put(pred: np.ndarray, up: bool, edge: np.ndarray):
        ch = t[pred]
        o = np.argsort(ch, kind="stable")
        ch, pred = ch[o], pred[o]
        lead = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
        size = np.diff(np.append(lead, len(ch)))
        letter = ch[lead]
        within = np.arange(len(ch)) - np.repeat(lead, size)
        if up:
            sa[np.repeat(edge[letter], size) + within] = pred
            edge[letter] += size
        else:
            sa[np.repeat(edge[letter], size) - 1 - within] = pred
            edge[letter] -= size

    for b in present:  # larger suffixes, first bucket to last
        a = starts_l[b]
        while True:
            z = int(head[b])
            if a == z:
                break
            p = sa[a:z] - 1
            a = z
            p = p[p >= 0]
            p = p[~small[p]]
            if len(p):
                put(p, True, head)
        p = sa[lms_from[b] : ends_l[b]] - 1
        p = p[p >= 0]
        p = p[~small[p]]
        if len(p):
            put(p, True, head)
    tail = ends.copy()
    for b in reversed(present):  # smaller suffixes, last bucket to first
        z = ends_l[b]
        while True:
            a = int(tail[b])
            if a == z:
                break
            p = sa[a:z][::-1] - 1
            z = a
            p = p[p >= 0]
            p = p[small[p]]
            if len(p):
                put(p, False, tail)
        p = sa[starts_l[b] : int(head[b])][::-1] - 1
        p = p[p >= 0]
        p = p[small[p]]
        if len(p):
            put(p, False, tail)
    return sa


def suffix_array(t: np.ndarray, letters: int) -> np.ndarray:
    """Starts of all suffixes of ``t`` in order. Letters are below ``letters``; the last, 0, stands nowhere else.

    Bytes, at the first level, have few buckets, which are filled by array operations; the strings of names below it have
    many small ones. Every level recurses until all names differ.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    few = letters <= 256
    differs = np.append(t[1:] != t[:-1], True)
    at = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    small = np.append(t[:-1] < t[1:], True)[nxt]
    del differs, at, nxt
    small[-1] = True
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    m = len(lms)
    ends = np.cumsum(np.bincount(t, minlength=letters))
    if few:
        sa = _induce(t, small, ends, lms)
        isl = np.zeros(n, bool)
        isl[lms] = True
        which = np.searchsorted(lms, sa[isl[sa]])
        del sa, isl
        name = _names(t, lms, which)
    else:
        which, name = _sorted_substrings(t, letters, lms)
    kinds = int(name[-1]) + 1
    if kinds < m:
        names = np.empty(m, np.int32)
        names[which] = name
        del name, which
        which = suffix_array(names, max(kinds, 257))  # names are never taken for bytes
    return (_induce if few else _induce_names)(t, small, ends, lms[which])


def _names(t: np.ndarray, lms: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings (from one such place up to the next, both included) in their order."""
    length = np.append(np.diff(lms), 0)[which] + 1
    got = lms[which]
    a, b = got[:-1], got[1:]
    same = length[:-1] == length[1:]
    live, d = np.flatnonzero(same), 0
    while len(live):
        live = live[length[live] > d]
        bad = t[a[live] + d] != t[b[live] + d]
        same[live[bad]] = False
        live = live[~bad]
        d += 1
    return np.concatenate([[0], np.cumsum(~same)])


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(permuted common prefixes, the suffix that stands before each in order; -1: none) of a byte string."""
    n = len(text)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    has = phi >= 0
    given = has & (phi > 0)
    given[0] = False
    given[1:] &= text[:-1] == text[phi[1:] - 1]
    heads = np.flatnonzero(~given).astype(np.int32)
    lcp = np.zeros(len(heads), np.int32)
    live = np.flatnonzero(has[heads])
    pad = np.concatenate([text, np.zeros(16, np.uint8)])
    wide = np.ndarray(n + 8, "<u8", pad, strides=(1,))
    while len(live):
        x, y, d = heads[live], phi[heads[live]], lcp[live]
        diff = wide[np.minimum(x + d, n)] ^ wide[np.minimum(y + d, n)]
        room = n - np.maximum(x, y) - d
        same = np.where(diff == 0, 8, np.log2((diff & (~diff + U(1))).astype(np.float64).clip(1)).astype(np.int32) >> 3)
        same = np.minimum(same, room).astype(np.int32)
        lcp[live] += same
        live = live[same == 8]
    i = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(~given, i, np.int32(0)))
    full = np.zeros(n, np.int32)
    full[heads] = lcp
    full = full[last]
    full -= i
    full += last
    return np.where(has, np.maximum(full, 0), np.int32(0)), phi


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the places where a string of ``length`` bytes starts that starts elsewhere in the segments too."""
    sizes = np.array([len(s) for s in segments], np.int64)
    if not len(sizes):
        return []
    # UTF-8 has no byte above 0xF4, so letters 2 to 0xF6 are bytes, 1 parts segments and 0 ends the text
    text = np.frombuffer(b"\xff".join(segments) + b"\xff\xfe", np.uint8) + np.uint8(2)
    sa = suffix_array(text, 256)
    lcp, phi = common_prefixes(text, sa)
    del sa
    hit = lcp >= length
    del lcp
    twice = hit.copy()
    twice[phi[hit]] = True
    ends = np.cumsum(sizes + 1)
    out = []
    for start, size in zip((ends - sizes - 1).tolist(), sizes.tolist(), strict=True):
        out.append(np.flatnonzero(twice[start : start + max(0, size - length + 1)]))
    return out


# ---- anchors and segments --------------------------------------------------------------------------------------


class Anchors:
    """Anchors of texts; powers of the rolling hash are kept for the longest text so far."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.up, self.down = length, gram, np.ones(1, U), np.ones(1, U)

    def _grow(self, n: int):
        if len(self.up) < n:
            n = 1 << n.bit_length()
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, _B, U)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, pow(_B, -1, 1 << 64), U)]))

    def segments(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first, last window start) of the segments of a text of ``length`` bytes or more; every window
        start belongs to one. Texts beyond 2^23 bytes are hashed in overlapping pieces."""
        most = 1 << 23
        if len(text) > most + self.length:
            got, at = [], 0
            while at + self.length <= len(text):
                h, lo, hi = self.segments(text[at : at + most + self.length - 1])
                got.append((h, lo + at, hi + at))
                at += most
            return tuple(np.concatenate(x) for x in zip(*got, strict=True))
        b = np.frombuffer(text, np.uint8)
        n, k, w = len(b), self.gram, self.length - self.gram + 1
        self._grow(n)
        total = np.zeros(n + 1, U)
        np.cumsum(_SALT[b] * self.up[:n], out=total[1:])
        m = n - k + 1
        h = (total[k:] - total[:m]) * self.down[:m]
        h ^= h >> U(31)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(29)
        key = (h & ~U(0xFFFFFF)) | (U(0xFFFFFF) - np.arange(m, dtype=U))
        rows = np.concatenate([key, np.full(-m % w, U(2**64 - 1))]).reshape(-1, w)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[: m - w + 1], before[w - 1 : m])
        lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = (U(0xFFFFFF) - (least[lo] & U(0xFFFFFF))).astype(np.int64)
        return h[at], lo, np.append(lo[1:], len(least)) - 1


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, tk, ah, sh, w, los``: the segments of each text by anchor hash and hash of the whole, with all places where
    they start (text that goes round has the same segment many times) and how far their last window is from the first."""
    kind = pa.schema([("doc_id", pa.int64()), ("tk", pa.binary()), ("ah", pa.int64()), ("sh", pa.int64()), ("w", pa.int32()), ("los", pa.list_(pa.int32()))])

    def run(batches):
        anchors = Anchors(length, gram)
        for b in batches:
            parts, n = [], []
            for t in b.column("text"):
                e = t.as_py()
                e = e.encode("utf-8", "surrogatepass") if e else b""
                if len(e) < length:
                    n.append(0)
                    continue
                h, lo, hi = anchors.segments(e)
                sh = np.fromiter((xxhash.xxh3_64_intdigest(e[x : y + length]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)), U, len(lo))
                o = np.lexsort((lo, sh, h))
                h, lo, hi, sh = h[o], lo[o], hi[o], sh[o]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (sh[1:] != sh[:-1])]))
                parts.append((h[first], sh[first], (hi - lo)[first], np.diff(np.append(first, len(h))), lo))
                n.append(len(first))
            if parts:
                row = pa.array(np.repeat(np.arange(len(n)), n))
                h, sh, w, many, lo = (np.concatenate(x) for x in zip(*parts, strict=True))
                ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("tk").take(row), pa.array(h.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(w.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(lo.astype(np.int32)))], schema=kind)

    return docs.mapInArrow(run, "doc_id long, tk binary, ah long, sh long, w int, los array<int>")


def _texts_of(docs: DataFrame, carriers: DataFrame, length: int, n: int) -> DataFrame:
    """Segments with their bytes: ah, doc_id, tk, lo, body; n at most."""
    wanted = carriers.groupBy(F.col("c.doc_id").alias("d_"), F.col("c.tk").alias("t_")).agg(F.collect_list(F.struct("c.lo", "c.hi", "ah", "once")).alias("parts"))
    docs, _ = split_by_partner(docs, F.col("tk"), wanted, F.col("t_"), n)
    met = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("tk") == F.col("t_"))).select("doc_id", "tk", "text", "parts")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                d, k, text, parts = (b.column(c)[i].as_py() for c in ("doc_id", "tk", "text", "parts"))
                e = text.encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_pydict({
                    "ah": pa.array([p["ah"] for p in parts], pa.int64()), "doc_id": pa.array([d] * len(parts), pa.int64()), "tk": pa.array([k] * len(parts), pa.binary()),
                    "lo": pa.array([p["lo"] for p in parts], pa.int32()), "once": pa.array([p["once"] for p in parts], pa.bool_()),
                    "body": pa.array([e[p["lo"] : p["hi"] + length] for p in parts], pa.binary()),
                })

    return met.mapInArrow(run, "ah long, doc_id long, tk binary, lo int, once boolean, body binary")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """Byte ranges [a, b) that a repeated string covers: ``doc_id, tk, a, b`` (ranges may overlap).

    ``docs``: doc_id, tk, text; tk tells apart texts of a repeated doc_id. Rows that repeat both are strings that
    start elsewhere too.
    """
    anchors = staged(_anchor_rows(docs, length, gram), "anchors")
    often = anchors.groupBy("ah").agg(F.sum(F.size("los")).alias("n")).filter("n > 1").select("ah")
    met = staged(anchors.join(often, "ah", "left_semi"), "anchors-met")
    lo = F.col("los")[0]
    segments = met.groupBy("ah", "sh").agg(F.sum(F.size("los")).alias("n"), F.min(F.struct("doc_id", "tk", lo.alias("lo"), (lo + F.col("w")).alias("hi"))).alias("c"))
    segments = staged(segments, "segments")
    whole = met.join(segments.filter("n > 1").select("ah", "sh"), ["ah", "sh"], "left_semi")
    whole = whole.select("doc_id", "tk", "w", F.explode("los").alias("a")).select("doc_id", "tk", "a", (F.col("a") + F.col("w") + length).alias("b"))

    mixed = segments.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("ah")
    sorted_ = segments.join(mixed, "ah", "left_semi").select("ah", "c", (F.col("n") == 1).alias("once"))
    n, total = sorted_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("c.hi") - F.col("c.lo") + length), F.lit(0))).first()
    shards = int(min(100_000, max(1, -(-total // shard))))
    bodies = _texts_of(docs, sorted_, length, n).repartition(shards, "ah").sortWithinPartitions("ah")

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            found = repeated_starts([x[4] for x in held], length)
            out = []
            for (d, k, lo, once, _), at in zip(held, found, strict=True):
                if once and len(at):
                    cut = np.flatnonzero(np.diff(at) > 1)
                    for a, b in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True):
                        out.append((d, k, lo + a, lo + b + length))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "tk", "a", "b"])

        for b in batches:
            for ah, d, k, lo, once, body in zip(*(b.column(c).to_pylist() for c in ("ah", "doc_id", "tk", "lo", "once", "body")), strict=True):
                if size >= shard and ah != last:
                    yield flush()
                    held, size = [], 0
                held.append((d, k, lo, once, body))
                size, last = size + len(body), ah
        if held:
            yield flush()

    part = bodies.mapInArrow(run, "doc_id long, tk binary, a int, b int")
    return whole.unionByName(part)


def _key(text) -> F.Column:
    """Tells apart the texts of a repeated or null doc_id: 128 bits of a digest, which no two texts share."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for each row of ``docs`` (doc_id, text).

    Null text is empty: 0 bytes, nothing removed. ``spans``: maximal removed byte ranges. Rows that repeat doc_id and
    text are repeats of each other. Texts of less than ``length`` bytes keep all. An empty table gives none.
    """
    docs = documents(docs).select("doc_id", _key(F.col("text")).alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeats(docs, length, gram, shard)
    found = found.groupBy(F.col("doc_id").alias("d_"), F.col("tk").alias("t_")).agg(F.collect_set(F.struct("a", "b")).alias("cover"))
    found = staged(found, "cover")
    some, rest = split_by_partner(docs, F.col("tk"), found, F.col("t_"))
    met = some.join(found, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("tk") == F.col("t_")), "left").unionByName(rest, allowMissingColumns=True).select("doc_id", "text", "cover")

    def run(batches):
        for b in batches:
            rows = []
            for text, cover in zip(b.column("text"), b.column("cover"), strict=True):
                e = text.as_py().encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for x in sorted((c["a"], c["b"]) for c in cover.as_py() or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                kept, at = hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(e[at:x])
                    at = y
                kept.update(e[at:])
                rows.append((len(e), sum(y - x for x, y in spans), len(spans), kept.hexdigest(), [{"a": x, "b": y} for x, y in spans]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: long, b: long>>")


def op6(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
