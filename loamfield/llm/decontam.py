"""Benchmark decontamination by canonical templates.

Words become template tokens: numbers, names (capitalised inside a sentence) and units are replaced by typed
placeholders, other words are lower-cased without outer punctuation. Windows of template tokens of the documents are
hash-joined with those of the benchmark. Windows that follow each other on one diagonal form a run; the longest
stretch of a run counts that is long enough, has enough literal words, and whose slots are consistent: equal benchmark
values stand for equal document values and different ones for different ones. So a question with other numbers or names
is still caught, and one value that is out of line ends a stretch but spoils no other.

Verbatim copies need no literals: windows of the words themselves are joined too, and an item shorter than a window
counts wherever all its words stand in a row, even if it is a single word. A word that begins a line or comes after a
colon may or may not begin a sentence; texts with such words are read both ways.

Every text is read once for the join: windows that a bitmap of the benchmark's windows doesn't know stay behind, the rest
are joined as a table. Only documents and items that share a window are read again, for the runs and their slots.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamfield.llm.common import documents, slices, split_by_partner, staged, text_key, unsliced

U = np.uint64
UNITS = frozenset(
    "%|°|°c|°f|cm|mm|km|m|g|kg|mg|lb|lbs|oz|l|ml|litres|liters|metres|meters|miles|mile|feet|foot|inch|inches|yards|hours|hour|minutes|minute|seconds|"
    "second|days|day|weeks|week|months|month|years|year|dollars|dollar|cents|euros|euro|pounds|pound|kilometers|kilometres|kilograms|grams|kmh|mph|km/h|m/s".split("|")
)
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
_NUM = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*%?")
_OUTER = ".,;:!?\"'()[]{}<>*#$&|_“”‘’«»…"
_END = re.compile(r"[.!?…][\"')\]”’»]*$")
_MAYBE_END = re.compile(r":[\"')\]”’»]*$")
_EMPTY = U(xxhash.xxh3_64_intdigest(b""))
LITERAL, NUM, UNIT, NAME = range(4)
CACHE = 300_000
#: Bits of the map of the benchmark's windows: 64 for each, up to 16 MB.
MAP_BITS = (16, 27)
#: Characters of items whose windows a worker remembers.
CACHE_CHARS = 4 << 20


@dataclass(frozen=True)
class Params:
    """``window`` tokens are hashed; a run needs ``run`` tokens (or ``share`` of a shorter item, a window at least) and
    ``literals`` different literal words, or ``share`` of an item's where it has few, two at least. Items of less than ``window`` and at least ``least`` tokens are one window.
    Verbatim copies need the same tokens, without ``literals`` and ``least``. Windows, and texts of items, are broadcast
    where they have ``block_bytes`` in all at most; else they are shuffled."""

    window: int = 8
    run: int = 13
    share: float = 0.6
    literals: int = 5
    least: int = 5
    block_bytes: int = 32 << 20


class Canon:
    """Template tokens of texts, with a bounded memory of words."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.hash: list[int] = []
        self.kind: list[int] = []
        self.end: list[int] = []
        self._arrays = (np.zeros(0, U), np.zeros(0, np.int8), np.zeros(0, np.int8))

    def _add(self, w: str) -> int:
        bare = w.strip(_OUTER)
        low = bare.lower()
        kind = NUM if _NUM.fullmatch(bare) or low in NUMBERS else UNIT if low in UNITS or w == "%" else NAME if bare[:1].isupper() else LITERAL
        self.hash.append(xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.kind.append(kind)
        self.end.append(2 if _END.search(w) else 1 if _MAYBE_END.search(w) else 0)
        self.at[w] = i = len(self.hash) - 1
        return i

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words of texts (no nulls): (literal hashes, kinds, kinds read the other way, number of the text, place of each
        text's first word and their end). The other way, words that begin lines or follow colons begin sentences."""
        lines = pc.split_pattern(unsliced(texts).cast(pa.large_string()), "\n")
        words = pc.utf8_split_whitespace(pc.list_flatten(lines))
        flat = pc.list_flatten(words)
        if len(self.at) > CACHE:
            self.clear()
        coded = pc.dictionary_encode(flat)
        known = coded.dictionary.to_pylist()
        get, add = self.at.get, self._add
        ix = np.fromiter([i if (i := get(w)) is not None else add(w) for w in known], np.int64, len(known))
        self._grow()
        which = coded.indices.to_numpy(zero_copy_only=False)
        real = np.array([bool(w) for w in known], bool)[which]  # white space at the ends of a line leaves empty words
        i = ix[which[real]]
        lit, kind, end = self._arrays[0][i], self._arrays[1][i], self._arrays[2][i]
        before = np.concatenate([[0], np.cumsum(real)])
        line_ends = before[words.offsets.to_numpy()]
        text_ends = line_ends[lines.offsets.to_numpy()]
        of = np.repeat(np.arange(len(texts)), np.diff(text_ends))
        name = kind == NAME
        first = np.concatenate([[2], end[:-1]])[: len(end)]
        first[text_ends[:-1][text_ends[:-1] < len(first)]] = 2
        one = np.where(name & (first == 2), LITERAL, kind)
        first[line_ends[:-1][line_ends[:-1] < len(first)]] = 2
        two = np.where(name & (first > 0), LITERAL, kind)
        return lit, one, two, of, text_ends

    def forms(self, text: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(template hashes, kinds, literal hashes) of the words of a text; once more, with the words that begin lines or
        follow colons as beginnings of sentences, if that makes a difference."""
        lit, one, two, _, _ = self.tokens(pa.array([text]))
        return [(np.where(k == LITERAL, lit, k.astype(U)), k, lit) for k in ([one] if (one == two).all() else [one, two])]

    def _grow(self):
        n = len(self._arrays[0])
        new = (np.array(self.hash[n:], U), np.array(self.kind[n:], np.int8), np.array(self.end[n:], np.int8))
        self._arrays = tuple(np.concatenate(x) for x in zip(self._arrays, new, strict=True))


def rolled(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k tokens."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for j in range(k):
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) + tokens[j : j + n]
    return h ^ (h >> U(32))


class Index:
    """Windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], p: Params):
        self.p, canon = p, Canon()
        forms = [(n, i, f, k) for n, (i, t) in enumerate(items) if t and t.strip() for k, f in enumerate(canon.forms(t))]
        self.items = [(n, i, *f) for n, i, f, _ in forms]
        templates = [(n, x[2]) for n, x in enumerate(self.items) if len(x[2]) >= p.least]
        words = [(n, x[4]) for n, (x, f) in enumerate(zip(self.items, forms, strict=True)) if not f[3] and (x[4] != _EMPTY).any()]
        self.sizes = [(exact, k, *self._windows(of, k)) for exact, of in ((False, templates), (True, words)) for k in sorted({min(p.window, len(t)) for _, t in of})]

    def _windows(self, of: list[tuple[int, np.ndarray]], k: int) -> tuple:
        """Hashes of the windows of k tokens, ascending, with item and place; a bitmap of them and its mask."""
        found = [(n, rolled(t, k)) for n, t in of if min(self.p.window, len(t)) == k]
        h = np.concatenate([w for _, w in found])
        item = np.concatenate([np.full(len(w), n) for n, w in found])
        pos = np.concatenate([np.arange(len(w)) for _, w in found])
        o = np.argsort(h, kind="stable")
        bits = max(16, int(len(h)).bit_length() + 5)
        maybe = np.zeros(1 << bits, bool)
        maybe[h & U((1 << bits) - 1)] = True
        return h[o], item[o], pos[o], maybe, U((1 << bits) - 1)

    def need(self, length: int) -> int:
        return min(self.p.run, max(min(self.p.window, length), int(np.ceil(self.p.share * length))))

    def literals(self, kind: np.ndarray, lit: np.ndarray) -> int:
        """Different literal words that a stretch of an item needs."""
        return min(self.p.literals, max(2, int(np.ceil(self.p.share * len(np.unique(lit[kind == LITERAL]))))))

    def matches(self, forms: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int, float, int]]:
        """(item_id, tokens of the longest run, its share of the item, slots with another value) for each item found."""
        best: dict[int, tuple] = {}
        for (exact, k, h, item, pos, maybe, mask), (tokens, _, lits) in ((x, f) for x in self.sizes for f in forms[: 1 if x[0] else None]):
            mine = rolled(lits if exact else tokens, k)
            at = np.flatnonzero(maybe[mine & mask])
            if not len(at):
                continue
            lo, hi = np.searchsorted(h, mine[at]), np.searchsorted(h, mine[at], "right")
            n = hi - lo
            if not n.sum():
                continue
            at = np.repeat(at, n)
            ref = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            it, off = item[ref], pos[ref]
            o = np.lexsort((at, at - off, it))
            at, off, it = at[o], off[o], it[o]
            cut = np.flatnonzero(np.concatenate([[True], (it[1:] != it[:-1]) | ((at - off)[1:] != (at - off)[:-1]) | (at[1:] != at[:-1] + 1)]))
            for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True):
                found = self._copy if exact else self._run
                got = found(int(it[a]), int(off[a]), int(at[a]), int(b - a) + k - 1, tokens, lits)
                source = self.items[int(it[a])][0]
                if got and got[1:] > best.get(source, (0, 0, 0, 0))[1:]:
                    best[source] = got
        return list(best.values())

    def _copy(self, n: int, i: int, j: int, size: int, tokens, lits):
        _, item_id, _, _, lit = self.items[n]
        lit, mine = lit[i : i + size], lits[j : j + size]
        if size < self.need(len(self.items[n][4])) or not (lit == mine).all() or (lit == _EMPTY).all():
            return None
        return item_id, size, size / len(self.items[n][4]), 0

    def _run(self, n: int, i: int, j: int, size: int, tokens, lits):
        _, item_id, t, kind, lit = self.items[n]
        if size < self.need(len(t)) or not (t[i : i + size] == tokens[j : j + size]).all():
            return None
        few = self.literals(kind, lit)
        kind, lit, mine = kind[i : i + size], lit[i : i + size], lits[j : j + size]
        slot = kind != LITERAL
        where = np.flatnonzero(slot).tolist()
        pairs = list(zip(kind[slot].tolist(), lit[slot].tolist(), mine[slot].tolist(), strict=True))
        best = None
        for a, b in self._consistent(where, pairs, size):
            if b - a < self.need(len(t)) or (best and b - a <= best[1]):
                continue
            if len(np.unique(lit[a:b][~slot[a:b]])) >= few:
                best = item_id, b - a, (b - a) / len(t), sum(x != y for _, x, y in {q for w, q in zip(where, pairs, strict=True) if a <= w < b})
        return best

    @staticmethod
    def _consistent(where: list[int], pairs: list[tuple[int, int, int]], size: int):
        """(start, end) of the longest stretches, none within another, whose slots are consistent."""
        start = 0
        there: dict[tuple, tuple] = {}
        back: dict[tuple, tuple] = {}
        for at, (kind, ours, theirs) in zip(where, pairs, strict=True):
            clash = -1
            for seen, key, value in ((there, (kind, ours), theirs), (back, (kind, theirs), ours)):
                if key in seen and seen[key][0] != value:
                    clash = max(clash, seen[key][1])
            if clash >= start:
                yield start, at
                start = clash + 1
            there[kind, ours], back[kind, theirs] = (theirs, at), (ours, at)
        yield start, size


SCHEMA = "doc_id long, item_id long, n_tokens long, coverage double, n_changed long"
#: Windows of equal tokens meet only if they have the same size and both are templates or both are words.
_WINDOW = "h long, kind int"


def _kind(exact: bool, k: int) -> int:
    return 2 * k + exact


def _item_windows(items: DataFrame, p: Params) -> DataFrame:
    """``ik`` and the windows of each distinct item text, without repeats."""

    def run(batches):
        for b in batches:
            for ik, text in zip(b.column("ik").to_pylist(), b.column("text").to_pylist(), strict=True):
                for exact, k, h, *_ in Index([(0, text)], p).sizes:
                    u = np.unique(h).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"ik": pa.array(np.full(len(u), ik)), "h": pa.array(u), "kind": pa.array(np.full(len(u), _kind(exact, k), np.int32))})

    return items.select("ik", F.col("item").alias("text")).dropDuplicates(["ik"]).mapInArrow(run, f"ik long, {_WINDOW}")


def _mapped(windows: DataFrame, n: int) -> np.ndarray:
    """Bitmap of the windows' hashes, as bytes; its size is bounded whatever the benchmark holds."""
    bits = min(max(64 * n, 1).bit_length(), MAP_BITS[1])
    bits = max(bits, MAP_BITS[0])
    at = F.shiftrightunsigned("h", 64 - bits) + 1
    parts = windows.select(at.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts:
        m = np.frombuffer(r["m"], np.uint8)
        lo = (r["n"] - 1) * len(m)
        out[lo : lo + len(m)] = m[: len(out) - lo]
    return out


def _doc_windows(docs: DataFrame, known: np.ndarray, kinds: list[int], p: Params) -> DataFrame:
    """``doc_id, tk`` and the windows of each text that the bitmap knows, without repeats."""
    held = docs.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("h", pa.int64()), ("kind", pa.int32())])

    def run(batches):
        bits, canon = held.value, Canon()
        shift = U(64 - (len(bits).bit_length() - 1 + 3))
        for whole in batches:
            for b in slices(whole):
                lit, one, two, of, _ = canon.tokens(pc.fill_null(b.column("text"), ""))
                differ = np.zeros(b.num_rows, bool)
                differ[of[one != two]] = True
                other = differ[of]
                forms = [(False, np.where(one == LITERAL, lit, one.astype(U)), of), (True, lit, of)]
                if other.any():
                    forms.append((False, np.where(two == LITERAL, lit, two.astype(U))[other], of[other]))
                rows, hashes, sort = [], [], []
                for exact, tokens, mine in forms:
                    for kind in kinds:
                        k = kind // 2
                        if kind % 2 != exact or len(tokens) < k:
                            continue
                        h = rolled(tokens, k)
                        at = h >> shift
                        ok = np.flatnonzero((bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1)
                        ok = ok[mine[ok] == mine[ok + k - 1]]
                        rows.append(mine[ok])
                        hashes.append(h[ok])
                        sort.append(np.full(len(ok), kind, np.int32))
                if rows and sum(map(len, rows)):
                    key = np.stack([np.concatenate(rows), np.concatenate(hashes).view(np.int64), np.concatenate(sort)], 1)
                    key = key[np.lexsort(key.T)]
                    key = key[np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])]
                    row = pa.array(key[:, 0])
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("tk").take(row), pa.array(key[:, 1]), pa.array(key[:, 2].astype(np.int32))], schema=schema)

    return docs.mapInArrow(run, f"doc_id long, tk long, {_WINDOW}")


def _found(pairs: DataFrame, p: Params) -> DataFrame:
    """``doc_id, tk`` and ``found``: what :meth:`Index.matches` finds in pairs (doc_id, tk, text, item_id, item) of a document and
    an item that share a window. Pairs of a document follow each other, so its text is read once."""
    kind = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int64()), ("coverage", pa.float64()), ("n_changed", pa.int64())])

    def run(batches):
        canon, indexes, held, last, forms = Canon(), {}, 0, None, []
        for b in batches:
            rows = []
            cols = [b.column(c) for c in ("doc_id", "tk", "item_id")]
            for at in range(b.num_rows):
                d, tk, item_id = (c[at].as_py() for c in cols)
                if last != (d, tk):
                    last, forms = (d, tk), canon.forms(b.column("text")[at].as_py())
                item = b.column("item")[at].as_py()
                if item not in indexes:
                    if held > CACHE_CHARS:
                        indexes, held = {}, 0
                    indexes[item] = Index([(0, item)], p)
                    held += len(item)
                rows += [(d, tk, item_id, *got[1:]) for got in indexes[item].matches(forms)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 6, kind, strict=True)], schema=kind)

    got = pairs.mapInArrow(run, f"doc_id long, tk long, {SCHEMA.removeprefix('doc_id long, ')}")
    best = got.groupBy("doc_id", "tk", "item_id").agg(F.max(F.struct("n_tokens", "coverage", "n_changed")).alias("x"))
    return best.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("item_id", "x.n_tokens", "x.coverage", "x.n_changed")).alias("found"))


def _contaminated(docs: DataFrame, benchmark: DataFrame, p: Params) -> DataFrame:
    """``doc_id, tk`` (tells apart the texts of a repeated doc_id) and ``found`` of each distinct document with an item."""
    docs = documents(docs).filter("text is not null").withColumn("tk", text_key())
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).filter("item is not null").distinct()
    items = staged(items.withColumn("ik", F.xxhash64("item")), "items")
    windows = staged(_item_windows(items, p), "item-windows")
    n, size = windows.count(), items.agg(F.sum(F.octet_length("item") + 16)).first()[0] or 0
    kinds = sorted(r["kind"] for r in windows.select("kind").distinct().collect())  # two for each size up to a window
    met = _doc_windows(docs, _mapped(windows, n), kinds, p)
    small = lambda df, bytes_: F.broadcast(df) if bytes_ <= p.block_bytes else df
    pairs = met.join(small(windows, 20 * n), ["h", "kind"]).select(F.col("doc_id").alias("d_"), F.col("tk").alias("t_"), "ik").distinct()
    pairs = staged(pairs, "suspects")
    some, _ = split_by_partner(docs, F.col("tk"), pairs.select("t_").distinct(), F.col("t_"))
    some = some.dropDuplicates(["doc_id", "tk"]).join(pairs, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("tk") == F.col("t_")))
    some = some.select("doc_id", "tk", "text", "ik").join(small(items, size), "ik")
    return _found(some.select("doc_id", "tk", "text", "item_id", "item").sortWithinPartitions("doc_id", "tk"), p)


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """A row for each document and benchmark item whose template it contains: ``doc_id, item_id, n_tokens`` (of the
    longest run), ``coverage`` (its share of the item) and ``n_changed`` (slots with another value).

    Null and empty texts contain nothing; null items and items without a word are contained nowhere; a null item_id is an
    id of its own. Rows that repeat doc_id and text give repeated rows; of repeated items with one id the longest run
    counts. Other columns aren't read. An empty table, of documents or of items, gives none.
    """
    found = staged(_contaminated(docs, benchmark, p), "contaminated")
    rows = documents(docs).select(F.col("doc_id").alias("d_"), text_key().alias("t_"))
    some, _ = split_by_partner(rows, F.col("t_"), found.select("tk"), F.col("tk"))
    out = some.join(found, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("tk") == F.col("t_")))
    return out.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def op10(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; the columns of ``docs``. Items of less than ``least`` words, which any text may
    hold, are reported by :func:`contaminated` but decide nothing here.

    A document goes by its doc_id and text together, so another text of the same doc_id, or of none, stays. Rows with a
    null text stay. Rows that repeat both stay or go together; whatever other columns there are, they are kept.
    """
    p = Params()
    found = _contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), p).filter(F.exists("found", lambda x: x["n_tokens"] >= p.least))
    found = staged(found.select(F.col("doc_id").alias("g_"), F.col("tk").alias("k_")), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col("doc_id").cast("long").alias("d_"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("tk_"))
    some, rest = split_by_partner(rows, F.col("tk_"), found, F.col("k_"))
    kept = some.join(found, F.col("d_").eqNullSafe(F.col("g_")) & (F.col("tk_") == F.col("k_")), "left_anti")
    return kept.unionByName(rest).select("row_.*")
