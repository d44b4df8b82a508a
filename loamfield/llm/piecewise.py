"""SentencePiece encoding and decoding with the N best segmentations.

A text, with a mark for each space, is a lattice of vocabulary pieces. The forward Viterbi pass gives every position
the best score of a path from the start; the search then goes backward from the end, best first, with those scores as
exact heuristics (A*), so that it expands only what the N best need.

The lattice falls apart wherever no piece spans two neighbouring characters, so each word (a mark and what follows it)
is searched by itself; the N best of the whole come from the smallest losses of single words, as no better whole can
use a word whose loss is not among the N - 1 smallest. The forward pass runs over all new words of a slice of texts at
once, as array operations, and keeps the best two: a word's best ids and how much its second best loses. The A* search
runs for the N - 1 words of each text with the least losses, and its lists make the N segmentations.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamfield.llm.common import slices, unsliced

N_BEST = 4
MARK = "▁"
#: A character that no piece holds costs so much more than the worst piece, and is written as its bytes.
UNKNOWN = 10.0
#: Words that a lattice remembers, and of how many it remembers the N best.
CACHE, CACHE_LISTS = 300_000, 50_000
#: Longer words, and words with characters that are no pieces, take the forward pass one by one.
LONGEST_WORD = 40
#: Words that take the forward pass together.
TOGETHER = 20_000
MODEL = "piece_bpe_32k.model"
INF = float("inf")
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """All beginnings of pieces as numbered nodes (0: the empty one), with a hash table of the steps between them."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        nodes = {"": 0}
        for p in pieces:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        self.score = np.full(len(nodes), -INF)
        self.piece = np.full(len(nodes), -1, np.int32)
        self.size = np.zeros(len(nodes), np.int32)
        for p, k in nodes.items():
            self.size[k] = len(p)
            if p in pieces:
                self.piece[k], self.score[k] = pieces[p]
        bits = max(4, (4 * len(nodes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.next = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)  # no step has key 0, as no piece has a null character first
        for p, k in nodes.items():
            if p:
                key = (nodes[p[:-1]] << 21 | ord(p[-1])) + 1
                at = (key * int(_MIX) & (1 << 64) - 1) >> int(self.shift)
                while self.keys[at]:
                    at = (at + 1) & int(self.mask)
                self.keys[at], self.next[at] = key, k

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node after a letter; -1: none."""
        key = (node.astype(np.uint64) << np.uint64(21) | letter) + np.uint64(1)
        at = (key * _MIX >> self.shift).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == key, self.next[at], -1)
        left = np.flatnonzero((held != key) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            out[left[held == key[left]]] = self.next[at[left]][held == key[left]]
            left = left[(held != key[left]) & (held != 0)]
        return out


class Lattice:
    """Vocabulary of one model file and the search over it."""

    def __init__(self, path: str, n_best: int = N_BEST):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                self.pieces[piece] = (i, sp.get_score(i))
                self.surface.append(piece.replace(MARK, " ").encode())
        self.unknown = min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - UNKNOWN
        self.longest = max(map(len, self.pieces), default=1)
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.trie = {p[:i]: -INF for p in self.pieces for i in range(1, len(p))} | {p: s for p, (_, s) in self.pieces.items()}
        self.steps = Trie(self.pieces)
        self.bytes_of = pa.array(self.surface, pa.binary())
        self.lists: dict[str, list] = {}
        self.alone, self.apart = np.zeros(0x110000, bool), np.ones(0x110000, bool)  # characters that are pieces; that are in no piece
        self.alone[[ord(p) for p in self.pieces if len(p) == 1]] = True
        self.apart[sorted({ord(c) for p in self.pieces for c in p})] = False
        self.clear()

    def clear(self):
        """Forget the words met so far."""
        self.at: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)

    def trim(self):
        """Forget the words if they are more than half of what may be remembered."""
        if len(self.at) > CACHE // 2:
            self.clear()
            self.lists.clear()

    def edges(self, s: str) -> list[list[tuple[int, float]]]:
        """For each end position, (start, score) of the pieces that end there; a character without one is an edge too."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(s) + 1)]
        for i in range(len(s)):
            alone = True
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                score = self.trie.get(s[i:j])
                if score is None:
                    break
                if score > -INF:
                    out[j].append((i, score))
                    alone = alone and j != i + 1
            if alone:
                out[i + 1].append((i, self.unknown))
        return out

    def ids(self, s: str) -> list[int]:
        got = self.pieces.get(s)
        return [got[0]] if got else [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]

    @staticmethod
    def forward(edges: list) -> list[float]:
        """Best score of a path from the start to each position."""
        best = [0.0] + [-INF] * (len(edges) - 1)
        for j in range(1, len(edges)):
            best[j] = max(best[i] + score for i, score in edges[j]) if edges[j] else -INF
        return best

    def part(self, s: str) -> tuple[tuple[int, ...], float, float]:
        """(ids of the best segmentation, its score, how much the second best loses): a forward pass for the best two."""
        n, get = len(s), self.trie.get
        best, second, back = [-INF] * (n + 1), [-INF] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            a, b, alone = best[i], second[i], True
            for j in range(i + 1, min(n, i + self.longest) + 1):
                score = get(s[i:j])
                if score is None:
                    break
                if score > -INF:
                    if j == i + 1:
                        alone = False
                    x = a + score
                    if x > best[j]:
                        second[j] = max(best[j], b + score)
                        best[j], back[j] = x, i
                    elif x > second[j]:
                        second[j] = x
            if alone:
                x, j = a + self.unknown, i + 1
                if x > best[j]:
                    second[j] = max(best[j], b + self.unknown)
                    best[j], back[j] = x, i
                elif x > second[j]:
                    second[j] = x
        ids: list[int] = []
        while n:
            ids[:0] = self.ids(s[back[n] : n])
            n = back[n]
        return tuple(ids), best[-1], best[-1] - second[-1]

    def search(self, s: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best (score, ids) of a part, best first: backward best-first search, forward scores as heuristics."""
        got = self.lists.get(s)
        if got is None:
            if len(self.lists) > CACHE_LISTS:
                self.lists.clear()
            edges = self.edges(s)
            best = self.forward(edges)
            heap, n, got = [(-best[-1], 0, len(s), 0.0, None)], 0, []
            while heap and len(got) < self.n_best:
                _, _, j, score, path = heapq.heappop(heap)
                if not j:
                    out, at = [], path
                    while at:
                        out += self.ids(s[at[0] : at[1]])
                        at = at[2]
                    got.append((score, tuple(out)))
                    continue
                for i, w in sorted(edges[j]):
                    n += 1
                    heapq.heappush(heap, (-(best[i] + w + score), n, i, score + w, (i, j, path)))
            self.lists[s] = got
        return got

    def cut(self, s: str) -> list[str]:
        """The parts of a unit: no piece spans a border between two."""
        out, at = [], 0
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in self.joined:
                out.append(s[at:i])
                at = i
        out.append(s[at:])
        return out

    def best_of(self, lists: list[list[tuple]]) -> list[tuple]:
        """The N smallest sums of one loss from each list (ascending, the first 0), each with what was chosen."""
        total = [(0.0, ())]
        for x in lists:
            total = heapq.nsmallest(self.n_best, ((a + b, (*c, d)) for a, c in total for b, d in x), key=lambda y: y[0])
        return total

    def word_lists(self, w: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best (loss, ids) of a mark and the word after it."""
        parts = map(self.search, self.cut(MARK + w))
        return [(x, tuple(chain.from_iterable(ids))) for x, ids in self.best_of([[(s[0][0] - x, ids) for x, ids in s] for s in parts])]

    def forward_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, their counts, best score, least loss) of strings whose characters are pieces: the forward pass for the
        best two over all of them at once, place by place, and the way back along the best."""
        t, m = self.steps, len(parts)
        size = np.fromiter(map(len, parts), np.int64, m)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        code = np.frombuffer("".join([parts[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.cumsum(size) - size
        longest = int(size[0])
        reach = np.searchsorted(-size, -np.arange(longest + 1))  # so many words, the first ones, have a letter at a place
        best, second = np.full((longest + 1, m), -INF), np.full((longest + 1, m), -INF)
        last = np.zeros((longest + 1, m), np.int32)
        best[0] = 0.0
        for i in range(longest):
            rows = np.arange(reach[i])
            node = np.zeros(len(rows), np.int32)
            for j in range(i, min(longest, i + self.longest)):
                live = int(np.searchsorted(rows, reach[j]))
                rows = rows[:live]
                node = t.step(node[:live], code[start[rows] + j])
                ok = node >= 0
                rows, node = rows[ok], node[ok]
                if not len(rows):
                    break
                w = t.score[node]
                has = w > -INF
                r, w, n = rows[has], w[has], node[has]
                x, old = best[i, r] + w, best[j + 1, r]
                more = x > old
                second[j + 1, r] = np.where(more, np.maximum(old, second[i, r] + w), np.maximum(second[j + 1, r], x))
                r = r[more]
                best[j + 1, r], last[j + 1, r] = x[more], n[more]
        ids, at, count = np.zeros((m, longest), np.int32), size.copy(), np.zeros(m, np.int64)
        while len(rows := np.flatnonzero(at)):
            n = last[at[rows], rows]
            count[rows] += 1
            ids[rows, longest - count[rows]] = t.piece[n]
            at[rows] -= t.size[n]
        back = np.empty(m, np.int64)
        back[order] = np.arange(m)
        ids, count = ids[back], count[back]
        every = np.arange(m)
        top = best[size, every]
        return ids[np.arange(longest) >= longest - count[:, None]], count, top[back], (top - second[size, every])[back]

    def learn(self, words: list[str]) -> None:
        """Remember the best ids, score and least loss of new words (a mark stands before each)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = np.zeros(len(words), bool)
        odd[np.repeat(np.arange(len(words)), size)[~self.alone[code]]] = True
        # a character that is in no piece parts a word
        loose = "".join(re.escape(chr(c)) for c in np.unique(code[self.apart[code]]).tolist())
        cut = re.compile(f"[{loose}]|[^{loose}]+").findall if loose else lambda w: [w]
        parts: dict[str, int] = {}
        made, many = [], np.ones(len(words), np.int64)
        for k, w in enumerate(words):
            if odd[k]:
                some = cut(MARK + w)
                many[k] = len(some)
                made += [parts.setdefault(x, len(parts)) for x in some]
            else:
                made.append(parts.setdefault(MARK + w, len(parts)))
        names = list(parts)
        slow = np.fromiter((len(x) > LONGEST_WORD or not self.alone[ord(MARK)] for x in names), bool, len(names))
        for x in {x for k in np.flatnonzero(odd).tolist() for x in cut(MARK + words[k])}:
            slow[parts[x]] |= not all(self.alone[ord(c)] for c in x)
        count, score, loss = np.zeros(len(names), np.int64), np.zeros(len(names)), np.zeros(len(names))
        order, flats = [], []
        for i in np.flatnonzero(slow).tolist():
            got = [self.part(x) for x in self.cut(names[i])]
            flats.append(np.fromiter(chain.from_iterable(x[0] for x in got), np.int32))
            count[i], score[i], loss[i] = len(flats[-1]), sum(x[1] for x in got), min(x[2] for x in got)
            order.append(i)
        fast = np.flatnonzero(~slow)
        for k in range(0, len(fast), TOGETHER):
            some = fast[k : k + TOGETHER]
            flat, count[some], score[some], loss[some] = self.forward_all([names[i] for i in some.tolist()])
            flats.append(flat)
            order += some.tolist()
        at = np.zeros(len(names), np.int64)
        at[order] = np.cumsum(count[order]) - count[order]
        made, first = np.array(made, np.int64), np.cumsum(many) - many
        size = count[made]
        flat = np.concatenate(flats)[np.repeat(at[made] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        n = len(self.at)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.add.reduceat(size, first))])
        self.flat = np.concatenate([self.flat, flat])
        self.score, self.loss = np.concatenate([self.score, np.add.reduceat(score[made], first)]), np.concatenate([self.loss, np.minimum.reduceat(loss[made], first)])

    @staticmethod
    def words_of(texts: pa.Array) -> pa.Array:
        """The words of texts (no nulls) as lists; the empty text has none. They begin where a mark follows another letter."""
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, MARK))
        lists = pc.split_pattern(texts, " ")
        odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        if not odd.any():
            return lists
        own = [[u[1:] for u in _UNITS.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        pool = pa.concat_arrays([lists, pa.array(own, lists.type)])
        take = np.arange(len(texts))
        take[odd] = len(texts) + np.arange(len(own))
        return pool.take(pa.array(take))

    def encode_texts(self, texts: pa.Array) -> list[tuple[list[np.ndarray], list[float]]]:
        """For each text (null: empty) the ids of its N best segmentations and their scores, best first.

        Of words with equal losses the first count; a segmentation of equal score keeps the order in which it was found.
        """
        texts = pc.fill_null(unsliced(texts).cast(pa.large_string()), "")
        lists = self.words_of(texts)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        names = coded.dictionary.to_pylist()
        if len(self.at) > CACHE:
            self.clear()
        of = list(map(self.at.get, names))
        if None in of:
            self.learn([w for w, i in zip(names, of, strict=True) if i is None])
            of = list(map(self.at.__getitem__, names))
        which = coded.indices.to_numpy(zero_copy_only=False)
        of = np.array(of, np.int64)[which]
        size = self.first[of + 1] - self.first[of]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[of] - total[:-1], size) + np.arange(total[-1])]
        ends = lists.offsets.to_numpy()
        ends = ends - ends[0]
        few, out = self.n_best - 1, []
        score, loss = self.score[of], self.loss[of]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            mine, lost = ids[total[a] : total[b]], loss[a:b]
            if len(lost) > few > 0:
                near = np.flatnonzero(lost <= np.partition(lost, few - 1)[few - 1])
                near = near[np.argsort(lost[near], kind="stable")][:few]
            else:
                near = np.arange(len(lost) if few else 0)
            near = sorted(k for k in near.tolist() if lost[k] < INF)
            found = self.best_of([self.word_lists(names[which[a + k]]) for k in near])
            top = sum(score[a:b].tolist())
            every = [mine]
            for _, chosen in found[1:]:
                parts, at = [], 0
                for k, x in zip(near, chosen, strict=True):
                    parts += [mine[at : total[a + k] - total[a]], np.array(x, np.int32)]
                    at = total[a + k + 1] - total[a]
                every.append(np.concatenate([*parts, mine[at:]]))
            out.append((every, [top - x for x, _ in found]))
        return out

    def encode_all(self, text: str) -> tuple[list[list[int]], list[float]]:
        """Ids of the N best segmentations and their scores, best first."""
        ids, scores = self.encode_texts(pa.array([text]))[0]
        return [x.tolist() for x in ids], scores

    def decode_all(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of many lists of ids, as bytes."""
        got = self.bytes_of.take(pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        ends = np.frombuffer(got.buffers()[1], np.int32, len(got) + 1)[np.concatenate([[0], np.cumsum([len(x) for x in ids])])].tolist()
        raw = got.buffers()[2].to_pybytes() if got.buffers()[2] else b""
        return [raw[a + (raw[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, text: str) -> tuple[list[int], list[float]]:
        """Ids of the best segmentation, and the scores of the N best, best first."""
        ids, scores = self.encode_all(text)
        return ids[0], scores

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces again, the first of which was added; byte pieces are bytes."""
        out = b"".join([self.surface[i] for i in ids]).decode("utf-8", "surrogatepass")
        return out[1:] if out[:1] == " " else out


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LATTICES: dict[tuple, Lattice] = {}


def lattice_of(path: str, n_best: int) -> Lattice:
    """One for each worker process, so that what it remembers serves all of the worker's tasks."""
    if (path, n_best) not in _LATTICES:
        _LATTICES[path, n_best] = Lattice(path, n_best)
    return _LATTICES[path, n_best]


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, best_score double, nbest_scores array<double>, round_trip boolean, nbest_ids array<array<int>>"


def _nested(values: list, kind: pa.DataType) -> pa.ListArray:
    """A list column of lists or arrays, of which there is one at least."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values), kind))


def segment(docs: DataFrame, model: str | None = None, n_best: int = N_BEST, carry: bool = False) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_pieces, ids_crc32`` (of the best segmentation's ids as little-endian
    unsigned 32-bit integers), ``best_score, nbest_scores`` (up to ``n_best``, best first), ``round_trip`` (whether
    decoding gives the text back; a text that holds the mark itself reads as a space there) and ``nbest_ids`` (the ids of
    each segmentation, in the order of the scores).

    Null text is encoded as empty: no pieces, score 0. Ties of score fall to the longest last piece. Repeated rows get
    equal results; an empty table gives none; other columns aren't read. ``model``: a path that exists on every
    executor (absent: the public 32k model of the installed package). With ``carry`` all columns of ``docs`` stand before
    the results, which take the place of columns of their names.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    held = [*(["text"] if carry else []), *[f"in{i}_" for i in range(len(rest))]]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"in{i}_") for i, c in enumerate(rest)])
    results = StructType.fromDDL(SCHEMA)

    def run(batches):
        lattice = lattice_of(model or model_path(), n_best)
        for b in batches:
            for part in slices(b):
                texts = pc.fill_null(unsliced(part.column("text")).cast(pa.large_string()), "")
                found = lattice.encode_texts(texts)
                ids, scores = [x for x, _ in found], [y for _, y in found]
                back = lattice.decode_all([x[0] for x in ids])
                lists = list(chain.from_iterable(ids))
                counts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = {
                    "doc_id": part.column("doc_id"), "n_pieces": pa.array([len(x[0]) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x[0].astype("<u4").tobytes()) for x in ids], pa.int64()), "best_score": pa.array([x[0] for x in scores], pa.float64()),
                    "nbest_scores": _nested(scores, pa.float64()), "round_trip": pc.equal(pa.array(back, pa.large_binary()), texts.cast(pa.large_binary())),
                    "nbest_ids": pa.ListArray.from_arrays(counts, _nested(lists, pa.int32())),
                }
                yield pa.RecordBatch.from_pydict(columns | {c: part.column(c) for c in held})
            lattice.trim()  # what a worker remembers is bounded, and less while it waits

    out = source.mapInArrow(run, StructType([*results.fields, *[source.schema[c] for c in held]]))
    if not carry:
        return out
    names = {"doc_id": "doc_id", "text": "text"} | {c: f"in{i}_" for i, c in enumerate(rest)}
    new = [f.name for f in results.fields if f.name != "doc_id"]
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns if c not in new], *new)


def op5(spark, sf_dir: str) -> DataFrame:
    """The figures of :func:`segment`, which derives them from the ids."""
    return segment(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("nbest_ids")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every document that is left, with all its columns, encoded (``nbest_ids``) and decoded again. Null
    and empty texts have no pieces; repeated rows get equal results; an empty table gives none."""
    return segment(docs, carry=True)
