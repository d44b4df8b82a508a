"""Token ids in files of word-aligned Simple-8b blocks.

Each 64-bit word has a 4-bit selector that tells how many ids of how many bits its other 60 bits hold. An id that
needs more than 60 bits is an escape: its word holds nothing, the id stands in the block's list of escapes. Blocks of
a fixed number of ids start at a word of their own and have their offsets in the file, so any block is decoded by
itself, and whole files are decoded by array operations.

File: header, ids of documents, counts of their ids, word and escape offsets of the blocks, words, escapes, CRC-32.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from codecs import charmap_decode
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamfield.llm.common import documents, fresh_dir, slices, staged, unsliced

#: Fixed values of the file format: (ids in a word, bits of each) by selector; the last is the escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = len(SELECTORS)
MAGIC, VERSION = b"LS8B", 1
HEADER = struct.Struct("<4sIIIQQQQ")
BLOCK = 4096
#: A file is closed with the document that brings it to so many ids, so a writer's memory is bounded whatever a partition holds.
FILE_IDS = 4_000_000
#: Blocks are independent, so ids are packed as they come, so many blocks at a time.
PACK_BLOCKS = 128
NO_ID = -(1 << 63)
U = np.uint64
#: Parts of words that an encoder remembers.
CACHE = 500_000
#: Bytes of text encoded at once: the more, the more often a word is met again.
ENCODE = 4 << 20
TOKENIZER, END = "word_bpe_49k.json", 2


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, word offsets, escape offsets) of ids (unsigned, 64 bits at most)."""
    n, most = len(ids), SELECTORS[0][0]
    blocks, wide = -(-n // block), block + most
    # a row for each block, with zeros after its end, which fit everywhere
    rows = np.zeros((blocks, block), U)
    rows.reshape(-1)[:n] = ids
    rows = np.pad(rows, ((0, 0), (0, most)))
    top = int(ids.max()) if n else 0
    need = np.zeros(rows.shape, np.uint8)  # the first selector with enough bits, of an id and then of ever longer runs
    for s, (_, bits) in enumerate(SELECTORS):
        if top < 1 << bits:
            break
        need += rows >= U(1 << bits)
    choice, run = np.full((blocks, block), ESCAPE, np.uint8), 1
    for s in range(ESCAPE - 1, -1, -1):  # later ones hold more ids and win
        many = SELECTORS[s][0]
        while run < many:
            step = min(run, many - run)
            need = np.maximum(need[:, :-step], need[:, step:])
            run += step
        fits = need[:, :block] <= s
        if not fits.any():
            break  # nor does anything fit in fewer bits
        choice[fits] = s
    choice = choice.reshape(-1)[:n]
    place = np.arange(n)
    nxt = np.minimum(place + np.array([m for m, _ in SELECTORS] + [1])[choice], np.minimum((place // block + 1) * block, n))
    at = _walk(nxt, np.arange(0, n, block), np.minimum(np.arange(block, n + block, block), n))
    sel = choice[at]
    words = sel.astype(U) << U(60)
    flat, first = rows.reshape(-1), at + at // block * most
    for s, (many, bits) in enumerate(SELECTORS):
        of = np.flatnonzero(sel == s)
        if len(of):
            start, word = first[of], words[of]
            for k in range(many):
                word |= flat[start + k] << U(k * bits)
            words[of] = word
    escaped = at[sel == ESCAPE]
    edges = np.arange(0, n + block, block) if n else np.zeros(1, np.int64)
    return words, np.asarray(ids, U)[escaped], np.searchsorted(at, edges).astype(U), np.searchsorted(escaped, edges).astype(U)


def _walk(nxt: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places that are met from each block's start up to its end; the blocks are walked side by side."""
    met, i = np.zeros(len(nxt), bool), starts
    while len(i):
        met[i] = True
        i = nxt[i]
        inside = i < ends
        if not inside.all():
            i, ends = i[inside], ends[inside]
    return np.flatnonzero(met)


def unpack(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of whole blocks; ``offsets``: words before each block, and all words."""
    out = np.zeros(n, U)
    if not n:
        return out
    sel = (words >> U(60)).astype(np.int64)
    many = np.array([m for m, _ in SELECTORS] + [1])[sel]
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    before = np.concatenate([[0], np.cumsum(many)[:-1]])
    start = before - before[offsets[:-1].astype(np.int64)][of] + of * block
    many = np.minimum(many, np.minimum((of + 1) * block, n) - start)
    for s, (most, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(sel == s)
        for k in range(most if len(rows) else 0):
            live = rows[many[rows] > k]
            out[start[live] + k] = (words[live] >> U(k * bits)) & U((1 << bits) - 1)
    out[start[sel == ESCAPE]] = escapes
    return out


class Packer:
    """Takes the ids of documents as they come and keeps nothing but packed blocks; :meth:`finish` gives the file."""

    def __init__(self, block: int = BLOCK):
        self.block, self.n = block, 0
        self.names: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words, self.escapes, self.at, self.esc_at = [], [], [np.zeros(1, U)], [np.zeros(1, U)]
        self.rest = np.zeros(0, np.uint32)

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.names.append(doc_ids.astype("<i8"))
        self.counts.append(counts.astype("<u8"))
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        step = PACK_BLOCKS * self.block
        whole = len(self.rest) // step * step
        for i in range(0, whole, step):
            self._pack(self.rest[i : i + step])
        self.rest = self.rest[whole:].copy()

    def _pack(self, ids: np.ndarray) -> None:
        words, escapes, at, esc_at = pack(ids, self.block)
        self.at.append(at[1:] + self.at[-1][-1])
        self.esc_at.append(esc_at[1:] + self.esc_at[-1][-1])
        self.words.append(words)
        self.escapes.append(escapes)

    def finish(self) -> bytes:
        if len(self.rest):
            self._pack(self.rest)
        parts = self.names + self.counts + self.at + self.esc_at + self.words + self.escapes
        docs, words, escapes = (sum(map(len, x)) for x in (self.names, self.words, self.escapes))
        body = b"".join([HEADER.pack(MAGIC, VERSION, self.block, 0, docs, self.n, words, escapes), *(x.astype(x.dtype.newbyteorder("<")).data for x in parts)])
        return body + struct.pack("<I", zlib.crc32(body))


def dump(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    packer = Packer(block)
    packer.add(doc_ids, counts, ids)
    return packer.finish()


def load(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of documents, counts, ids) of a file; ValueError if it is damaged."""
    if len(data) < HEADER.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged token file")
    magic, version, block, _, docs, n, words, escapes = HEADER.unpack_from(data)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token file of this version")
    blocks, at, parts = -(-n // block), HEADER.size, []
    for size, kind in ((docs, "<i8"), (docs, "<u8"), (blocks + 1, "<u8"), (blocks + 1, "<u8"), (words, "<u8"), (escapes, "<u8")):
        parts.append(np.frombuffer(data, kind, size, at))
        at += 8 * size
    names, counts, at, esc_at, words, escapes = parts
    ids, step = np.empty(n, U), PACK_BLOCKS
    at, esc_at = at.astype(np.int64), esc_at.astype(np.int64)
    for b in range(0, blocks, step):  # some blocks at a time, so that decoding needs little memory beside the ids
        e = min(blocks, b + step)
        ids[b * block : e * block] = unpack(words[at[b] : at[e]], escapes[esc_at[b] : esc_at[e]], at[b : e + 1] - at[b], min(n, e * block) - b * block, block)
    return names, counts.astype(np.int64), ids


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


#: Words of printable ASCII and Latin letters whose lower case is one letter are parted by the kinds of their bytes, as the
#: tokenizer parts them; the library's model gives the ids of each part. Words with an apostrophe are parted by ``_PARTS``,
#: all other words go through the whole tokenizer.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_SIMPLE = re.compile(f"[!-~{_LATIN}]*")
_EVEN = f"^[!-&(-~{_LATIN}]*$"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z{_LATIN}0-9]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes of such words in lower case: letters 1, digits 2, others 0.
_DIGIT = 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_KINDS[ord("0") : ord("9") + 1] = _DIGIT


def _parted(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(parts of words of ``_EVEN``, in order and in lower case; their count for each word)."""
    low = unsliced(pc.utf8_lower(words))
    n, edges = len(low), np.frombuffer(low.buffers()[1], np.int64, len(low) + 1) if len(low) else np.zeros(1, np.int64)
    if not edges[-1]:
        return low.slice(0, 0), np.zeros(n, np.int64)
    kinds = _KINDS[np.frombuffer(low.buffers()[2], np.uint8, edges[-1])]
    first = np.ones(len(kinds) + 1, bool)  # the end of the bytes too
    first[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
    first[edges] = True
    at = np.flatnonzero(first)
    parts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), low.buffers()[2])
    return parts, np.diff(np.searchsorted(at, edges))


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs that start at ``first`` and have ``size`` places, one run after the other."""
    total = np.cumsum(size)
    return np.repeat(first - (total - size), size) + np.arange(total[-1] if len(total) else 0)


class Encoder:
    """Ids of texts, word by word: the tokenizer parts words at white space, so a word's ids don't depend on its neighbours.

    The different words of a call are parted at once; what is remembered are ids of parts, and of the few words that aren't
    parted by their bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.sep = "<|endoftext|>"
        self.sep_id = self.tok.token_to_id(self.sep)
        kind = json.loads(self.tok.to_str())
        steps = [x.get("type") for x in (kind["normalizer"] or {}).get("normalizers", [])], [x.get("type") for x in (kind["pre_tokenizer"] or {}).get("pretokenizers", [])]
        split = ((kind["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.simple = steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and split == _SPLIT
        self.letters = "".join(_byte_letters())
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _part(self, s: str) -> list[int]:
        return [t.id for t in self.model.tokenize(s if s.isascii() else charmap_decode(s.encode(), "strict", self.letters)[0])]

    def _whole(self, words: list[str]) -> list[list[int]]:
        """Ids of words by the whole tokenizer: many in one call, told apart by a special token."""
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        out: list[list[int]] = [[]] * len(words)
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids = self.tok.encode_batch_fast([f" {self.sep} ".join([words[k] for k in some]) + f" {self.sep}"], add_special_tokens=False)[0].ids
            ends = [k for k, x in enumerate(ids) if x == self.sep_id]
            for k, a, b in zip(some, [-1, *ends], ends):
                out[k] = ids[a + 1 : b]
        odd = sorted({*range(len(words))} - {*plain})
        for k, x in zip(odd, self.tok.encode_batch_fast([words[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def _learn(self, parts: list[str], words: list[str]):
        """Remember parts, and words that aren't parted by their bytes."""
        part, ids = self._part, []
        if self.simple:
            ids = [part(x) for x in parts]
            few: list[list[int] | None] = [list(chain.from_iterable(map(part, _PARTS.findall(w.lower())))) if "<|" not in w and _SIMPLE.fullmatch(w) else None for w in words]
        else:
            few = [None] * len(words)
        rest = [k for k, x in enumerate(few) if x is None]
        for k, x in zip(rest, self._whole([words[k] for k in rest]), strict=True):
            few[k] = x
        ids += few
        n = len(self.first) - 1
        self.at.update(zip(chain(parts, words), range(n, n + len(ids))))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)])

    def _places(self, parts: pa.DictionaryArray, words: list[str]) -> np.ndarray:
        """Where the ids of parts and words are remembered; those not met before are learnt."""
        if len(self.at) > CACHE:
            self.clear()
        known = parts.dictionary.to_pylist()
        n = len(known)
        known += words
        of = np.fromiter(map(self.at.get, known, repeat(-1)), np.int64, len(known))
        new = np.flatnonzero(of < 0)
        if len(new):
            of[new] = len(self.first) - 1 + np.arange(len(new))
            cut = int(np.searchsorted(new, n))
            new = [known[i] for i in new.tolist()]
            self._learn(new[:cut], new[cut:])
        return np.concatenate([of[:n][parts.indices.to_numpy(zero_copy_only=False)], of[n:]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their count for each text) of a string array; null is empty."""
        texts = pc.fill_null(unsliced(texts).cast(pa.large_string()), "")
        # A-Z may be folded first, as the tokenizer folds case, but not where a special token could come to be
        folded = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(folded)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        words = coded.dictionary
        even = pc.and_not(pc.match_substring_regex(words, _EVEN), pc.match_substring(words, "<|")) if self.simple else pa.array(np.zeros(len(words), bool))
        parts, many = _parted(words.filter(even))
        odd = words.filter(pc.invert(even)).to_pylist()
        even = even.to_numpy(zero_copy_only=False)
        at = self._places(pc.dictionary_encode(parts), odd)
        # ids of the different words, those parted by their bytes first
        size = self.first[at + 1] - self.first[at]
        flat = self.flat[_runs(self.first[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(np.concatenate([many, np.ones(len(odd), np.int64)]))])]
        of = np.empty(len(words), np.int64)
        of[np.concatenate([np.flatnonzero(even), np.flatnonzero(~even)])] = np.arange(len(words))
        of = of[coded.indices.to_numpy(zero_copy_only=False)]
        size = np.diff(ends)[of]
        ids = flat[_runs(ends[of], size)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it remembers serves all of the worker's tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _write(uri: str, data: bytes) -> None:
    """All or nothing: a second attempt of a task puts the same bytes in the same place."""
    import uuid

    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(uri)
    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
    name = f"{path}.{uuid.uuid4().hex}.tmp"
    with at.open_output_stream(name) as out:
        out.write(data)
    at.move(name, path)


def _read(uri: str) -> bytes:
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(uri)
    with at.open_input_file(path) as f:
        return f.read()


MANIFEST = "part long, piece long, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str | None = None, end_id: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of ``docs`` to files below ``out_dir``, in ascending doc_id order from file to file (nulls first; rows
    that repeat a doc_id in the order of their texts), and return the manifest: ``part, piece, path, n_docs, n_ids``.

    ``out_dir``: a URI that all executors reach. Null text is empty; each document ends with ``end_id``.
    """
    ranged = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer or tokenizer_path())
        packer, piece = Packer(), 0

        def flush():
            path = f"{out_dir}/tokens-{part:06d}-{piece:05d}.s8b"
            _write(path, packer.finish())
            return pa.RecordBatch.from_pydict({"part": [part], "piece": [piece], "path": [path], "n_docs": [sum(map(len, packer.names))], "n_ids": [packer.n]})

        for whole in batches:
            for batch in slices(whole, ENCODE):
                ids, counts = enc.encode(batch.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                names, counts = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False), counts + 1
                ends, at = np.cumsum(counts), 0
                while at < len(names):  # a file ends with the document that fills it
                    before = int(ends[at - 1]) if at else 0
                    stop = min(len(names), int(np.searchsorted(ends, before + file_ids - packer.n)) + 1)
                    packer.add(names[at:stop], counts[at:stop], ids[before : ends[stop - 1]])
                    at = stop
                    if packer.n >= file_ids:
                        yield flush()
                        packer, piece = Packer(), piece + 1
        if packer.n:
            yield flush()

    return ranged.mapInArrow(run, MANIFEST)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files of a manifest; start counts all ids before it."""
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not each document
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                names, counts, ids = load(_read(path))
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, mask=names == NO_ID), "start": base + ends - counts, "n_tokens": counts, "ids_crc32": pa.array(crc, pa.int64())})

    n = max(1, manifest.count())
    return files.repartition(min(n, 10_000), "path").mapInArrow(run, ROWS)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = staged(write_tokens(docs, fresh_dir(spark, "tokens")), "tokens-manifest")
    return read_tokens(manifest)
