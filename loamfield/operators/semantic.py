"""Chunkers and compressors that look at tokens, sentences and vectors. Lengths are code points.

Models are the caller's: a function of a list of texts that gives a vector for each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
# Fixed value: a sentence ends at ., ! or ? and white space, but not after these abbreviations.
SENTENCE_END = r"(?<!\b(?:Mr|Mrs|Ms|Dr|Jr|Sr|vs|etc|e\.g|i\.e))\.\s+|[!?]\s+"


def sentences(text: Column) -> Column:
    """Sentences, trimmed, without the marks at which they were parted."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


_SHORT = ("Mr", "Mrs", "Ms", "Dr", "Jr", "Sr", "vs", "etc", "e.g", "i.e")
_END = re.compile(r"\.\s+|[!?]\s+")
_WORD_BEFORE = re.compile(r"\b(?:" + "|".join(re.escape(x) for x in _SHORT) + r")$")


def split_sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(text):
        if m[0][0] == "." and _WORD_BEFORE.search(text, max(0, m.start() - 4), m.start()):
            continue
        out.append(text[at : m.start()].strip())
        at = m.end()
    return [s for s in [*out, text[at:].strip()] if s]


def cosine(a, b) -> float:
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    n = math.sqrt(float(a @ a) * float(b @ b)) if len(a) == len(b) else 0.0
    return float(a @ b) / n if n else 0.0


def groups(parts: list[str], vectors: list, percentile: float = 0.25, least: int = 100, most: int = 1500) -> list[list[str]]:
    """Neighbouring parts together: parted where their likeness falls below a percentile of all; groups that are too short join
    their shorter neighbour (the left one of equals), those that are too long are split greedily."""
    if len(parts) < 2:
        return [list(parts)] if parts else []
    near = [cosine(a, b) for a, b in zip(vectors[:-1], vectors[1:], strict=True)]
    p = min(max(percentile, 0.01), 0.99)
    bound = sorted(near)[min(math.floor(p * len(near)), len(near) - 1)]
    out = [[parts[0]]]
    for s, x in zip(near, parts[1:], strict=True):
        if s < bound:
            out.append([])
        out[-1].append(x)
    size = lambda g: sum(map(len, g)) + max(0, len(g) - 1)
    while len(out) > 1 and (i := next((i for i, g in enumerate(out) if size(g) < least), None)) is not None:
        if i == 0 or i == len(out) - 1:
            j = 1 if i == 0 else i - 1
        else:
            j = i - 1 if size(out[i - 1]) <= size(out[i + 1]) else i + 1
        lo, hi = sorted((i, j))
        out[lo : hi + 1] = [out[lo] + out[hi]]
    split = []
    for g in out:
        if size(g) <= most:
            split.append(g)
            continue
        held: list[str] = []
        for x in g:
            if held and size([*held, x]) > most:
                split.append(held)
                held = []
            held.append(x)
        split.append(held)
    return split


# ---- groups of sentences by expressions -------------------------------------------------------------------------------
_SPAN = "struct<a: int, b: int, size: int>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _joined(x: Column, y: Column) -> Column:
    return F.struct(x["a"].alias("a"), y["b"].alias("b"), (x["size"] + y["size"] + 1).alias("size"))


def _ends(starts: Column, end: Column) -> Column:
    return F.transform(starts, lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get(starts, i + 1), end).alias("b")))


def _parted(vectors: Column, percentile: float) -> Column:
    """The numbers of the sentences that begin a group: the first, and those less like the one before than the percentile."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    own = F.transform(vectors, lambda v: dot(v, v))  # once for each vector
    like = lambda x, y, u, v: _let(F.sqrt(u * v), lambda n: F.when((F.size(x) == F.size(y)) & (n > 0), dot(x, y) / n).otherwise(0.0))
    pair = lambda a, i: (F.get(a, i), F.get(a, i + 1))
    near, p = _let(own, lambda o: F.transform(F.sequence(F.lit(0), F.size(vectors) - 2), lambda i: like(*pair(vectors, i), *pair(o, i)))), min(max(percentile, 0.01), 0.99)
    bound = lambda n: F.get(F.array_sort(n), F.least(F.floor(F.size(n) * F.lit(p)), F.size(n) - 1).cast("int"))
    below = lambda n, b: F.filter(F.transform(n, lambda s, i: F.when(s < b, i + 1)), lambda i: i.isNotNull())
    return F.concat(F.array(F.lit(0)), _let(near, lambda n: _let(bound(n), lambda b: below(n, b))))


def _long_enough(sized: Column, least: int) -> Column:
    """Groups that are too short join their shorter neighbour, the left one of equals: one walk from left to right, in which all
    that is passed is long enough, ``last`` is the one passed last and ``wait`` what must go on to the right."""
    none = F.lit(None).cast(_SPAN)
    state = lambda done, last, wait: F.struct(done.alias("done"), last.alias("last"), wait.alias("wait"))

    def step(s, i):
        def place(cur):
            after, last = F.get(sized, i + 1), s["last"]
            pushed = F.when(last.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(last)))
            left = last.isNotNull() & (after.isNull() | (last["size"] <= after["size"]))
            return (
                F.when(cur["size"] >= least, state(pushed, cur, none))
                .when(left, state(s["done"], _joined(last, cur), none))
                .when(after.isNull(), state(s["done"], cur, none))
                .otherwise(state(s["done"], last, cur))
            ).cast(f"struct<done: array<{_SPAN}>, last: {_SPAN}, wait: {_SPAN}>")

        x = F.get(sized, i)
        return _let(F.when(s["wait"].isNull(), x).otherwise(_joined(s["wait"], x)), place)

    start = state(F.array().cast(f"array<{_SPAN}>"), none, none).cast(f"struct<done: array<{_SPAN}>, last: {_SPAN}, wait: {_SPAN}>")
    return F.aggregate(F.sequence(F.lit(0), F.size(sized) - 1), start, step, lambda s: F.concat(s["done"], F.array(s["last"])))


def _short_enough(group: Column, lens: Column, most: int) -> Column:
    """A group of more than ``most`` characters as groups that are filled one after the other."""
    typed = "struct<starts: array<int>, held: int>"
    state = lambda starts, held: F.struct(starts.alias("starts"), held.alias("held")).cast(typed)

    def step(s, j):
        more = s["held"] + 1 + F.get(lens, j)
        return F.when(more > most, state(F.concat(s["starts"], F.array(j)), F.get(lens, j))).otherwise(state(s["starts"], more))

    rest = F.filter(F.sequence(group["a"], group["b"] - 1), lambda j: j > group["a"])
    starts = F.aggregate(rest, state(F.array(group["a"]), F.get(lens, group["a"])), step, lambda s: s["starts"])
    whole = F.array(F.struct(group["a"].alias("a"), group["b"].alias("b")))
    return F.when(group["size"] > most, _let(starts, lambda x: _ends(x, group["b"]))).otherwise(whole)


def spans_by_meaning(docs: DataFrame, parts: str, vectors: str, percentile: float = 0.25, least: int = 100, most: int = 1500) -> DataFrame:
    """``docs`` with ``spans``: the groups of :func:`groups` as structs of the first sentence and the one after the last, from
    0, for arrays of sentences and of their vectors. Expressions alone, a row a document: nothing is shuffled. Without
    sentences there are no spans. Vectors of a single sentence aren't looked at."""
    chars = lambda lens, g: (F.aggregate(F.slice(lens, g["a"] + 1, g["b"] - g["a"]), F.lit(0), lambda s, x: s + x) + g["b"] - g["a"] - 1).cast("int")
    sized = lambda lens, starts: F.transform(_ends(starts, F.size(lens)), lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b"), chars(lens, g).alias("size")))
    cut = lambda lens, groups: F.flatten(F.transform(groups, lambda g: _short_enough(g, lens, most)))
    # bound one by one, so that nothing is computed again for each sentence
    spans = _let(F.transform(parts, lambda x: F.length(x)), lambda lens: _let(
        F.when(F.size(lens) > 1, _let(F.col(vectors), lambda v: _parted(v, percentile))).otherwise(F.array(F.lit(0))), lambda starts: _let(
            sized(lens, starts), lambda groups: _let(_long_enough(groups, least), lambda merged: cut(lens, merged)))))
    return docs.withColumn("spans", F.when(F.size(parts) > 0, spans).otherwise(F.array().cast("array<struct<a: int, b: int>>")))


def embedded(embed: Embed):
    """A column function: arrays of sentences -> arrays of their vectors, all sentences of a batch of rows in one call."""

    @F.pandas_udf("array<array<double>>")
    def run(parts: pd.Series) -> pd.Series:
        texts = [[] if p is None else list(p) for p in parts]
        flat = [x for t in texts for x in t]
        got, out, at = embed(flat) if flat else [], [], 0
        for t in texts:
            out.append([[float(c) for c in v] for v in got[at : at + len(t)]])
            at += len(t)
        return pd.Series(out)

    return run


def meaning_chunks(docs: DataFrame, embed: Embed | None = None, percentile: float = 0.25, least: int = 100, most: int = 1500) -> DataFrame:
    """``doc_id, chunk_index, first, n_sentences, text``: chunks of neighbouring sentences that are alike, by expressions but
    for the model. Without ``embed`` the vectors are read from ``vectors``, an array beside the text that has one for each of
    its :func:`sentences`. Null and blank texts have no chunks."""
    some = docs.withColumn("parts_", sentences(F.col("text")))
    some = some.withColumn("vectors_", F.col("vectors") if embed is None else embedded(embed)("parts_"))
    spans = spans_by_meaning(some, "parts_", "vectors_", percentile, least, most)
    # outer, as else a filter on the spans' number is inferred, below shuffles too, that computes all of them a second time
    c = spans.select("doc_id", F.posexplode_outer("spans").alias("chunk_index", "s"), "parts_").filter("s is not null")
    n = F.col("s.b") - F.col("s.a")
    return c.select("doc_id", "chunk_index", F.col("s.a").alias("first"), n.alias("n_sentences"), F.array_join(F.slice("parts_", F.col("s.a") + 1, n), " ").alias("text"))


CHUNKS = "doc_id long, chunk_index int, start_pos int, end_pos int, text string"


def _run(docs: DataFrame, cut: Callable[[list[str]], list[list[tuple[int, int, str]]]], schema: str = CHUNKS) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            rows = [(d, i, *c) for d, got in zip(b["doc_id"].astype("Int64"), cut(texts), strict=True) for i, c in enumerate(got)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def semantic_chunks(docs: DataFrame, embed: Embed, percentile: float = 0.25, least: int = 100, most: int = 1500) -> DataFrame:
    """Chunks of neighbouring sentences that are alike; positions are those of the first and last sentence. Null and blank
    texts have none."""

    def cut(texts):
        out = []
        for t in texts:
            parts = split_sentences(t)
            got, at = [], 0
            for g in groups(parts, embed(parts) if len(parts) > 1 else [], percentile, least, most):
                start = t.find(g[0], at)
                start = at if start < 0 else start
                last = t.find(g[-1], start)
                body = " ".join(g)
                end = last + len(g[-1]) if last >= 0 else start + len(body)
                got.append((start, end, body))
                at = end
            out.append(got)
        return out

    return _run(docs, cut)


def refine(chunks: DataFrame, embed: Embed, least: int = 100, most: int = 1500, percentile: float = 0.25) -> DataFrame:
    """Chunks of ``least`` characters or more, chunked again by meaning; the shorter ones pass. Numbered anew."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, c in g.sort_values("chunk_index").iterrows():
            parts = split_sentences(c["text"]) if len(c["text"]) >= least else []
            got = [" ".join(x) for x in groups(parts, embed(parts) if len(parts) > 1 else [], percentile, least, most)] if parts else [c["text"]]
            rows += [(c["doc_id"], t) for t in got]
        return pd.DataFrame([(d, i, t) for i, (d, t) in enumerate(rows)], columns=["doc_id", "chunk_index", "text"])

    return chunks.select("doc_id", "chunk_index", "text").groupBy("doc_id").applyInPandas(run, "doc_id long, chunk_index int, text string")


def _encoder(path: str):
    held: list = []

    def get():
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return held[0]

    return get


def token_chunks(docs: DataFrame, tokenizer: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` tokens, ``size - overlap`` apart, decoded and trimmed; blank ones are left out. Positions count
    tokens. Windows that hold nothing but overlap are given too. ``tokenizer``: the path of a tokenizer file."""
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    get, step = _encoder(tokenizer), max(1, size - overlap)

    def cut(texts):
        tok, out = get(), []
        for t in texts:
            ids = tok.encode(t, add_special_tokens=False).ids
            found = [(i, min(i + size, len(ids)), tok.decode(ids[i : i + size], skip_special_tokens=False).strip()) for i in range(0, len(ids), step)]
            out.append([x for x in found if x[2]])
        return out

    return _run(docs, cut)


def token_windows(n: int, spans: list[tuple[int, int]], size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Character windows over tokens at ``spans`` of a text of n characters. Without overlap they cover the text without gaps;
    else they begin and end with tokens. Windows that add nothing are dropped; the last token ends them."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap below it")
    out, done = [], 0
    for i in range(0, len(spans), size - overlap):
        last = min(i + size, len(spans))
        a, b = spans[i][0], spans[last - 1][1]
        if not overlap:
            a, b = (0 if i == 0 else spans[i][0]), (n if last == len(spans) else spans[last][0])
        if b > done or not out:
            out.append((a, b))
            done = max(done, b)
        if last == len(spans):
            break
    return out


#: Words whose places are counted together.
_BLOCK = 64


def word_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """The windows of :func:`token_windows` over runs that aren't white space, as structs (start_pos, end_pos), by expressions
    alone. A text's words are found once; what stands before a word is known for every ``_BLOCK`` words and counted from there,
    so that time grows with the text alone."""
    step, nothing = size - overlap, F.array().cast("array<int>")
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\s*\S+"), F.lit(0))  # a word with the space before it
    total = lambda lens, first, n: F.aggregate(F.slice(lens, first + 1, n), F.lit(0), lambda s, x: s + x)

    def before(lens):  # places of the ends of blocks, from 0
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(lens) - 1) / _BLOCK), F.lit(0)).cast("int"))
        sums = F.transform(blocks, lambda j: total(lens, j * _BLOCK, F.lit(_BLOCK)))
        add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        return F.aggregate(sums, F.concat(nothing, F.array(F.lit(0))), add)

    def windows(words, lens, done):
        place = lambda i: F.get(done, F.floor(i / _BLOCK).cast("int")) + total(lens, i - i % _BLOCK, i % _BLOCK)
        space = lambda i: F.get(lens, i) - F.length(F.regexp_replace(F.get(words, i), r"^\s+", ""))
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), lambda i: (i == 0) | (i + overlap < F.size(words)))
        pair = lambda i: F.struct((place(i) + space(i)).cast("int").alias("start_pos"), place(F.least(i + size, F.size(words))).cast("int").alias("end_pos"))
        return F.when(F.size(words) > 0, F.transform(starts, pair)).otherwise(F.array().cast("array<struct<start_pos: int, end_pos: int>>"))

    return _let(parts, lambda words: _let(F.transform(words, lambda w: F.length(w)), lambda lens: _let(before(lens), lambda done: windows(words, lens, done))))


# ---- vectors of tokens ---------------------------------------------------------------------------------------------
def mean_pooled(matrix: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray | None:
    """The mean of the rows that the mask marks, at length 1; None if its length is 0."""
    rows = matrix if mask is None else matrix[np.asarray(mask, bool)]
    v = rows.mean(axis=0) if len(rows) else np.zeros(matrix.shape[1])
    n = float(np.linalg.norm(v))
    return v / n if n > 0 else None


def stitch(windows: list[np.ndarray], starts: list[int], n: int) -> np.ndarray:
    """One matrix of n tokens from windows that overlap; a token keeps the row of the window in which it stands farthest from
    the edges (the earlier one of equals)."""
    out = np.zeros((n, windows[0].shape[1] if windows else 0))
    best = np.full(n, -1)
    for w, at in zip(windows, starts, strict=True):
        for i in range(len(w)):
            room = min(i, len(w) - 1 - i)
            if at + i < n and room > best[at + i]:
                best[at + i], out[at + i] = room, w[i]
    if n and (best < 0).any():
        raise ValueError("windows leave tokens out")
    return out


def late_chunks(docs: DataFrame, embed_tokens: Callable[[str], tuple[list[tuple[int, int]], np.ndarray]], size: int = 256, overlap: int = 32) -> DataFrame:
    """Token windows with the mean of their tokens' vectors, which know the whole text. ``embed_tokens``: text -> (places of
    tokens, matrix). Where it fails, the windows of words come without vectors."""

    def cut(texts):
        out = []
        for t in texts:
            try:
                spans, m = embed_tokens(t)
            except Exception:  # noqa: BLE001  (a model that fails costs the vectors, not the text)
                spans, m = [(x.start(), x.end()) for x in re.finditer(r"\S+", t)], None
            got = []
            for i in range(0, len(spans), size - overlap):
                some = spans[i : i + size]
                body = t[some[0][0] : some[-1][1]]
                lead = len(body) - len(body.lstrip())
                if body.strip():
                    v = mean_pooled(np.asarray(m)[i : i + size]) if m is not None else None
                    a = some[0][0] + lead
                    got.append((a, a + len(body.strip()), body.strip(), None if v is None else v.tolist()))
                if i + size >= len(spans):
                    break
            out.append(got)
        return out

    return _run(docs, cut, f"{CHUNKS}, embedding array<double>")


def mean_vector(vectors: Column) -> Column:
    """The mean of an array of vectors, at length 1 (null if its length is 0), by expressions."""
    dims = F.sequence(F.lit(0), F.size(vectors[0]) - 1)
    mean = F.transform(dims, lambda i: F.aggregate(vectors, F.lit(0.0), lambda a, v: a + v[i].cast("double"), lambda a: a / F.size(vectors)))
    return unit(mean)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def compress(hits: DataFrame, embed: Embed, keep: int = 3, budget: int | None = None) -> DataFrame:
    """``query, doc, text`` with the sentences nearest to the query alone, in their own order; ``hits``: query, question, doc,
    text. With a ``budget`` in words as many as fit, the best always among them."""

    def run(batches):
        for b in batches:
            rows = []
            for q, question, d, t in zip(b["query"], b["question"], b["doc"], b["text"], strict=True):
                parts = split_sentences(t or "")
                if len(parts) > 1:
                    v = embed([question, *parts])
                    order = sorted(range(len(parts)), key=lambda i: (-cosine(v[0], v[i + 1]), i))
                    if budget is None:
                        chosen = order[:keep]
                    else:
                        chosen, left = [], budget
                        for i in order:
                            cost = len(parts[i].split())
                            if not chosen or cost <= left:
                                chosen.append(i)
                                left -= cost
                    t = " ".join(parts[i] for i in sorted(chosen))
                rows.append((q, d, t))
            yield pd.DataFrame(rows, columns=["query", "doc", "text"])

    return hits.select("query", "question", "doc", "text").mapInPandas(run, "query long, doc long, text string")
