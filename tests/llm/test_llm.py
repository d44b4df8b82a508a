"""Small cases, brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loamfield.llm import common, decontam, langid, linededup, ngramjoin, piecewise, quality, queries, sharding, suffix, tokenpack, toxicity

LONG = "word " * 3000
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "One."), (5, LONG), (6, "One."), (6, "One."), (None, "No id here."), (7, "ünï çødé 中文 \x00 end.")]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n)) + "."


# 1 ---------------------------------------------------------------------------------------------------------------
def test_lookup_table_is_even_and_stable():
    a = sharding.lookup_table([f"s{i}" for i in range(10)], 1009)
    n = Counter(a)
    assert max(n.values()) - min(n.values()) <= 1 and set(a) == set(range(10))
    b = sharding.lookup_table([f"s{i}" for i in range(9)], 1009)
    assert sum(x == y for x, y in zip(a, b) if x != 9) > 0.8 * sum(x != 9 for x in a)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_place(spark, docs_of):
    rows = sharding.place(docs_of(ODD).withColumnRenamed("source", "shard"), "doc_id").collect()
    assert len(rows) == len(ODD) and all(r.shard in sharding.SHARDS for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 6}) == 1
    assert sharding.place(docs_of([]), "doc_id").count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------
def brute_counts(text):
    import re

    t = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(t)
    lines = [x for x in t.split("\n") if word.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs_of):
    rng = random.Random(1)
    rows = ODD + [(100 + i, "\n".join(" ".join(rng.choice("ab#c|") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12)))) for i in range(60)]
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.clean(docs_of(rows)).collect())
    assert got == sorted((str(i), *brute_counts(t)) for i, t in rows)


def test_quality_lines(docs_of):
    rng = random.Random(2)
    body = "\n".join(prose(rng, 20) for _ in range(5))
    menu = "Home | About | News | Contact"
    rows = [(1, body), (2, body + "\n" + menu + "\nPlease accept cookies."), (3, "\n".join(" | ".join(f"{w}{i}" for w in WORDS) for i in range(4))), (4, prose(rng, 10))]
    got = {r.doc_id: r for r in quality.clean(docs_of(rows)).collect()}
    assert got[1].kept and got[1].clean_text == body and got[2].kept and got[2].clean_text == body and got[2].n_lines_removed == 2
    assert not got[3].kept and not got[3].base_failed and got[4].base_failed and not got[4].kept
    kept = quality.stage(None, docs_of(rows), "").collect()
    assert {r.doc_id for r in kept} == {1, 2} and all(r.n_chars == len(r.text) and r.n_words == 7 for r in kept)
    assert quality.stage(None, docs_of([]), "").count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------
def test_language(spark):
    rng = random.Random(3)
    sounds = {"x": ["ka", "ko", "ru", "mi"], "y": ["sch", "ung", "ein", "lich"], "z": ["ció", "ñar", "llo", "que"]}
    say = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, say(x), x) for i in range(300) for x in sounds]
    df = spark.createDataFrame([(k, t, x) for k, (_, t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    p = langid.learn(df.filter("doc_id % 4 <> 2"))
    held = {r.doc_id: r for r in langid.identify(df.filter("doc_id % 4 = 2"), p).collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    assert sum(r.lang_pred == truth[d] for d, r in held.items()) >= 0.99 * len(held) and all(0 <= r.score <= 1 for r in held.values())
    odd = langid.identify(spark.createDataFrame(ODD + [(9, "12 34 !")], "doc_id long, text string"), p).collect()
    assert len(odd) == len(ODD) + 1 and all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (1, 2, 3, 9))
    none = langid.learn(df.filter("false"))
    assert {r.lang_pred for r in langid.identify(df.limit(3), none).collect()} == {"und"}


def test_grams_in_pieces(monkeypatch):
    for text in ("Straße und ÉTÉ, 3 mots. " * 40, "a" * 350, " - " * 200, "ab, " * 75, "", "x" * 99 + "  " + "y" * 99):
        monkeypatch.setattr(langid, "PIECE", 1 << 18)
        whole = langid.grams(text)
        for piece in (1, 2, 3, 100):
            monkeypatch.setattr(langid, "PIECE", piece)
            parts = langid.grams(text)
            assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def brute_language(text, by_lang, size):
    """(language, sum of ranks out of place) by plain lists."""
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    s = " " + " ".join(folded.split()) + " "
    s = " " if not s.strip() else s
    seen = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    seen = {g: n for g, n in seen.items() if g != " " and not (len(g) == 3 and g[1] == " ")}
    number = lambda g: sum((1 if c == " " else ord(c)) << 21 * k for k, c in enumerate(reversed(g)))
    mine = sorted(seen, key=lambda g: (-seen[g], number(g)))[:size]
    far = {x: sum(min(abs(p.index(number(g)) - i), size) if number(g) in p else size for i, g in enumerate(mine)) for x, p in by_lang.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (size * len(mine))


def test_language_by_brute_force():
    rng = random.Random(33)
    say = lambda some, n: " ".join("".join(rng.choice(some) for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = {"a": say(["ka", "É", "ru"], 60), "b": say(["Sch", "ung", "ß"], 60), "c": say(["ka", "ung", "x1y"], 60)}
    by = {x: langid.ranked(*langid.grams(t), 30).tolist() for x, t in texts.items()}
    by["d"] = list(by["a"])  # a tie: the first by name wins
    p = langid.Profiles(by, 30)
    for _ in range(100):
        text = say(rng.choice([["ka", "É"], ["Sch", "ß", "x1y"], ["Q", "中"]]), rng.randint(1, 30))
        lang, score = p.predict(text)
        assert (lang, score) == (brute_language(text, by, 30)[0], pytest.approx(brute_language(text, by, 30)[1])) and lang != "d"


# 4 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 59, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("top", [2, 300, 49408, 2**35, 2**63])
def test_pack_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64)
    ids[rng.random(n) < 0.4] = 1
    names, counts, back = tokenpack.load(tokenpack.dump(np.array([5]), np.array([n]), ids))
    assert (back == ids).all() and names.tolist() == [5] and counts.tolist() == [n]


def test_pack_finds_damage():
    data = bytearray(tokenpack.dump(np.array([1]), np.array([3]), np.array([1, 2, 3], np.uint64)))
    data[60] ^= 1
    with pytest.raises(ValueError):
        tokenpack.load(bytes(data))


def test_words_by_themselves_encode_alike():
    enc = tokenpack.Encoder(tokenpack.tokenizer_path())
    texts = ["Hello, World's end", "<|endoftext|> A b<|startoftext|>C", " \n\t", "İSTANBUL É é ſ", "a<|ENDOFTEXT|>", "x\x1cy\x85z", "中文 字"]
    ids, counts = enc.encode(pa.array([*texts, None]))
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        assert enc.tok.encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist()


def test_token_files(spark, docs_of, tmp_path):
    docs = docs_of(ODD)
    manifest = tokenpack.write_tokens(docs, f"file://{tmp_path}").cache()
    got = sorted(tokenpack.read_tokens(manifest).collect(), key=lambda r: r.start)
    enc = tokenpack.Encoder(tokenpack.tokenizer_path())
    want, start = [], 0
    for d, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*enc.tok.encode(t or "", add_special_tokens=False).ids, tokenpack.END]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    empty = tokenpack.write_tokens(docs_of([]), f"file://{tmp_path}/none").cache()
    assert tokenpack.read_tokens(empty).count() == 0


def test_slices_of_a_batch_encode_alike():
    enc, rng = tokenpack.Encoder(tokenpack.tokenizer_path()), random.Random(41)
    texts = [" ".join(rng.choice(["Über", "it's", "x9y", "naïve!!", "don't…", "a-b", "ŉ", "ſt", "İx", "日本", "e\u0301"]) + rng.choice(WORDS) for _ in range(rng.randrange(30))) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    at = 0
    for part in common.slices(batch, 1000):
        ids, counts = enc.encode(part.column("text"))
        for got in np.split(ids, np.cumsum(counts)[:-1]):
            assert got.tolist() == enc.tok.encode(texts[at], add_special_tokens=False).ids
            at += 1
    assert at == len(texts)


def test_words_share_what_is_remembered_of_their_parts():
    enc, rng = tokenpack.Encoder(tokenpack.tokenizer_path()), random.Random(44)
    parts = ["the", "naïve", "ÉTÉ", "x", "Ÿž", "7", "42", "…", "×", ",", "...", "<|", "|>", "-", "'", "'s", "'ll", "'T", "中", "e\u0301", "\u00a0", "ĸ", "ŉ"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " ", "\n\t"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    ids, counts = enc.encode(pa.array(texts))
    for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == enc.tok.encode(t, add_special_tokens=False).ids
    enc.clear()
    marks, names = [".", ",", ";", "!?", ")"], ["été", "winter", "b"]
    ids, _ = enc.encode(pa.array([" ".join(a + m + b for a in names for m in marks for b in names)]))
    assert set(enc.at) == {*marks, *names} and ids.tolist() == enc.tok.encode(" ".join(a + m + b for a in names for m in marks for b in names), add_special_tokens=False).ids


@pytest.mark.parametrize("top", [1, 40, 49408, 2**62])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 700])
def test_pack_takes_the_most_ids_that_fit(n, top):
    rng, block = np.random.default_rng(n + top % 97), 64
    ids = rng.integers(0, top, n, dtype=np.uint64) >> rng.integers(0, 50, n, dtype=np.uint64)
    words, escapes, at, esc_at = tokenpack.pack(ids, block)
    want, out, ends, esc_ends = [], [], [0], [0]
    for b in range(0, n, block):
        x = ids[b : b + block].tolist()
        while x:
            s = next((s for s, (many, bits) in enumerate(tokenpack.SELECTORS) if all(i < 1 << bits for i in x[:many])), tokenpack.ESCAPE)
            many, bits = tokenpack.SELECTORS[s] if s < tokenpack.ESCAPE else (1, 0)
            want.append(s << 60 | (sum(i << k * bits for k, i in enumerate(x[:many])) if bits else 0))
            out += [] if bits else x[:1]
            x = x[many:]
        ends.append(len(want))
        esc_ends.append(len(out))
    assert words.tolist() == want and escapes.tolist() == out and at.tolist() == ends and esc_at.tolist() == esc_ends


def test_files_end_with_the_document_that_fills_them(docs_of, tmp_path):
    rows = [(i, f"w{i} " * (i % 23)) for i in range(60)]
    whole = tokenpack.Packer(64)
    many = tokenpack.Packer(64)
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 3000, 40)
    ids = rng.integers(0, 1 << 31, counts.sum(), dtype=np.uint32)
    whole.add(np.arange(40), counts, ids)
    for i, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
        many.add(np.array([i]), counts[i : i + 1], part)
    assert whole.finish() == many.finish()
    enc = tokenpack.Encoder(tokenpack.tokenizer_path())
    manifest = tokenpack.write_tokens(docs_of(rows), f"file://{tmp_path}", file_ids=50).cache()
    assert manifest.count() > 4 and all(r.n_ids < 50 + 24 * 4 for r in manifest.collect())
    got = {r.doc_id: r.n_tokens for r in tokenpack.read_tokens(manifest).collect()}
    assert got == {i: len(enc.tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}


# 5 ---------------------------------------------------------------------------------------------------------------
def test_n_best_is_exact():
    lat = piecewise.Lattice(piecewise.model_path())
    rng = random.Random(5)

    def brute(s):
        out = []

        def go(i, score):
            if i == len(s):
                out.append(score)
            for j in range(i + 1, min(len(s), i + lat.longest) + 1):
                got = lat.pieces.get(s[i:j])
                if got or j == i + 1:
                    go(j, score + (got[1] if got else lat.unknown))

        go(0, 0.0)
        return sorted(out, reverse=True)[: piecewise.N_BEST]

    for _ in range(200):
        t = "".join(rng.choice("theandin. \nß中1") for _ in range(rng.randint(1, 11)))
        ids, scores = lat.encode(t)
        assert scores == brute(piecewise.MARK + t.replace(" ", piecewise.MARK)) and lat.decode(ids) == t


def test_segment(spark, docs_of):
    rows = piecewise.segment(docs_of(ODD)).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows) and {r.n_pieces for r in rows if r.doc_id in (1, 2)} == {0}
    assert all(r.nbest_scores[0] == r.best_score and r.nbest_scores == sorted(r.nbest_scores, reverse=True) for r in rows)
    assert piecewise.segment(docs_of([])).count() == 0


def test_segment_gives_the_n_best(docs_of):
    rng = random.Random(15)
    rows = [*ODD, (20, "the band in\nthe inn"), (21, " two  marks"), *((30 + k, prose(rng, k)) for k in range(1, 12))]
    got = piecewise.segment(docs_of(rows)).collect()
    lat = piecewise.Lattice(piecewise.model_path())
    names = {i: s for i, s in lat.pieces.values()}
    assert len(got) == len(rows)
    for r in got:
        assert len(r.nbest_ids) == len(r.nbest_scores) == len({tuple(x) for x in r.nbest_ids}) and len(r.nbest_ids[0]) == r.n_pieces
        assert zlib.crc32(np.array(r.nbest_ids[0], "<u4").tobytes()) == r.ids_crc32 and len({lat.decode(x) for x in r.nbest_ids}) == 1
        for ids, score in zip(r.nbest_ids, r.nbest_scores):
            if all(i in names for i in ids):
                assert sum(names[i] for i in ids) == pytest.approx(score)
    assert {len(r.nbest_ids) for r in got if r.doc_id and r.doc_id >= 20} == {piecewise.N_BEST}


def test_segment_carries_columns(docs_of):
    docs = docs_of(ODD).withColumnsRenamed({"source": "n_pieces", "kept": "in0_"})
    got = piecewise.stage(None, docs, "")
    assert got.columns == [c for c in docs.columns if c != "n_pieces"] + ["n_pieces", "ids_crc32", "best_score", "nbest_scores", "round_trip", "nbest_ids"]
    assert sorted((str(r.doc_id), r.text, r.lang, r.in0_) for r in got.collect() if r.text) == sorted((str(i), t, "en", True) for i, t in ODD if t)
    assert all(r.n_pieces == len(r.nbest_ids[0]) for r in got.collect())


def test_words_at_once_as_one_by_one():
    lat, rng = piecewise.Lattice(piecewise.model_path()), random.Random(51)
    words = list({"".join(rng.choice("theandinéß中\nxyz.0") for _ in range(rng.randint(0, 50))) for _ in range(600)})
    lat.learn(words)
    for w in words:
        k = lat.at[w]
        parts = [lat.part(x) for x in lat.cut(piecewise.MARK + w)]
        assert lat.flat[lat.first[k] : lat.first[k + 1]].tolist() == [i for x in parts for i in x[0]]
        assert lat.score[k] == pytest.approx(sum(x[1] for x in parts)) and lat.loss[k] == min(x[2] for x in parts)


# 6 ---------------------------------------------------------------------------------------------------------------
def test_suffix_arrays():
    rng = random.Random(6)
    for _ in range(150):
        k = rng.choice([1, 2, 3, 20])
        segs = [bytes(rng.randint(97, 97 + k) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        segs += rng.choice([[], [segs[0] + segs[-1], segs[0]]])
        text = np.frombuffer(b"\xff".join(segs) + b"\xff\xfe", np.uint8) + np.uint8(2)
        raw = text.tobytes()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        sa = suffix.suffix_array(text, 256)
        assert sa.tolist() == want
        names = np.array([*(rng.randrange(1, 400) for _ in range(rng.choice([1, 30, 300]))), 0])
        names[:-1] = names[rng.choices(range(len(names) - 1), k=len(names) - 1)]  # a large alphabet, some of it often
        assert suffix.suffix_array(names, 400).tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())
        lcp, _ = suffix.common_prefixes(text, sa)
        for a, b in zip(want, want[1:]):
            n = 0
            while n < len(raw) - max(a, b) and raw[a + n] == raw[b + n]:
                n += 1
            assert lcp[b] == n


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(e[i : i + length] for e in texts for i in range(len(e) - length + 1))
    out = []
    for (d, _), e in zip(rows, texts):
        gone = np.zeros(len(e), bool)
        for i in range(len(e) - length + 1):
            if seen[e[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = hashlib.sha256(bytes(np.frombuffer(e, np.uint8)[~gone])).hexdigest()
        out.append((str(d), len(e), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])[: len(e)]).sum()), kept))
    return sorted(out)


def test_remove_repeats(docs_of):
    rng = random.Random(7)
    shared = [prose(rng, 12) for _ in range(6)]
    rows = ODD + [(100 + i, " ".join(rng.choice(shared) if rng.random() < 0.4 else prose(rng, 5) for _ in range(rng.randrange(8)))) for i in range(60)]
    rows += [(300 + i, rows[20][1]) for i in range(3)] + [(400, "ab" * 200), (401, "the " * 60 + "end"), (402, "say " + "the " * 50), (403, "é中" * 40)]
    for shard in (300, 1 << 20):
        got = suffix.remove_repeats(docs_of(rows), 40, 16, shard).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 40)
    assert suffix.remove_repeats(docs_of([])).count() == 0


def test_remove_repeats_of_texts_without_ids(docs_of):
    """All texts share a null id, or one id, and only their digests tell them apart."""
    rng = random.Random(8)
    shared = [prose(rng, 12) for _ in range(4)]
    texts = [" ".join(rng.choice(shared) if rng.random() < 0.3 else prose(rng, 5) for _ in range(rng.randrange(8))) for _ in range(80)]
    for one in (None, 5):
        rows = [(one, t) for t in [*texts, texts[3], None, ""]]
        got = suffix.remove_repeats(docs_of(rows), 40, 16, 2000).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 40)


def test_passages_of_many_words_go_from_400_bytes_on(docs_of):
    """What is removed hangs on bytes, not words, and shows in n_removed; n_bytes is the whole text's length."""
    rng = random.Random(9)
    short, long = "".join(rng.choices("abcd ", k=399)), "".join(rng.choices("efgh ", k=400))
    rows = [(i, f"{i}{p}{i + 1}") for i, p in enumerate([short, short, long, long, "alone"])]
    got = suffix.remove_repeats(docs_of(rows)).collect()
    assert min(len(short.split()), len(long.split())) > 50
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(i, len(t), 400 * (i in (2, 3)), int(i in (2, 3))) for i, t in rows]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 400)


# 7 ---------------------------------------------------------------------------------------------------------------
def brute_components(rows, size, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    return sorted((str(d), len(sets[i]), str(min(least[find(i)]) if sets[i] and least[find(i)] else d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("p", [ngramjoin.CONTRACT, ngramjoin.Params()])
def test_near_duplicates(docs_of, p):
    rng = random.Random(8)
    rows = list(ODD)
    passage = prose(rng, 20)
    for base in range(12):
        w = prose(rng, rng.choice([6, 40, 90])).split()
        for copy in range(rng.randrange(1, 14)):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(999)}"
            rows.append((100 * base + copy + 1000, " ".join(v) + (" " + passage if copy % 5 == 4 else "")))
    rng.shuffle(rows)
    got = ngramjoin.near_duplicates(docs_of(rows), p).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, p.size, p.percent)
    assert ngramjoin.near_duplicates(docs_of([]), p).count() == 0


@pytest.mark.parametrize("p", [ngramjoin.CONTRACT, ngramjoin.Params()])
def test_near_duplicates_of_subsets(docs_of, p):
    rows = []
    for n in [*range(4, 24), 60, 66, 70, 78, 79, 80, 82, 84, 85, 90, 96, 104, 130]:
        w = [f"w{n}x{i}" for i in range(n)]
        for k, v in enumerate((w, w[1:], w[:-1], w[n // 8 :], w[: n - n // 12])):
            rows.append((10 * n + k, " ".join(v)))
    got = ngramjoin.near_duplicates(docs_of(rows), p).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, p.size, p.percent)
    long, short = (10, 9) if p.size == 4 else (9, 8)
    pair = [(1, " ".join(WORDS[:long])), (2, " ".join(WORDS[:short]))]
    assert {r.component_id for r in ngramjoin.near_duplicates(docs_of(pair), p).collect()} == {1}


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    got = {r.node: r.root for r in ngramjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for node in got:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        assert got[node] == min(seen)


# 8 ---------------------------------------------------------------------------------------------------------------
def apart(a, b):
    """Whether two word lists are one word edit apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_line_dedup(docs_of):
    rng = random.Random(10)
    base = [[rng.choice(WORDS) for _ in range(n)] for n in (2, 5, 7, 8, 9, 12, 15, 16, 17, 30)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "Short.\nShort.")]
    for d in range(10, 40):
        lines = []
        for _ in range(6):
            w = list(rng.choice(base))
            if rng.random() < 0.6:
                i, how = rng.randrange(len(w)), rng.randrange(3)
                w[i : i + (how != 1)] = [] if how == 0 else [rng.choice(WORDS)]
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    p, seen, want = linededup.Params(), [], {}
    for d, t in rows:
        keep = []
        for line in (t or "").split("\n"):
            w = line.split()
            if len(w) >= p.min_words:
                again = any(w == s or (min(len(w), len(s)) >= p.near_words and apart(w, s)) for s in seen)
                seen.append(w)
                if again:
                    continue
            keep.append(line)
        want[d] = "\n".join(keep) if t is not None else None
    got = linededup.dedup(docs_of(rows)).collect()
    assert {r.doc_id: r.clean_text for r in got} == want
    assert linededup.dedup(docs_of(ODD)).count() == len(ODD) and linededup.dedup(docs_of([])).count() == 0
    left = linededup.stage(None, docs_of([(1, "a b c d.\nx y z."), (2, "a b c d."), (3, "a b c d.\nnew one here.")]), "").collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in left} == {(1, "a b c d.\nx y z.", 15), (3, "new one here.", 13)}


# 9 ---------------------------------------------------------------------------------------------------------------
def test_toxicity_learns_pairs(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice(WORDS) for _ in range(12)] + ["vermin"] * insult + ["ruritanians"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    truth = {r[0]: r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    got = {r.doc_id: r for r in toxicity.rate(df, m).collect()}
    assert sum(got[d].predicted == y for d, y in truth.items()) >= 0.97 * len(truth)
    odd = toxicity.rate(spark.createDataFrame(ODD, "doc_id long, text string"), m).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    empty = toxicity.learn(df.limit(0), df.limit(0))
    assert toxicity.rate(df.limit(2), empty).count() == 2 and toxicity.rate(df.limit(0), m).count() == 0


def test_toxicity_score_by_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(-0.3, rng.normal(0, 0.3, 1 << toxicity.BITS), rng.normal(0, 0.3, (1 << toxicity.BITS, toxicity.RANK)))
    m.w[:50] = 0  # terms without training add nothing, to pairs neither
    for n in (0, 1, 2, 7, 30):
        ids = rng.choice(300, n, replace=False)
        known = [i for i in ids if m.w[i]]
        z = m.w0 + sum(m.w[i] for i in known) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(known) for b in known[:k])
        assert m.score(ids) == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_of_long_texts(spark):
    rng = random.Random(12)
    rows = [(i, " ".join([f"w{rng.randrange(3000)}" for _ in range(rng.choice([20, 800]))] + ["vermin"] * (i % 10 == 0)), int(i % 10 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    held = {r[0]: r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    got = {r.doc_id: r.predicted for r in toxicity.rate(df, m).collect()}
    assert sum(got[d] for d, y in held.items() if y) >= 0.9 * sum(held.values()) and sum(got[d] for d, y in held.items() if not y) <= 0.02 * len(held)


# 10 --------------------------------------------------------------------------------------------------------------
def test_decontamination(spark, docs_of):
    q = "Yesterday the trader Alice sold 12 crates of ripe apples for 30 dollars and later bought 5 more crates from Bob near the old river market"
    changed = q.replace("Alice", "Carol").replace("12", "77").replace("30", "41").replace("5", "9").replace("Bob", "Dan")
    mixed = "The first box has 3 coins and the second box has 4 coins while the third box has 3 coins so count every coin you can see"
    broken = mixed.replace("third box has 3", "third box has 6")
    rng = random.Random(12)
    rows = [(10, prose(rng, 40) + " " + q), (11, prose(rng, 9) + " " + changed + " " + prose(rng, 9)), (12, prose(rng, 200)), (13, mixed), (14, broken), (15, " ".join(q.split()[:6]))]
    bench = spark.createDataFrame([(1, q), (2, mixed), (3, None), (4, "too short"), (5, prose(rng, 30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs_of(rows + ODD), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2), (14, 2)} and got[11, 1].n_changed == 5 and got[10, 1].n_changed == 0
    assert got[14, 2].n_tokens == 22  # the stretch before (or after) the number that is out of line
    small = decontam.contaminated(docs_of(rows), bench, decontam.Params(block_bytes=1)).collect()
    assert {(r.doc_id, r.item_id) for r in small} == set(got)
    assert decontam.contaminated(docs_of([]), bench).count() == 0 and decontam.contaminated(docs_of(rows), bench.limit(0)).count() == 0


def test_decontamination_of_consistent_stretches(spark, docs_of):
    mixed = "The first box has 3 coins and the second box has 4 coins while the third box has 3 coins so count every coin you can see"
    names = "Then Ann gave a pear to Bob because the old man who lives near that river asked for some fresh fruit this morning and Ann agreed"
    other = names.replace("Ann agreed", "Eve agreed")
    same = "Then Ann gave a pear to Ann because the old man who lives near that river asked"
    rows = [(1, mixed), (2, mixed.replace("third box has 3", "third box has 6")), (3, other), (4, same), (5, mixed.replace("4", "3").replace("so count", "thus count"))]
    bench = spark.createDataFrame([(1, mixed), (2, names)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_changed) for r in decontam.contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 1): (len(mixed.split()), 0), (2, 1): (22, 1), (3, 2): (len(names.split()) - 2, 0), (4, 2): (15, 1), (5, 1): (13, 1)}
    rng = random.Random(14)
    for _ in range(400):
        pairs = [(1, rng.randrange(3), rng.randrange(3)) for _ in range(rng.randrange(1, 9))]
        fits = lambda a, b: len(set(pairs[a:b])) == len({x[:2] for x in pairs[a:b]}) == len({x[::2] for x in pairs[a:b]})
        n = len(pairs)
        want = {(a, b) for a in range(n) for b in range(a + 1, n + 1) if fits(a, b) and (not a or not fits(a - 1, b)) and (b == n or not fits(a, b + 1))}
        assert set(decontam.Index._consistent(list(range(n)), pairs, n)) == want


def test_decontamination_of_verbatim_copies(spark, docs_of):
    items = ["12 + 7 = 19 and 8 + 5 = 13 or 4 + 4 = 8", "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG AGAIN TODAY", "Capital of France", "Which colour has snow here", "How many legs does 1 spider have"]
    rows = [(k, "some words before this: " + t + " and words after") for k, t in enumerate(items)]
    rows += [(10, "first line\n" + items[4].replace("1", "6")), (11, "Question: " + items[4].replace("1", "6")), (12, "Capital of Spain"), (13, "12 + 7 = 19 and 4"), (14, "- * - |"), (15, "Question: " + items[3])]
    wrapped = "Yesterday the trader Alice sold ripe apples and later bought many more crates from Bob near the old river market"
    rows += [(16, wrapped.replace("Alice", "\nCarol").replace("Bob", "Dan"))]
    bench = spark.createDataFrame([*enumerate(items), (5, "* * -"), (6, wrapped), (7, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontam.contaminated(docs_of(rows), bench).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (2, 2): 0, (3, 3): 0, (4, 4): 0, (10, 4): 1, (11, 4): 1, (15, 3): 0, (16, 6): 2}


def brute_contaminated(rows, items, p):
    """(doc_id, item_id) -> tokens of the longest stretch, by trying every place of every item in every document."""
    canon, out = decontam.Canon(), Counter()
    for d, text in rows:
        for item_id, item in items:
            if not text or not item or not item.split():
                continue
            for n, (t, kind, lit) in enumerate(canon.forms(item)):
                need = min(p.run, max(min(p.window, len(t)), int(np.ceil(p.share * len(t)))))
                few = min(p.literals, max(2, int(np.ceil(p.share * len({x for x, y in zip(lit, kind) if y == decontam.LITERAL})))))
                for other, other_kind, other_lit in canon.forms(text):
                    for i in range(len(t)):
                        for j in range(len(other)):
                            k, there, back, words = 0, {}, {}, set()
                            while len(t) >= p.least and i + k < len(t) and j + k < len(other) and t[i + k] == other[j + k]:
                                if kind[i + k] == decontam.LITERAL:
                                    words.add(lit[i + k])
                                else:
                                    ours, theirs = (kind[i + k], lit[i + k]), (kind[i + k], other_lit[j + k])
                                    if there.setdefault(ours, theirs) != theirs or back.setdefault(theirs, ours) != ours:
                                        break
                                k += 1
                            if k >= need and len(words) >= few:
                                out[d, item_id] = max(out[d, item_id], k)
                            k = 0
                            while i + k < len(t) and j + k < len(other) and lit[i + k] == other_lit[j + k]:
                                k += 1
                            if not n and k >= need and any(x != decontam._EMPTY for x in lit[i : i + k]):
                                out[d, item_id] = max(out[d, item_id], k)
    return dict(out)


@pytest.mark.parametrize("few", [1, 1 << 20])
def test_decontamination_by_brute_force(spark, docs_of, few):
    rng = random.Random(16)
    words = ["the", "of", "box", "has", "coins", "then", "Ann", "Bob", "3", "7", "12", "km", "-", "river.", "Old", "sold", "to:", "apples", "many", "so"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 5, 6, 8, 12, 20, 25]))) for k in range(24)] + [(24, None), (25, " "), (3, say(9)), (None, say(9))]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            w = (rng.choice(items)[1] or "").split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            lo = rng.randrange(max(1, len(w) // 2))
            parts += [say(rng.randrange(4)), " ".join(w[lo:])]
        rows.append((d % 50, " ".join(parts)))
    rows += [(None, items[20][1]), (None, None), (5, ""), (7, items[20][1]), (7, items[20][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    p = decontam.Params(block_bytes=few)
    got = Counter()
    for r in decontam.contaminated(docs_of(rows), bench, p).collect():
        got[r.doc_id, r.item_id] = max(got[r.doc_id, r.item_id], r.n_tokens)
    want = brute_contaminated(rows, items, p)
    assert len(want) > 40 and dict(got) == want


def test_decontamination_of_short_and_huge_items(spark, docs_of):
    rng = random.Random(18)
    huge = prose(rng, 500_000)  # some megabytes
    rows = [(1, "Question: What is 14 plus 35?"), (2, "What is 14 minus 35?"), (3, "yes it is"), (4, "so " + huge[1000:1300] + " end"), (5, "see " + huge)]
    bench = spark.createDataFrame([(1, "What is 12 plus 30?"), (2, "yes"), (3, huge)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (5, 3)}


def test_decontamination_stage_leaves_short_items(spark, docs_of, tmp_path):
    spark.createDataFrame([(1, "yes"), (2, "the capital of"), (3, "What is 12 plus 30?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "yes it is the capital of all"), (2, "Now: what is 14 plus 35?"), (3, "no")]
    assert sorted(r.doc_id for r in decontam.stage(spark, docs_of(rows), str(tmp_path)).collect()) == [1, 3]


def test_decontamination_stage(spark, docs_of, tmp_path):
    q = "Yesterday the trader sold many crates of ripe apples and later bought some more crates near the old river market"
    clean = ["a clean text", None, "", "another clean text"]
    rows = [(1, clean[0]), (1, q), (1, q), (None, q), (None, clean[3]), (None, None), (2, None), (3, ""), (3, "so " + q)]
    spark.createDataFrame([(1, q), (None, q)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(rows).withColumnsRenamed({"source": "bad_id", "kept": "row_", "n_words": "d_", "lang": "tk_"})
    left = decontam.stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted([x for x in rows if not x[1] or q not in x[1]], key=key)
    assert decontam.stage(spark, docs_of([]), str(tmp_path)).count() == 0


# pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline(spark, docs_of, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    q = prose(rng, 30)
    texts = ["\n".join(prose(rng, 20) for _ in range(4)) for _ in range(12)]
    w = texts[0].split(" ")
    w[3], w[-9] = "changed1", "changed2"
    near = [" ".join(w[:40]) + " " + " ".join(w[40:])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, near[0]), (51, texts[1]), (52, texts[2] + "\n" + q), (53, "Too short."), (54, " | ".join(WORDS * 5)), (55, None)]
    docs_of(rows, more=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, q)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(12)) and all(r.round_trip for r in out.values())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert {out[i].text for i in range(12)} <= {t for t in texts} and all(out[i].n_pieces == len(out[i].nbest_ids[0]) for i in out)


def test_pipeline_of_odd_rows(spark, docs_of, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    body = "\n".join(prose(rng, 20) for _ in range(4))
    q = prose(rng, 30)
    other = "\n".join(prose(rng, 20) for _ in range(4))
    rows = [*ODD, (100, body), (100, body), (100, other), (None, "\n".join(prose(rng, 20) for _ in range(4))), (None, prose(rng, 60) + " " + q), (101, prose(rng, 60) + "\n" + q)]
    docs = docs_of(rows).withColumnsRenamed({"source": "bad_id", "kept": "row_", "lang": "d_"})
    for name, some in (("full", docs), ("none", docs.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, q), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows[len(ODD) : -2])
    assert all(r.bad_id == "s" and r.row_ and r.d_ == "en" for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


# registered queries ----------------------------------------------------------------------------------------------
SHAPES = {
    "op2_line_first_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3_rank_order_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_simple8b_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op6_suffix_array_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op7_multi_order_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_factorization_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name, tmp_path):
    """Each query over a whole small folder: a row for each document (but op10), the contract's columns and held-out flags."""
    rng = random.Random(61)
    rows = [(i, "\n".join(prose(rng, rng.randint(1, 25)) for _ in range(4)) + (" idiot" if i % 9 == 0 else ""), ["en", "de", None][i % 3]) for i in range(80)] + [(500, None, "en"), (501, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[3][1].split("\n")[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(80)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = queries.QUERIES[name](spark, str(tmp_path))
    got = df.collect()
    assert SHAPES.get(name, {}).items() <= dict(df.dtypes).items()
    if name.startswith("op10"):
        assert (3, 1) in {(r.doc_id, r.item_id) for r in got}
        return
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    if "held_out" in df.columns:
        n, of = (4, 2) if name.startswith("op3") else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == of) for r in got)
