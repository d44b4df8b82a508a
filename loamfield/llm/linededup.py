"""Line de-duplication by a deletion-neighbourhood join, with DataFrame functions only.

Lines are equal if their words are. The edit bound of two lines is one word (replaced, added or taken away) if both have
``near_words`` words or more, and none below: a bound of one edit in ``near_words`` words, so that lines within it are alike
to 0.8 at least. The earliest of equal or near lines stays, by (doc_id, line number); a line goes if an earlier line is
equal or near.

Every line emits its deletion variants (itself and itself without each one word) as hashed keys; equal keys meet.
Lines that lack the same word position of the same rest differ by a replacement at most; a line that equals another's
variant lacks one word. For each key the earliest line alone is needed, so groups of any size are reduced by
map-side aggregation and no pairs of a group are made.

One word edit leaves the first or the last half of a line as it was, so only lines that share such a half with
another line of a fitting length can have a near line; the others emit no variants.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamfield.llm.common import SPACE, WORD, split_by_partner, staged, text_key


@dataclass(frozen=True)
class Params:
    """``min_words``: shorter lines stay as they are. ``near_words``: the edit bound is one word from so many words on."""

    min_words: int = 1
    near_words: int = 5


#: A document's place, as one number: doc_ids in their order (texts without one stand before all others, by their keys), then
#: 26 bits of the key, for texts that share a doc_id. A line's place is its document's and 32 bits of its number.
_DOC = "(coalesce(cast(doc_id as decimal(20,0)), cast(cast(dk as decimal(20,0)) - 18446744073709551616BD as decimal(20,0))) * 67108864 + (dk & 67108863))"
_OCC = f"cast({_DOC} * 4294967296 + pos as decimal(38,0))"
_DOC = f"cast({_DOC} as decimal(38,0))"


def _plain(text: F.Column) -> F.Column:
    """A text with single spaces between the words of its lines; texts that have no others are passed through."""
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(c))
    spaced = F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)
    return F.when(odd | F.contains(text, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(text)


def _ids(line: F.Column) -> list[F.Column]:
    """Two independent hashes of a line's words (the second starts from another seed)."""
    return [F.xxhash64(line).alias("id1"), F.xxhash64(F.lit(1), line).alias("id2")]


def _n_words(line: F.Column) -> F.Column:
    return F.when(line == "", 0).otherwise(1 + F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))))


def _lines(docs: DataFrame, p: Params) -> DataFrame:
    """One row for each line of at least min_words words, without its text.

    A line is hashed as a string; the half keys are hashes of its first and of its last words.
    """
    df = docs.select("doc_id", text_key().alias("dk"), F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("pos", "line"))
    df = df.select("doc_id", "dk", "pos", F.trim("line").alias("w")).withColumn("n", _n_words(F.col("w")).cast("int")).filter(F.col("n") >= max(1, p.min_words))
    near = F.col("n") >= p.near_words
    sizes = {"1": F.col("n"), "2": F.col("n") - 1}  # lines of n and n + 1 words meet at n
    half = {k: F.floor(m / 2).cast("int") for k, m in sizes.items()}
    part = {f"{side}{k}": F.call_function("substring_index", F.col("w"), F.lit(" "), half[k] if side == "h" else -half[k]) for k in sizes for side in "ht"}
    keys = {name: F.when(near, F.xxhash64(part[name], F.lit(name[0]), sizes[name[1]])) for name in part}
    return df.select("doc_id", "dk", "pos", "n", *_ids(F.col("w")), *[c.alias(k) for k, c in keys.items()])


def _near(docs: DataFrame, distinct: DataFrame, p: Params) -> DataFrame:
    """Ids of distinct lines with an earlier near line."""
    near = distinct.filter(F.col("n") >= p.near_words)
    keys = near.select("id1", F.explode(F.array_distinct(F.array("h1", "t1", "h2", "t2"))).alias("key"))
    shared = keys.groupBy("key").agg(F.min("id1").alias("a"), F.max("id1").alias("b")).filter("a <> b").select("key")
    alive = keys.join(shared, "key", "left_semi").select("id1").distinct()
    alive = near.join(alive, "id1", "left_semi").select("id1", "id2", "n", "occ")
    alive = staged(alive, "line-alive")
    wanted = alive.select("occ", F.expr("pmod(occ, 4294967296BD)").cast("int").alias("pos"))
    wanted = wanted.select(F.expr("cast((occ - pos) / 4294967296BD as decimal(38,0))").alias("doc"), "pos").groupBy("doc").agg(F.collect_list("pos").alias("at"))
    some, _ = split_by_partner(docs.withColumn("dk", text_key()).withColumn("place", F.expr(_DOC)), F.col("place"), wanted, F.col("doc"), alive.count())
    met = some.dropDuplicates(["place", "dk"]).join(wanted, F.col("place") == F.col("doc"))
    # a row of its own for the parted text, so that it is parted once and not for each line that is wanted
    parted = met.select(F.inline(F.array(F.struct(F.split(_plain(F.col("text")), "\n").alias("all_"), F.col("at").alias("at")))))
    text = parted.select(F.explode(F.expr("transform(at, i -> trim(get(all_, i)))")).alias("line"))
    text = text.select(*_ids(F.col("line")), F.split("line", " ").alias("w")).dropDuplicates(["id1", "id2"])
    full = staged(alive.select("id1", "id2", "n", "occ").join(text, ["id1", "id2"]), "line-words")

    byline = Window.partitionBy("occ", "id1")
    run = byline.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here, left = F.xxhash64("x", "i"), F.xxhash64("x", F.col("i") - 1)
    one = full.select("n", "occ", "id1", F.posexplode("w").alias("i", "x")).select("n", "occ", "id1", "i", here.alias("a"), left.alias("b"))
    one = one.withColumns({"ra": F.bit_xor("a").over(run), "rb": F.bit_xor("b").over(run), "ta": F.bit_xor("a").over(byline), "tb": F.bit_xor("b").over(byline)})
    cut = F.col("ra").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("tb")).bitwiseXOR(F.col("rb"))
    whole = one.filter("i = 0").select(F.col("ta").alias("k"), F.col("n").alias("left"), F.lit(-1).alias("i"), "occ")
    variants = staged(one.select(cut.alias("k"), (F.col("n") - 1).alias("left"), "i", "occ").unionByName(whole), "line-variants")

    group = variants.groupBy("k", "left", "i").agg(F.min("occ").alias("least"), F.count(F.lit(1)).alias("c"))
    ends = group.groupBy("k", "left").agg(F.min(F.expr("if(i < 0, least, null)")).alias("zero"), F.min(F.expr("if(i >= 0, least, null)")).alias("one"), F.max(F.expr("if(i >= 0, c, 0)")).alias("most"))
    ends = ends.filter("most > 1 or (zero is not null and one is not null)").select("k", "left", "zero", "one")
    some = staged(variants.join(ends, ["k", "left"]), "line-met")
    swaps = some.filter("i >= 0").groupBy("k", "left", "i").agg(F.min("occ").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    swaps = some.join(swaps, ["k", "left", "i"]).select("occ", "least")
    moves = some.select("occ", F.when(F.col("i") < 0, F.col("one")).otherwise(F.col("zero")).alias("least"))
    found = swaps.unionByName(moves).filter("least < occ").distinct()
    other = full.select(F.col("occ").alias("least"), F.col("w").alias("v"), F.col("n").alias("m"))
    found = found.join(full, "occ").join(other, "least")
    return found.filter(_one_apart()).select("id1", "id2").distinct()


def _one_apart() -> F.Column:
    """Whether the word lists w (n words) and v (m words) are one word edit apart or equal."""
    at = "coalesce(nullif(array_position(zip_with(w, v, (x, y) -> not (x <=> y)), true), 0), greatest(n, m) + 1)"
    return F.expr(f"""(n = m and slice(w, cast({at} as int) + 1, n) = slice(v, cast({at} as int) + 1, n))
        or (n = m + 1 and slice(w, cast({at} as int) + 1, n) = slice(v, cast({at} as int), n))
        or (m = n + 1 and slice(v, cast({at} as int) + 1, m) = slice(w, cast({at} as int), m))""")


def removed_lines(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, dk (tells texts of a repeated doc_id apart), ``gone``: line numbers to remove, ``n_near`` of them for a near line alone."""
    lines = staged(_lines(docs, p), "lines")
    distinct = lines.withColumn("occ", F.expr(_OCC)).groupBy("id1", "id2", "n").agg(F.min("occ").alias("occ"), F.count(F.lit(1)).alias("c"), *[F.min(k).alias(k) for k in ("h1", "t1", "h2", "t2")])
    distinct = staged(distinct, "lines-distinct")
    near = _near(docs, distinct, p).withColumn("near", F.lit(True))
    judged = distinct.select("id1", "id2", "occ", "c").join(near, ["id1", "id2"], "left").filter("c > 1 or near")
    met = lines.select("doc_id", "dk", "pos", "id1", "id2").join(judged, ["id1", "id2"]).withColumn("again", F.expr(_OCC) > F.col("occ")).filter("again or near")
    return met.groupBy("doc_id", "dk").agg(F.collect_set("pos").alias("gone"), F.countDistinct(F.when(~F.col("again"), F.col("pos"))).alias("n_near"))


def dedup(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows of ``df`` (doc_id, text, ``row_``) with ``n_lines``, ``n_removed``, ``n_near`` and ``clean_text``.

    Lines with fewer than min_words words always stay. Null text has no lines and stays null. Rows that repeat doc_id
    and text are one document: they are treated alike. Texts without a doc_id come before all others; texts that share
    one are told apart by their keys. Ties can't occur, as a line's place is unique. An empty table gives an empty one.
    """
    gone = removed_lines(df.select("doc_id", "text"), p)
    gone = staged(gone.select(F.col("doc_id").alias("d_"), F.col("dk").alias("k_"), "gone", "n_near"), "line-gone")
    some, rest = split_by_partner(df.withColumn("dk_", text_key()), F.col("dk_"), gone, F.col("k_"))
    out = some.join(gone, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("dk_") == F.col("k_")), "left")
    out = out.unionByName(rest, allowMissingColumns=True)
    out = out.withColumn("all_", F.split("text", "\n")).withColumn("n_removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    stays = F.expr("transform(array_except(sequence(0, size(all_) - 1), gone), i -> all_[i])")
    return out.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("all_")).cast("long"),
        "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.col("n_removed")).cast("long"),
        "n_near": F.coalesce("n_near", F.lit(0)).cast("long"),
        "clean_text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")),
    }).drop("all_", "gone", "dk_", "d_", "k_")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "n_near", F.md5(F.coalesce("clean_text", F.lit("")).cast("binary")).alias("clean_md5"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines (n_chars counted anew); a document of which no word is left goes."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*rest).alias("row_"))
    out = dedup(rows).filter((F.col("n_removed") == 0) | F.rlike("clean_text", F.lit(f"[^{SPACE}]")))
    swap = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select(*[(swap[c] if c in swap else F.col(f"row_.`{c}`")).alias(c) for c in docs.columns])


def op8_sql(p: Params = Params()) -> str:
    return f"""
WITH ln AS (SELECT doc_id, i - 1 AS pos, l, regexp_extract_all(l, '{WORD}') AS w
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
long AS (SELECT *, doc_id::HUGEINT * 4294967296 + pos AS place FROM ln WHERE len(w) >= {p.min_words}),
d AS (SELECT w, len(w) AS n, min(place) AS occ FROM long GROUP BY w),
v AS (SELECT w, n, occ, i, list_concat(w[1:i - 1], w[i + 1:]) AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= {p.near_words})),
near AS (
  SELECT w FROM (SELECT w, occ, min(occ) OVER (PARTITION BY rest, i) AS least FROM v) WHERE least < occ
  UNION SELECT v.w FROM v JOIN d ON d.w = v.rest AND d.n >= {p.near_words} WHERE d.occ < v.occ
  UNION SELECT d.w FROM v JOIN d ON d.w = v.rest AND d.n >= {p.near_words} WHERE v.occ < d.occ),
bad AS (SELECT doc_id, pos, place = d.occ AS near FROM long JOIN d USING (w) WHERE place > d.occ OR w IN (SELECT w FROM near)),
kept AS (SELECT ln.doc_id, count(*) AS n_lines, count(b.pos) AS n_removed, count(*) FILTER (WHERE b.near) AS n_near, coalesce(string_agg(l, chr(10) ORDER BY ln.pos) FILTER (WHERE b.pos IS NULL), '') AS t
         FROM ln LEFT JOIN bad b ON b.doc_id = ln.doc_id AND b.pos = ln.pos GROUP BY ln.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_near, 0)::BIGINT AS n_near, md5(coalesce(t, '')) AS clean_md5
FROM documents d LEFT JOIN kept USING (doc_id)"""


OP8_SQL = op8_sql()
