"""Line-first cleaning with DataFrame functions only.

Each line is judged by itself: navigation (many separators or very short pieces between them), boilerplate
phrases, symbol noise, one word over and over, and missing end punctuation. Failing lines go. A document whose
failing lines hold too much of its words is rejected; one that fails the base counts is rejected first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamfield.llm.common import SPACE, WORD, documents

SYMBOLS = "#*$%&|<>"
#: A line that ends so ends a sentence, a quotation, a list head or an item.
ENDS = r"[.!?:;,\"'\)\]…”»。！？][\x20\x09-\x0D]*$"
#: What sites say beside their texts, in the languages of the corpus, lower-cased.
PHRASES = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled",
    "log in to", "lorem ipsum", "powered by", "privacy policy", "read more", "share on", "sign up", "skip to content",
    "subscribe to", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "impressum", "weiterlesen", "zum inhalt springen",
    "accepter les cookies", "aller au contenu", "cliquez ici", "lire la suite", "mentions légales", "politique de confidentialité", "tous droits réservés",
    "aceptar cookies", "aviso legal", "haga clic aquí", "leer más", "política de privacidad", "saltar al contenido", "todos los derechos reservados",
)


@dataclass(frozen=True)
class Rules:
    """Production parameters.

    A line without end punctuation fails only beyond ``open_words`` words, so titles, verse and addresses stay.
    A boilerplate phrase fails a line of up to ``phrase_words`` words; a longer line merely mentions it.
    """

    min_words: int = 50
    open_words: int = 20
    phrase_words: int = 20
    max_separators: int = 3
    max_symbols_per_word: float = 0.5
    min_distinct_share: float = 0.2
    distinct_from: int = 15
    max_lost: float = 0.5
    phrases: tuple[str, ...] = field(default=PHRASES)


def base_counts(text: str = "text") -> dict[str, F.Column]:
    """The contract's counts of a whole text; they need the columns ``w_`` (words) and ``l_`` (lines)."""
    t = F.coalesce(F.col(text), F.lit(""))
    windows = F.expr("transform(arrays_zip(slice(w_, 1, size(w_) - 2), slice(w_, 2, size(w_) - 2), slice(w_, 3, size(w_) - 2)), (x, i) -> struct(xxhash64(x) AS h, i AS p))")
    placed = F.when(F.size("w_") > 3, F.sort_array(windows))
    return {
        "n_words": F.size("w_").cast("long"),
        "word_chars": F.length(F.array_join("w_", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": F.expr("cast(size(l_) - size(array_distinct(l_.l)) as long)"),
        "s_": placed,
    }


#: Positions of windows that occur twice or more, ascending, then the words that they cover.
_TWICE = "sort_array(array_distinct(flatten(transform(filter(arrays_zip(slice(s_, 1, size(s_) - 1), slice(s_, 2, size(s_) - 1)), x -> x.`0`.h = x.`1`.h), x -> array(x.`0`.p, x.`1`.p)))))"
_COVERED = "cast(if(coalesce(size(p_), 0) <= 0, 0, 3 + aggregate(arrays_zip(slice(p_, 1, size(p_) - 1), slice(p_, 2, size(p_) - 1)), 0, (acc, x) -> acc + least(3, x.`1` - x.`0`))) as long)"


def line_fails(x: F.Column, rules: Rules = Rules()) -> F.Column:
    """Whether a line fails a rule; ``x`` has the line as ``l`` and its words (one at least) as ``w``.

    Cheap tests stand first, as AND ends at the first that is false.
    """
    line, n = x["l"], F.size(x["w"])
    seps = F.regexp_count(line, F.lit("[|»›•]"))
    said = F.rlike(F.lower(line), F.lit("|".join(re.escape(p) for p in rules.phrases)))
    return (
        ((n <= rules.phrase_words) & said)
        | ((n >= rules.distinct_from) & (F.size(F.array_distinct(x["w"])) < n * rules.min_distinct_share))
        | ((n > rules.open_words) & ~F.rlike(line, F.lit(ENDS)))
        | (F.rlike(line, F.lit(f"[{SYMBOLS}»›•]")) & (((seps >= rules.max_separators) & (seps * 4 >= n)) | (F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) > n * rules.max_symbols_per_word)))
    )


_OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "words_lost", "clean_text"]


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, the base counts, ``base_failed``, ``kept``, ``n_lines_removed``,
    ``words_lost`` and ``clean_text`` (the lines that pass, with line ends as they were).

    Null text counts as no words, fails the base counts, and has a null ``clean_text``. Lines without words are
    neither judged nor removed. Repeated rows are judged one by one, alike. Only doc_id and text are read, so other
    columns can't clash. No shuffle: each text is judged within its row.
    """
    return _judged(documents(docs), rules).select(*_OUT)


def _judged(df: DataFrame, rules: Rules) -> DataFrame:
    """``df`` (``text`` and any columns that aren't named here) with the columns of :func:`clean`."""
    gap = f"[{SPACE}]+".replace("\\", "\\\\")
    df = df.withColumn("all_", F.split("text", "\n"))
    df = df.withColumn("l_", F.coalesce(F.expr(f"filter(transform(all_, l -> struct(l AS l, array_remove(split(l, '{gap}'), '') AS w)), x -> size(x.w) > 0)"), F.expr("cast(array() as array<struct<l: string, w: array<string>>>)")))
    df = df.withColumn("w_", F.flatten("l_.w"))  # \n parts words, so the lines' words are the text's
    df = df.withColumns(base_counts()).drop("w_")
    df = df.withColumn("p_", F.expr(_TWICE)).drop("s_").withColumn("n_repeat_words", F.expr(_COVERED)).drop("p_")
    df = df.withColumn("bad_", F.filter("l_", lambda x: line_fails(x, rules)))
    some = F.size("bad_") > 0
    df = df.withColumns({
        "n_lines_removed": F.size("bad_").cast("long"),
        "words_lost": F.expr("cast(aggregate(bad_, 0, (acc, x) -> acc + size(x.w)) as long)"),
        "clean_text": F.when(some, F.array_join(F.expr("filter(all_, l -> not array_contains(bad_.l, l))"), "\n")).otherwise(F.col("text")),
    })
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("words_lost") <= F.col("n_words") * F.lit(rules.max_lost)))


def op2(spark, sf_dir: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failing lines removed (and n_chars counted anew); the columns of ``docs``.

    Null and empty texts fail the base counts and go. Repeated rows stay or go alike. Other columns are carried along under
    names of their own, so they can't clash. An empty table stays empty.
    """
    at = {c: "text" if c == "text" else f"in{i}_" for i, c in enumerate(docs.columns)}
    judged = _judged(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()]), Rules())
    swap = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    # the numbering keeps the filter above the counts; pushed below them it would compute each of them again and again
    judged = judged.withColumn("row_no_", F.monotonically_increasing_id()).filter("kept and row_no_ >= 0")
    return judged.select(*[swap.get(c, F.col(at[c])).alias(c) for c in docs.columns])


_W = rf"regexp_extract_all(coalesce(text, ''), '{WORD}')"
_SYM = f"(length({{0}}) - length(translate({{0}}, '{SYMBOLS}', '')))"


def _sql_fails(rules: Rules = Rules()) -> str:
    said = " OR ".join(f"contains(lower(l), '{p}')" for p in rules.phrases)  # none holds a quote
    seps = "(length(l) - length(translate(l, '|»›•', '')))"
    return f"""(({seps} >= {rules.max_separators} AND {seps} * 4 >= n) OR {_SYM.format('l')} > n * {rules.max_symbols_per_word}
      OR (n >= {rules.distinct_from} AND len(list_distinct(regexp_extract_all(l, '{WORD}'))) < n * {rules.min_distinct_share})
      OR (n > {rules.open_words} AND NOT regexp_matches(l, '[.!?:;,"''\\)\\]…”»。！？][\\x20\\x09-\\x0D]*$'))
      OR (n <= {rules.phrase_words} AND ({said})))"""


def op2_sql(rules: Rules = Rules()) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_W} AS w FROM documents),
win AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS r FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, l, len(regexp_extract_all(l, '{WORD}')) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (WHERE bad) AS gone, sum(CASE WHEN bad THEN n ELSE 0 END)::BIGINT AS lost
          FROM (SELECT *, {_sql_fails(rules)} AS bad FROM ln WHERE n > 0) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_SYM.format('t')}::BIGINT AS n_symbols,
                coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_lines_removed, coalesce(lost, 0)::BIGINT AS words_lost
         FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {rules.min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > 50 * n_words) AND words_lost <= n_words * {rules.max_lost} AS kept, n_lines_removed, words_lost
FROM base"""


OP2_SQL = op2_sql()
