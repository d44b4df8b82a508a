"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{Nd}]+"
# Personal-data patterns in the order in which they apply, and prompt-injection phrases.
PII = [
    ("[EMAIL]", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("[PHONE]", r"(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b"),
    ("[SSN]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("[CREDIT_CARD]", r"\b(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    ("[IP_ADDRESS]", r"\b(?:\d{1,3}\.){3}\d{1,3}\b|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
]
#: What a text must hold for the patterns from the second on: cheap tests, on the text as it was.
_NEEDS = (r"\d{3}[\s\-.)]*\d{3}", r"\d-\d\d-\d", r"\d{4}[\s\-]?\d{4}", r"\d\.\d|[0-9a-fA-F]:[0-9a-fA-F]")
INJECTION = r"(?:ignore\s+previous\s+instructions|you\s+are\s+now|act\s+as|disregard|new\s+instructions|system\s+prompt|<\|system\|>|<\|user\|>|\[INST\]|###\s*instruction)"


# Fixed value: scripts that don't part words: ideographs, kana, hangul.
CJK = "\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af\u1100-\u11ff"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; runs of scripts that don't part words give their overlapping pairs of letters
    (a single one stands alone). Null has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{Nd}}&&[^{CJK}]]+"), F.lit(0))
    pairs = F.transform(runs, lambda t: F.when(F.rlike(t, F.lit(f"^[{CJK}]{{2}}")), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array(t)))
    return F.when(F.rlike(low, F.lit(f"[{CJK}]")), F.flatten(pairs)).otherwise(plain)


def safe_name(name: Column, most: int = 128) -> Column:
    """A file name without what file systems refuse, trimmed and cut; ``untitled`` if nothing is left."""
    clean = F.trim(F.substring(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")), 1, most))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("untitled"))


def redact_pii(text: Column) -> Column:
    """Texts that lack what a pattern needs (an @, digits, a colon) aren't searched for it."""
    for (mark, pattern), needs in zip(PII, (F.contains(text, F.lit("@")), *[F.rlike(text, F.lit(x)) for x in _NEEDS]), strict=True):
        text = F.when(needs, F.regexp_replace(text, f"(?i){pattern}", mark)).otherwise(text)
    return text


def redact_injection(text: Column) -> Column:
    return F.regexp_replace(text, f"(?i){INJECTION}", "[REDACTED]")


def query_hash(text: Column) -> Column:
    """First eight hex digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 8)


# Phrases that join questions, and words that ask for more than a fact.
JOINS = (" and ", " also ", " additionally ", " furthermore ", " as well as ")
ASKS = ("how", "why", "compare", "difference", "explain")


def query_class(q: Column) -> Column:
    """multi_hop, complex or simple, by conjunctions, question words and length; else complex."""
    low = F.lower(q)
    joins = sum((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p) for p in JOINS)
    asks = F.lit(False)
    for w in ASKS:
        asks = asks | F.contains(low, F.lit(w))
    n = F.size(F.array_remove(F.split(q, r"\s+"), ""))
    return F.when(joins >= 2, "multi_hop").when(asks, "complex").when(n <= 6, "simple").otherwise("complex")
