"""Tables on laid-out pages, from the places of words alone."""

from __future__ import annotations

from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

# Shares of the median height of words, and what makes a run of rows a table.
BAND, GUTTER = 0.6, 1.5
LEAST_ROWS, LEAST_COLUMNS, MOST_WORDS = 3, 2, 4
#: A run of rows that holds so much of a page's words, with long cells, is its layout and no table.
DOMINANT = 0.9

Word = tuple[float, float, float, float, str]  # left, top, right, bottom, text


def bands(words: list[Word], height: float) -> list[list[Word]]:
    """Rows of words whose middles lie within a share of the height, from the top; words from the left."""
    out: list[list[Word]] = []
    at = None
    for w in sorted(words, key=lambda w: ((w[1] + w[3]) / 2, w[0])):
        middle = (w[1] + w[3]) / 2
        if at is None or middle - at > BAND * height:
            out.append([])
            at = middle
        out[-1].append(w)
    return [sorted(r, key=lambda w: w[0]) for r in out]


def _gaps(row: list[Word], width: float) -> list[tuple[float, float]]:
    """What is empty between a row's words, and at its sides."""
    out, at = [], float("-inf")
    for w in row:
        if w[0] - at >= width:
            out.append((at, w[0]))
        at = max(at, w[2])
    return [*out, (at, float("inf"))]


def _both(a: list[tuple[float, float]], b: list[tuple[float, float]], width: float) -> list[tuple[float, float]]:
    return [(lo, hi) for x in a for y in b if (hi := min(x[1], y[1])) - (lo := max(x[0], y[0])) >= width]


def _inner(gaps: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return [g for g in gaps if g[0] > float("-inf") and g[1] < float("inf")]


def find(words: list[Word]) -> list[list[list[str]]]:
    """Tables (rows of cells) of a page: runs of rows that share gutters, three rows and two columns at least, whose cells hold
    few words. Rows that span a gutter end a table."""
    if not words:
        return []
    height = median(w[3] - w[1] for w in words)
    width, rows = GUTTER * height, bands(words, height)
    out, i = [], 0
    while i < len(rows):
        gaps, j = _gaps(rows[i], width), i + 1
        while j < len(rows) and _inner(more := _both(gaps, _gaps(rows[j], width), width)):
            gaps, j = more, j + 1
        cuts = [(a + b) / 2 for a, b in _inner(gaps)]
        if j - i < LEAST_ROWS or len(cuts) + 1 < LEAST_COLUMNS:
            i += 1
            continue
        cells = [[[w[4] for w in r if lo <= (w[0] + w[2]) / 2 < hi] for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True)] for r in rows[i:j]]
        longest = max(len(c) for r in cells for c in r)
        if longest > MOST_WORDS or (sum(map(len, rows[i:j])) > DOMINANT * len(words) and longest > 2 and len(cuts) == 1):
            i += 1
            continue
        out.append([[" ".join(c) for c in r] for r in cells])
        i = j
    return out


def markdown(table: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return "\n".join([line(table[0]), line(["---"] * len(table[0])), *map(line, table[1:])])


def tables(words: DataFrame) -> DataFrame:
    """``doc, page, place, text``: the tables of pages, as Markdown; ``words``: doc, page, left, top, right, bottom, text. A page
    is one task's; null places and blank words are left out."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        got = find(list(zip(g["left"], g["top"], g["right"], g["bottom"], g["text"], strict=True)))
        return pd.DataFrame([(g["doc"].iat[0], g["page"].iat[0], i, markdown(t)) for i, t in enumerate(got)], columns=["doc", "page", "place", "text"])

    full = words.dropna(subset=["left", "top", "right", "bottom", "text"]).filter("trim(text) <> ''")
    return full.groupBy("doc", "page").applyInPandas(run, "doc long, page int, place int, text string")
