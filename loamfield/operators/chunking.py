"""Chunkers: a document's text -> ordered chunks. Lengths are code points."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNKS = "doc_id long, chunk_index int, start_pos int, end_pos int, text string"
# Separators in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: Chunks that a task holds at a time.
HELD = 8192


def _check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap below it")


def fixed(text: str, size: int = 512, overlap: int = 50) -> list[tuple[int, int, str]]:
    """Windows that end at a space where there is one; positions are those before trimming."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            space = text.rfind(" ", at + 1, end)
            end = space if space > at else end
        if body := text[at:end].strip():
            out.append((at, end, body))
        step = end - at - overlap
        at = n if end >= n else at + (step if step > 0 else end - at)
    return out


def recursive(text: str, size: int = 512, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts at the first separator, packed while they fit; parts that are too long go to the next one, then are cut hard."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    if not separators:
        return [x for i in range(0, len(text), size) if (x := text[i : i + size].strip())]
    sep, out, held = separators[0], [], ""
    for part in text.split(sep):
        joined = f"{held}{sep}{part}" if held else part
        if len(joined) <= size:
            held = joined
            continue
        if held.strip():
            out.append(held.strip())
        held = part if len(part) <= size else ""
        if len(part) > size:
            out += recursive(part, size, separators[1:])
    return out + ([held.strip()] if held.strip() else [])


def code(text: str, size: int = 512, separators: tuple[str, ...] = ("\nclass ", "\ndef ", "\n\n", "\n", " ")) -> list[str]:
    """Segments that each begin with the separator they were parted at; those that are too long go to the next separator."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    if not separators:
        return [x for i in range(0, len(text), size) if (x := text[i : i + size].strip())]
    sep, head, *rest = separators[0], *text.split(separators[0])
    return [x for part in [head, *[sep + r for r in rest]] for x in code(part, size, separators[1:])]


def breadcrumbs(sections: DataFrame, depth: int = 6) -> DataFrame:
    """``sections`` (doc, place, level, heading) with ``path``: the headings that are open at each section, by " > ".

    A heading closes those of its level and of deeper ones; a section without a level stands below what is open.
    """
    w = Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct("place", "heading")
    for n in range(1, depth + 1):
        sections = sections.withColumn(f"at_{n}", F.max(F.when(F.col("level") == n, here)).over(w)).withColumn(f"up_{n}", F.max(F.when(F.col("level") < n, F.col("place"))).over(w))
    open_ = [F.when(F.col(f"at_{n}.place") > F.coalesce(F.col(f"up_{n}"), F.lit(-1)), F.col(f"at_{n}.heading")) for n in range(1, depth + 1)]
    return sections.withColumn("path", F.concat_ws(" > ", *open_)).drop(*[f"{x}_{n}" for n in range(1, depth + 1) for x in ("at", "up")])


def _bare(c) -> F.Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def merged(sections: DataFrame, depth: int = 2, patterns: list[list[str]] | None = None) -> DataFrame:
    """doc, part, heading, level, first_page, last_page, n_sections, text: each heading of level ``depth`` or less opens a part,
    which takes the sections (doc, place, level, heading, text and, if there, page) up to the next; what comes before the
    first heading is part 0. A part's text is its heading and the trimmed texts of the sections below it.

    ``patterns``: for each level those that make a section's text a heading where the section states no level. A heading
    without words of its own is its text without marks. Sizes don't matter.
    """
    level = F.col("level")
    for i, some in enumerate(patterns or [], 1):
        here = F.lit(False)
        for x in some:
            here = here | F.rlike("text", F.lit(f"(?m){x}"))
        level = F.coalesce(level, F.when(here & ~_any(patterns[: i - 1]), i))
    s = sections.withColumn("level_", level)
    opens = F.coalesce(F.col("level_") <= depth, F.lit(False))
    page = F.col("page") if "page" in sections.columns else F.lit(None).cast("int")
    s = s.withColumns({"opens": opens, "page_": page, "part": F.sum(opens.cast("int")).over(Window.partitionBy("doc").orderBy("place"))})
    title = F.when(F.col("opens"), F.coalesce("heading", _bare(F.regexp_replace("text", r"^#{1,6}\s+", ""))))
    x = F.sort_array(F.collect_list(F.when(~F.col("opens"), F.struct("place", _bare(F.col("text")).alias("t")))))  # one document's sections at most
    s = s.groupBy("doc", "part").agg(F.max(title).alias("heading"), F.max(F.when(F.col("opens"), F.col("level_"))).alias("level"), F.min("page_").alias("first_page"), F.max("page_").alias("last_page"), F.count(F.lit(1)).alias("n_sections"), x.alias("x"))
    body = _bare(F.array_join("x.t", "\n"))
    s = s.withColumn("text", F.when(F.coalesce("heading", F.lit("")) != "", F.concat("heading", F.lit("\n\n"), body)).otherwise(body))
    return s.filter("text <> ''").drop("x").select("doc", "part", "heading", "level", "first_page", "last_page", "n_sections", "text")


def _any(levels: list[list[str]]) -> F.Column:
    hit = F.lit(False)
    for some in levels:
        for x in some:
            hit = hit | F.rlike("text", F.lit(f"(?m){x}"))
    return hit


# Headings that templates know, and the patterns of clauses by level.
ABSTRACT, REFERENCES = ("abstract",), ("references", "bibliography", "works cited")
CONTENTS, INDEX, FOREWORD = ("table of contents", "contents"), ("index",), ("foreword", "preface", "introduction")
CLAUSES = [[r"^\d+\.\s"], [r"^\d+\.\d+\s"], [r"^\d+\.\d+\.\d+\s"]]


def _named(names: tuple[str, ...]) -> F.Column:
    return F.coalesce(F.lower(F.trim("heading")).isin(*names), F.lit(False))


def paper(sections: DataFrame, abstract: bool = True, references: bool = False) -> DataFrame:
    """doc, part, kind, heading, text of academic papers: what stands before the abstract goes, the abstract is a chunk of its
    own, and the rest, without its references, is merged under headings."""
    w = Window.partitionBy("doc")
    s = sections.withColumn("at_", F.min(F.when(_named(ABSTRACT), F.col("place"))).over(w))
    own = F.col("at_").isNotNull() & (F.col("place") == F.col("at_"))
    rest = s.filter(F.col("at_").isNull() | (F.col("place") > F.col("at_")) | (own if not abstract else F.lit(False)))
    rest = merged((rest if references else rest.filter(~_named(REFERENCES))).drop("at_")).select("doc", (F.col("part") + 1).alias("part"), F.lit("body").alias("kind"), "heading", "text")
    if not abstract:
        return rest
    return s.filter(own).select("doc", F.lit(0).cast("long").alias("part"), F.lit("abstract").alias("kind"), "heading", "text").unionByName(rest)


def book(sections: DataFrame, depth: int = 2, index: bool = False, foreword: bool = True) -> DataFrame:
    """doc, part, heading, level, chapter, text of books: tables of contents go (by their heading, or where more than half of
    the lines end in a page number), index and foreword if not asked for; the chapter is the last heading of level 1."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    listed = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(r"\s+\d+\s*$")))) > 0.5 * F.size(lines)
    gone = _named(CONTENTS) | listed
    gone = gone | (_named(INDEX) if not index else F.lit(False)) | (_named(FOREWORD) if not foreword else F.lit(False))
    m = merged(sections.filter(~gone), depth)
    w = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.withColumn("chapter", F.last(F.when(F.col("level") == 1, F.col("heading")), ignorenulls=True).over(w)).select("doc", "part", "heading", "level", "chapter", "text")


def clauses(sections: DataFrame, depth: int = 3, patterns: list[list[str]] | None = None) -> DataFrame:
    """doc, part, clause, text of legal texts, merged under numbered headings."""
    return merged(sections, depth, patterns or CLAUSES).select("doc", "part", F.coalesce("heading", F.lit("")).alias("clause"), "text")


def mail_parts(sections: DataFrame, headers: bool = True, attachments: bool = True) -> DataFrame:
    """doc, part, kind, text: a chunk for each part of a mail (heading: headers, attachment:name or none)."""
    part = F.coalesce("heading", F.lit("body"))
    s = sections.withColumn("kind", part)
    s = s if headers else s.filter("kind <> 'headers'")
    s = s if attachments else s.filter("kind not like 'attachment:%'")
    return s.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("place")) - 1).alias("part"), "kind", "text")


def pairs(sections: DataFrame) -> DataFrame:
    """doc, part, text, answer: a chunk for each question (sections whose heading is the answer)."""
    return sections.select("doc", F.col("place").alias("part"), "text", F.coalesce("heading", F.lit("")).alias("answer"))


def chunk(docs: DataFrame, how: str = "fixed", size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text); null and blank texts have none."""
    _check(size, overlap)

    def parts(d, t):
        if how == "fixed":
            yield from ((d, i, *c) for i, c in enumerate(fixed(t, size, overlap)))
        elif how == "code":
            at = 0
            for i, p in enumerate(code(t, size)):
                at = t.index(p, at)
                yield d, i, at, at + len(p), p
                at += len(p)
        else:
            some, at = recursive(t, size), 0
            for i, p in enumerate(some):
                at = max(t.find(p, at), 0)
                lead = some[i - 1][-overlap:] if i and overlap else ""
                yield d, i, at, at + len(p), lead + p
                at += len(p)

    def run(batches):
        for whole in batches:
            rows = []
            for a in range(0, whole.num_rows, 64):  # texts as objects by the 64, chunks by some ``HELD``
                b = whole.slice(a, 64)
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    for row in parts(d, t or ""):
                        rows.append(row)
                        if len(rows) >= HELD:
                            yield _batch(rows)
                            rows = []
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "chunk_index", "start_pos", "end_pos", "text"])
