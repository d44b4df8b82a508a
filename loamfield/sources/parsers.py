"""Parsers: the content of a file -> sections (place, heading, level, page, text).

Text, Markdown, JSON, HTML, office files, EPUB and ZIP archives, with the standard library alone. A parser is a function of
bytes; :func:`sections` runs the one that the content type names over a table of files, a row for each section.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import posixpath
import re
import zipfile
from dataclasses import dataclass
from email import message_from_bytes, policy
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Elements whose text isn't content, and those that have no end tag.
DROPPED = {"script", "style", "nav", "footer", "header"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
_BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", *HEADINGS}
#: Elements that end where another of the same set begins beside them.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Section:
    text: str
    heading: str | None = None
    level: int | None = None
    page: int | None = None


class _Node:
    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []

    def elements(self):
        """All elements below, in document order, without recursion."""
        todo = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while todo:
            x = todo.pop()
            yield x
            todo += [c for c in reversed(x.children) if isinstance(c, _Node)]

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.children)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        close = _ENDS.get(tag, set()) | ({"p"} if tag in _BLOCK else set())
        if self.at.tag in close:
            self.at = self.at.parent
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def html(content: bytes | str) -> list[Section]:
    """A section for each heading: its text and that of the elements beside it up to the next heading; without headings the
    whole body is one. Links show their targets; white space is collapsed."""
    tree = _Tree()
    tree.feed(content if isinstance(content, str) else content.decode("utf-8", "replace"))
    tree.close()
    root = next((x for x in tree.root.elements() if x.tag == "body"), tree.root)
    for x in list(root.elements()):
        if x.tag in DROPPED and x.parent is not None:
            x.parent.children = [c for c in x.parent.children if c is not x]
    for x in list(root.elements()):
        if x.tag == "a" and x.attrs.get("href") and (t := x.text().strip()):
            x.children = [f"{t} ({x.attrs['href']})"]
    if root is tree.root:
        root.children = [c for c in root.children if not (isinstance(c, _Node) and c.tag == "head")]
    clean = lambda x: " ".join(x.text().split())
    heads = [x for x in root.elements() if x.tag in HEADINGS]
    if not heads:
        return [Section(t)] if (t := clean(root)) else []
    out = []
    for h in heads:
        title = h.text().strip()
        beside = [c for c in h.parent.children if isinstance(c, _Node)]
        lines = [title]
        for x in beside[next(i for i, c in enumerate(beside) if c is h) + 1 :]:
            if x.tag in HEADINGS:
                break
            if t := clean(x):
                lines.append(t)
        if body := "\n".join(lines).strip():
            out.append(Section(body, title, HEADINGS[h.tag]))
    return out


def text(content: bytes | str) -> list[Section]:
    """One section, or none if there is nothing but white space."""
    s = content if isinstance(content, str) else content.decode("utf-8-sig", "replace")
    return [Section(s)] if s.strip() else []


_MARK = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)


def markdown(content: bytes | str) -> list[Section]:
    """A section from each heading line to the next, headings in code fences too; what stands before the first is one."""
    s = content if isinstance(content, str) else content.decode("utf-8-sig", "replace")
    s = s.replace("\r\n", "\n")
    marks = list(_MARK.finditer(s))
    out = [Section(t)] if (t := s[: marks[0].start() if marks else len(s)].strip()) else []
    for m, end in zip(marks, [*(x.start() for x in marks[1:]), len(s)]):  # noqa: B905
        out.append(Section(s[m.start() : end].strip(), m[2].strip(), len(m[1])))
    return out


def json_sections(content: bytes | str) -> list[Section]:
    """The elements of a root array, or the whole value, printed with indents."""
    value = json.loads(content)
    show = lambda v: v if isinstance(v, str) else json.dumps(v, indent=2, ensure_ascii=False)
    return [Section(show(v)) for v in (value if isinstance(value, list) else [value])]


def csv_rows(content: bytes | str) -> list[Section]:
    """``name: value | name: value`` of each line; commas part cells whatever quotes there are, missing cells are empty."""
    s = content if isinstance(content, str) else content.decode("utf-8-sig", "replace")
    lines = [x for x in s.splitlines() if x.strip()]
    names = [c.strip() for c in lines[0].split(",")] if lines else []
    out = []
    for line in lines[1:]:
        cells = [c.strip() for c in line.split(",")]
        out.append(Section(" | ".join(f"{n}: {cells[i] if i < len(cells) else ''}" for i, n in enumerate(names))))
    return out


# Names of the columns of questions and of answers, in the order in which they are looked for.
QUESTIONS, ANSWERS = ("question", "q", "prompt", "input"), ("answer", "a", "response", "output")


def question_pairs(rows: list[list[str]]) -> list[Section]:
    """A section for each row with a question: its text; the answer stands as the heading. The first row names the columns."""
    if not rows:
        return []
    names = [str(c).strip().lower() for c in rows[0]]
    find = lambda some: next((names.index(x) for x in some if x in names), None)
    q, a = find(QUESTIONS), find(ANSWERS)
    if q is None or a is None:
        raise ValueError("no columns of questions and answers")
    cell = lambda r, i: str(r[i]).strip() if i < len(r) and r[i] is not None else ""
    return [Section(cell(r, q), cell(r, a)) for r in rows[1:] if cell(r, q)]


def qa_csv(content: bytes | str) -> list[Section]:
    s = content if isinstance(content, str) else content.decode("utf-8-sig", "replace")
    return question_pairs(list(csv.reader(io.StringIO(s))))


# ---- containers: budgets hold for a file and all it contains --------------------------------------------------------


class OverBudget(ValueError):
    """A container holds more than may be read."""


@dataclass
class Budget:
    """What may be read from a file and the containers within it."""

    entries: int = 1000
    total: int = 256 << 20
    ratio: float = 200.0
    depth: int = 5

    def read(self, z: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
        self.entries -= 1
        if self.entries < 0:
            raise OverBudget("too many entries")
        out = io.BytesIO()
        with z.open(info) as f:
            while piece := f.read(1 << 16):  # counted as it is read, whatever sizes the archive states
                self.total -= len(piece)
                out.write(piece)
                if self.total < 0 or out.tell() > self.ratio * max(info.compress_size, 1) + (1 << 16):
                    raise OverBudget("too many bytes")
        return out.getvalue()


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _part(z: zipfile.ZipFile, name: str, budget: Budget) -> ElementTree.Element:
    return ElementTree.fromstring(budget.read(z, z.getinfo(name)))


def word(content: bytes, budget: Budget | None = None) -> list[Section]:
    """A section for each paragraph with a heading style and what follows it; what stands before the first heading is left
    out. Without headings all paragraphs are one section."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _part(z, "word/document.xml", budget or Budget())
    out: list[Section] = []
    plain: list[str] = []
    for p in body.iter(f"{_W}p"):
        t = "".join(x.text or "" for x in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        m = re.fullmatch(r"heading ?([1-6])", (style.get(f"{_W}val") if style is not None else "").lower())
        if m and t:
            out.append(Section(t, t, int(m[1])))
        elif t:
            plain.append(t)
            if out:
                out[-1].text += "\n" + t
    return out or ([Section("\n".join(plain))] if plain else [])


def sheet_rows(content: bytes, budget: Budget | None = None) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cells) of each sheet of a workbook."""
    budget = budget or Budget()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [("".join(t.text or "" for t in x.iter(f"{_S}t"))) for x in _part(z, "xl/sharedStrings.xml", budget).findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        book = _part(z, "xl/workbook.xml", budget)
        target = {r.get("Id"): r.get("Target") for r in _part(z, "xl/_rels/workbook.xml.rels", budget)}
        out = []
        for sheet in book.iter(f"{_S}sheet"):
            rows = []
            path = target[sheet.get(f"{_R}id")]
            for r in _part(z, path.lstrip("/") if path.startswith("/") else f"xl/{path}", budget).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for n, c in enumerate(r.findall(f"{_S}c")):
                    letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                    i = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else n
                    v = c.find(f"{_S}v")
                    if c.get("t") == "inlineStr":
                        cells[i] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is not None:
                        cells[i] = shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name"), rows))
    return out


def excel(content: bytes, budget: Budget | None = None) -> list[Section]:
    """``name: value | …`` of each row below the first of each sheet; the heading is the sheet's name."""
    out = []
    for name, rows in sheet_rows(content, budget):
        for r in rows[1:]:
            if any(r):
                out.append(Section(" | ".join(f"{h}: {r[i] if i < len(r) else ''}" for i, h in enumerate(rows[0])), name))
    return out


def slides(content: bytes, budget: Budget | None = None) -> list[Section]:
    """A section for each slide with text; the page is the slide's number."""
    budget, out = budget or Budget(), []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for i, (_, n) in enumerate(names, 1):
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in _part(z, n, budget).iter(f"{_A}p")]
            if t := "\n".join(x for x in lines if x.strip()).strip():
                out.append(Section(t, page=i))
    return out


def epub(content: bytes, budget: Budget | None = None) -> list[Section]:
    """The sections of the book's pages, in reading order."""
    budget = budget or Budget()
    local = lambda x: x.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        package = next(x.get("full-path") for x in _part(z, "META-INF/container.xml", budget).iter() if local(x) == "rootfile")
        book = _part(z, package, budget)
        items = {x.get("id"): x.get("href") for x in book.iter() if local(x) == "item"}
        order = [items[x.get("idref")] for x in book.iter() if local(x) == "itemref" and x.get("idref") in items]
        base = posixpath.dirname(package)
        return [s for href in order for s in html(budget.read(z, z.getinfo(posixpath.normpath(posixpath.join(base, href)))))]


def archive(content: bytes, name: str = "", budget: Budget | None = None) -> list[tuple[str, list[Section]]]:
    """(``archive#entry``, sections) of the entries that a parser knows, archives within it too. An entry that can't be
    parsed is left out; one that breaks the budget ends all with :class:`OverBudget`."""
    budget, out = budget or Budget(), []
    todo = [(name, content, 0)]
    while todo:
        at, data, depth = todo.pop()
        if depth > budget.depth:
            raise OverBudget("nested too deep")
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            continue
        with z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                entry, kind = f"{at}#{info.filename}", content_type(info.filename)
                body = budget.read(z, info)
                if kind == "application/zip":
                    todo.append((entry, body, depth + 1))
                    continue
                try:
                    out.append((entry, parse(body, kind, budget)))
                except OverBudget:
                    raise
                except Exception:  # noqa: BLE001  (one bad entry isn't the archive's end)
                    continue
    return out


#: Attachments and attached messages that are read of one message.
MOST_PARTS = 50


def mail(content: bytes, budget: Budget | None = None) -> list[Section]:
    """Sections of an RFC 822 message: ``headers``, its text parts (by content type; HTML as visible text), and a section
    ``attachment:name`` for each section of what is attached, or an empty one if no parser reads it. Attached messages follow
    with sections of their own, by a stack, up to a depth and a number of parts."""
    budget, out, parts = budget or Budget(), [], 0
    todo: list[tuple[object, int]] = [(message_from_bytes(bytes(content), policy=policy.default), 0)]
    while todo:
        m, depth = todo.pop()
        if depth > budget.depth:
            raise OverBudget("nested too deep")
        out.append(Section("\n".join(f"{h}: {m[h]}" for h in ("From", "To", "Subject", "Date") if m[h]), "headers"))
        inner, inside = [], list(reversed(m.get_payload())) if m.is_multipart() else [m]
        while inside:
            part = inside.pop()
            kind, name = part.get_content_type(), part.get_filename()
            if kind == "message/rfc822":
                parts += 1
                inner += [(x, depth + 1) for x in part.get_payload()]
            elif part.is_multipart():
                inside += reversed(part.get_payload())
            elif name:
                parts += 1
                data = part.get_payload(decode=True) or b""
                budget.total -= len(data)
                if budget.total < 0:
                    raise OverBudget("too many bytes")
                try:
                    found = parse(data, content_type(name), budget)
                except OverBudget:
                    raise
                except Exception:  # noqa: BLE001  (an attachment that can't be read is named)
                    found = []
                out += [Section(s.text, f"attachment:{name}", s.level, s.page) for s in found] or [Section("", f"attachment:{name}")]
            elif part.get_content_maintype() == "text":
                t = (part.get_payload(decode=True) or b"").decode(_charset(part), "replace").strip()
                out.append(Section("\n\n".join(s.text for s in html(t)) if kind == "text/html" else t, kind))
            if parts > MOST_PARTS:
                raise OverBudget("too many parts")
        todo += reversed(inner)
    return out


def _charset(part) -> str:
    try:
        return codecs.lookup(part.get_content_charset() or "utf-8").name
    except LookupError:
        return "utf-8"


# Content types by extension; anything else is plain text.
TYPES = {
    ".eml": "message/rfc822",
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".csv": "text/csv", ".json": "application/json", ".html": "text/html", ".htm": "text/html",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".epub": "application/epub+zip", ".zip": "application/zip",
}
PARSERS = {
    "message/rfc822": mail, "text/plain": text, "text/markdown": markdown, "text/csv": csv_rows, "application/json": json_sections, "text/html": html,
    TYPES[".docx"]: word, TYPES[".xlsx"]: excel, TYPES[".pptx"]: slides, TYPES[".epub"]: epub,
}


def content_type(name: str, stated: str | None = None) -> str:
    """The type stated, else that of the extension, else plain text."""
    return stated or TYPES.get(posixpath.splitext(name.lower())[1], "text/plain")


def parse(content: bytes, kind: str, budget: Budget | None = None) -> list[Section]:
    parser = PARSERS.get(kind)
    if parser is None:
        raise ValueError(f"no parser for {kind}")
    return parser(content, budget) if budget and parser in (word, excel, slides, epub, mail) else parser(content)


SECTIONS = "id string, place int, heading string, level int, page int, text string"


def sections(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """``id, place, heading, level, page, text`` of ``files`` (id, content, and content_type if the table has it).

    Null content has no sections. Entries of archives have ids of their own. ``parsers``: more functions by content type
    (for pictures, sound or scans: whatever model reads them).
    """
    stated = "content_type" in files.columns
    more = parsers or {}

    def run(batches):
        for b in batches:
            rows = []
            for i, (name, content) in enumerate(zip(b["id"], b["content"], strict=True)):
                if content is None:
                    continue
                kind = content_type(name, b["content_type"].iat[i] if stated else None)
                found = archive(content, name) if kind == "application/zip" else [(name, more[kind](content) if kind in more else parse(content, kind))]
                rows += [(n, k, s.heading, s.level, s.page, s.text) for n, some in found for k, s in enumerate(some)]
            out = pd.DataFrame(rows, columns=["id", "place", "heading", "level", "page", "text"])
            yield out.astype({"level": "Int32", "page": "Int32", "place": "int32"})

    return files.select("id", "content", *(["content_type"] if stated else [])).mapInPandas(run, SECTIONS)


# ---- names and replies ----------------------------------------------------------------------------------------------


def clock(seconds: float) -> str:
    """``mm:ss.fff``, as headings of spoken passages show it."""
    ms = round(seconds * 1000)
    return f"{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def spoken(segments: list[tuple[float, float, str]]) -> list[Section]:
    """Sections of recognised speech (start, end, text); blank ones are left out."""
    return [Section(t.strip(), f"{clock(a)} - {clock(b)}") for a, b, t in segments if t.strip()]


def _balanced(s: str, at: int) -> int:
    """The end of the bracketed value that begins at ``at``; -1 if it never ends. Brackets in strings don't count."""
    depth, quoted, i = 0, False, at
    while i < len(s):
        c = s[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def reply_json(reply: str | None):
    """The JSON value in a model's reply: the first fenced block if it is valid, else the longest bracketed value that is;
    None if there is none."""
    if not reply:
        return None
    fence = re.search(r"```[a-zA-Z]*\s*\n?(.*?)```", reply, re.S)
    tries = [fence[1].strip()] if fence else []
    spans, i = [], 0
    while (m := re.compile(r"[{\[]").search(reply, i)) is not None:
        end = _balanced(reply, m.start())
        if end > 0:
            spans.append(reply[m.start() : end])
        i = end if end > 0 else m.start() + 1
    for x in tries + sorted(spans, key=len, reverse=True):
        try:
            value = json.loads(x)
        except ValueError:
            continue
        if isinstance(value, dict | list):
            return value
    return None
