"""Parsers, feeds and listings on small cases."""

import io
import json
import zipfile

import pytest

from loamfield.sources import feeds, parsers, remote, tables, web


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_html():
    page = "<html><head><title>t</title><style>x</style></head><body><header>no</header><nav>no</nav><h1>A <b>b</b></h1><p>one <a href='/x'>two</a><p>three<script>no</script><div><h2>in</h2> <p>a</div><p>after<h3></h3></body></html>"
    got = parsers.html(page)
    assert [(s.heading, s.level, s.text) for s in got] == [("A b", 1, "A b\none two (/x)\nthree\nin a\nafter"), ("in", 2, "in\na")]
    assert parsers.html("<p>only   text</p>")[0].text == "only text" and parsers.html("<body>  </body>") == [] and parsers.html("") == []
    assert parsers.html("<b>" * 5000 + "deep")[0].text == "deep"


def test_html_by_brute_force(spark):
    """Against a plain walk: visible text of a page's sections has the words between its headings."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).collect()
    for r in pages:
        words = " ".join(s.text for s in parsers.html(r.html))
        assert "track(0)" not in words and "margin:0" not in words
        heads = [s.heading for s in parsers.html(r.html)]
        assert all(h is None or h in words for h in heads)


def test_text_markdown_json_csv():
    assert parsers.text(b" \n ") == [] and parsers.text("x\n")[0].text == "x\n"
    md = parsers.markdown("intro\n# A\nx\n```\n# in code\n```\n## B  \ny")
    assert [(s.heading, s.level) for s in md] == [(None, None), ("A", 1), ("in code", 1), ("B", 2)]
    assert [json.loads(s.text) for s in parsers.json_sections('[{"a": 1}, [2]]')] == [{"a": 1}, [2]] and len(parsers.json_sections('{"a": 1}')) == 1
    assert [s.text for s in parsers.csv_rows("a, b\n1,\n\n2,3,4\n")] == ["a: 1 | b: ", "a: 2 | b: 3"] and parsers.csv_rows("") == []
    qa = parsers.qa_csv('id,Prompt,Output\n1,"What, now?",this\n2,,that\n')
    assert [(s.text, s.heading) for s in qa] == [("What, now?", "this")]
    with pytest.raises(ValueError):
        parsers.qa_csv("a,b\n1,2")


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def docx():
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={style!r}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    return zipped(**{"word/document.xml": f'<w:document {W}><w:body>{p("lost")}{p("One", "Heading1")}{p("a")}{p("b")}{p("Two", "Heading2")}</w:body></w:document>'})


def xlsx():
    cell = lambda r, v, t="": f'<c r="{r}" {t}><v>{v}</v></c>'
    rows = f'<row>{cell("A1", 0, "t=" + chr(34) + "s" + chr(34))}{cell("C1", "x")}</row><row>{cell("A2", 7)}{cell("C2", 8)}</row><row/>'
    return zipped(**{
        "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="First" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>key</t></si></sst>", "xl/worksheets/s.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>"})


def test_office_and_books():
    assert [(s.heading, s.level, s.text) for s in parsers.word(docx())] == [("One", 1, "One\na\nb"), ("Two", 2, "Two")]
    assert [(s.heading, s.text) for s in parsers.excel(xlsx())] == [("First", "key: 7 | :  | x: 8")]
    slide = lambda t: f"<p:sld xmlns:p='p' {A}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>"
    deck = zipped(**{"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two"), "ppt/slides/slide1.xml": slide(" ")})
    assert [(s.page, s.text) for s in parsers.slides(deck)] == [(2, "two"), (3, "ten")]
    book = zipped(**{
        "META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>',
        "O/b.opf": '<package xmlns="p"><manifest><item id="x" href="x.html"/><item id="y" href="sub/y.html"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>',
        "O/x.html": "<h1>X</h1><p>x</p>", "O/sub/y.html": "<p>y</p>"})
    assert [s.text for s in parsers.epub(book)] == ["y", "X\nx"]


def test_archives(spark):
    inner = zipped(**{"c.txt": "deep"})
    whole = zipped(**{"a.txt": "text", "b.json": "{broken", "d/e.md": "# H\nx", "in.zip": inner, "doc.docx": docx()})
    got = dict(parsers.archive(whole, "w.zip"))
    assert set(got) == {"w.zip#a.txt", "w.zip#d/e.md", "w.zip#in.zip#c.txt", "w.zip#doc.docx"}
    for budget in (parsers.Budget(entries=2), parsers.Budget(total=3), parsers.Budget(depth=0)):
        with pytest.raises(parsers.OverBudget):
            parsers.archive(whole, "w.zip", budget)
    bomb = zipped(**{"z.txt": "0" * (4 << 20)})
    with pytest.raises(parsers.OverBudget):
        parsers.archive(bomb, "b.zip", parsers.Budget(ratio=10))
    files = spark.createDataFrame([("w.zip", bytearray(whole)), ("x.txt", None), ("y.html", bytearray(b"<h1>Y</h1>"))], "id string, content binary")
    assert {(r.id, r.place) for r in parsers.sections(files).collect()} == {("w.zip#a.txt", 0), ("w.zip#d/e.md", 0), ("w.zip#in.zip#c.txt", 0), ("w.zip#doc.docx", 0), ("w.zip#doc.docx", 1), ("y.html", 0)}
    assert parsers.sections(files.limit(0)).count() == 0


def test_tables():
    word = lambda x, y, t: (x, y, x + 6.0 * len(t), y + 10.0, t)
    grid = [word(x, 100 + 14 * r, f"{c}{r}") for r in range(4) for c, x in (("a", 50), ("b", 150), ("c", 260))]
    prose = [word(50 + 40 * i, 20 + 14 * r, "words") for r in range(4) for i in range(8)]
    assert tables.find(grid + prose) == [[[f"{c}{r}" for c in "abc"] for r in range(4)]] and tables.find(prose) == [] and tables.find([]) == []
    assert tables.find(grid[:6]) == [] and tables.find([w for w in grid if w[4] != "b2"])[0][2] == ["a2", "", "c2"]
    assert tables.markdown([["a|b", "c"], ["1", "2"]]) == "| a\\|b | c |\n| --- | --- |\n| 1 | 2 |"


def test_mail():
    from email.message import EmailMessage

    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("deep")
    m = EmailMessage()
    m["Subject"], m["From"] = "outer", "a@b.c"
    m.set_content("plain")
    m.add_alternative("<p>rich <b>text</b></p>", subtype="html")
    m.add_attachment(b"# H\nx", maintype="text", subtype="markdown", filename="n.md")
    m.add_attachment(b"\x00", maintype="application", subtype="zip", filename="z.zip")
    m.add_attachment(inner)
    got = [(s.heading, s.text) for s in parsers.mail(m.as_bytes())]
    assert got == [("headers", "From: a@b.c\nSubject: outer"), ("text/plain", "plain"), ("text/html", "rich text"), ("attachment:n.md", "# H\nx"), ("attachment:z.zip", ""), ("headers", "Subject: inner"), ("text/plain", "deep")]
    with pytest.raises(parsers.OverBudget):
        parsers.mail(m.as_bytes(), parsers.Budget(depth=0))
    assert parsers.mail(b"") == [parsers.Section("", "headers"), parsers.Section("", "text/plain")]


def test_replies_and_clocks():
    assert parsers.reply_json('x ```json\n{"a": [1, "}"]}\n``` [1, 2, 3, 4, 5]') == {"a": [1, "}"]} and parsers.reply_json("```\nnope\n``` [1] {\"a\": 2}") == {"a": 2}
    assert parsers.reply_json("nothing {here") is None and parsers.reply_json(None) is None and parsers.reply_json('say "{" then [1]') == [1]
    assert parsers.clock(61.2345) == "01:01.234" and [s.heading for s in parsers.spoken([(0, 1.5, " hi "), (1, 2, " ")])] == ["00:00.000 - 00:01.500"]


def test_crawl(spark):
    at = "https://x.org"
    pages = [(at, '<a href="/a">1</a><A HREF=\'b/\'>2</A><a class=c href=//x.org/c#f>3</a><a href="https://y.org/z">4</a><a href="mailto:m">5</a>'), (f"{at}/a", '<a href="/d">d</a><a href="/no/x">n</a>'), (f"{at}/d", '<a href="/e">e</a>'), (f"{at}/e", '<a href="/f">')]
    df = spark.createDataFrame(pages, "url string, html string")
    got = [(r.url.removeprefix(at), r.depth) for r in feeds.crawl(df, at, rules=["/no"]).orderBy("place").collect()]
    assert got == [("", 0), ("/a", 1), ("/b", 1), ("/c", 1), ("/d", 2), ("/e", 3)]
    assert len(feeds.crawl(df, at, most=3).collect()) == 3
    assert feeds.robots("User-agent: other\nDisallow: /x\nUser-agent: *\nDisallow: /no # c\nDisallow:\n") == ["/no"]
    assert {r.target for r in web.links(df.withColumnRenamed("url", "page_id").limit(1)).collect()} >= {"/a", "b", "//x.org/c"}


def test_feeds(spark):
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>T</title><link href='https://x/1'/><author><name>N</name></author><updated>2024</updated></entry><entry/></feed>"
    got = feeds.feed_entries(spark.createDataFrame([("a", atom), ("b", "<broken"), ("c", None)], "feed string, content string")).collect()
    assert [(r.id, r.url, r.author, r.published_at) for r in got] == [("https://x/1", "https://x/1", "N", "2024")]


def test_beir(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": " T ", "text": "x"}\n{"_id": "d2", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "x"}\n')
    rels = tmp_path / "qrels" / "test.tsv"
    rels.write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td1\t2\n")
    corpus, queries, judged = feeds.beir(spark, str(tmp_path))
    assert {r.id: r.body for r in corpus.collect()} == {"d1": "T x", "d2": "y"} and queries.count() == 1 and [tuple(r) for r in judged.collect()] == [("q1", "d1", 2)]
    for bad in ("q1\td1\t1\n", "query-id\tcorpus-id\tscore\nq1\td1\n", "query-id\tcorpus-id\tscore\n"):
        rels.write_text(bad)
        with pytest.raises(ValueError):
            feeds.beir(spark, str(tmp_path))


def test_listings(spark):
    page = lambda x: spark.createDataFrame([(json.dumps(p),) for p in x], "body string")
    got = remote.listing(page([{"files": [{"filename": "a", "sha": "1", "status": "removed"}, {"filename": "b", "sha": "2", "status": "added"}]}]), "github_compare").collect()
    assert {(r.id, r.etag, r.removed, r.metadata["change_status"]) for r in got} == {("a", "1", True, "removed"), ("b", "2", False, "added")}
    got = remote.listing(page([[{"path": "p", "id": "9", "name": "p", "type": "blob"}, {"path": "t", "id": "8", "name": "t", "type": "tree"}]]), "gitlab").collect()
    assert {(r.id, r.removed) for r in got} == {("p", False), ("t", True)}
    drop = [{"entries": [{".tag": "file", "path_lower": "/a", "rev": "r", "name": "A"}, {".tag": "deleted", "path_lower": "/b", "name": "B"}]}]
    assert {(r.id, r.removed) for r in remote.listing(page(drop), "dropbox").collect()} == {("/a", False), ("/b", True)}
    drive = [{"value": [{"id": "1", "eTag": "e", "name": "n", "deleted": {"state": "x"}}, {"id": "2", "eTag": "f", "name": "m"}, {"name": "none"}]}]
    assert {(r.id, r.removed) for r in remote.listing(page(drive), "onedrive").collect()} == {("1", True), ("2", False)}
    two = [{"data": [{"gid": "1", "modified_at": "2024-01-01", "name": "old"}]}, {"data": [{"gid": "1", "modified_at": "2024-02-01", "name": "new"}, {"gid": "2", "modified_at": "2023-01-01"}]}]
    items = remote.listing(page(two), "asana")
    assert {(r.id, r.name) for r in items.collect()} == {("1", "new"), ("2", None)} and {r.id for r in remote.since(items, "2024-01-15").collect()} == {"1"}
    assert remote.next_token(items, True, "2023-06-01").first().token == "2024-02-01" and remote.next_token(items, False, "2023-06-01").first().token == "2023-06-01"
    assert {r.id for r in remote.newest_first(items, "2023-06-01", 1).collect()} == {"1"}
    for name in remote.SERVICES:
        assert remote.listing(page([{}]), name).count() == 0


def test_days(spark):
    rows = [("c", "2024-01-01 23:00:00", None, "a"), ("c", "2024-01-02 01:00:00", "2024-01-01 23:00:00", "reply"), ("c", "2024-01-02 02:00:00", None, "b"), ("c", None, None, "timeless")]
    df = spark.createDataFrame(rows, "channel string, ts string, thread string, text string").selectExpr("channel", "cast(ts as timestamp) ts", "cast(thread as timestamp) thread", "text")
    assert {(r.id, r.n, r.text) for r in remote.days(df, thread="thread").collect()} == {("c/2024-01-01", 2, "a\nreply"), ("c/2024-01-02", 1, "b")}
    assert remote.days(df, thread="thread", today="2024-03-03").count() == 3
