"""Feeds, site maps, crawls, web hooks and evaluation files as tables."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamfield.sources.web import LINK, bare_url, href
from loamfield.staging import staged

# ---- feeds and site maps -------------------------------------------------------------------------------------------
_local = lambda x: x.tag.rsplit("}", 1)[-1]
ENTRIES = "feed string, id string, title string, url string, author string, published_at string, text string"


def _entry(x) -> tuple:
    first = lambda *names: next((t for n in names for c in x if _local(c) == n and (t := (c.text or "").strip())), None)
    link = first("link") or next((c.get("href") for c in x if _local(c) == "link" and c.get("href") and c.get("rel", "alternate") == "alternate"), None)
    author = first("author", "creator") or next((t for c in x if _local(c) == "author" for n in c if _local(n) == "name" and (t := (n.text or "").strip())), None)
    return first("guid", "id") or link, first("title"), link, author, first("pubDate", "published", "updated"), first("encoded", "content", "description", "summary")


def feed_entries(feeds: DataFrame) -> DataFrame:
    """``feed, id, title, url, author, published_at, text`` of RSS and Atom feeds (feed, content). The id is the guid or id,
    else the link; entries with neither are left out, and so are feeds that aren't XML."""

    def run(batches):
        for b in batches:
            rows = []
            for feed, content in zip(b["feed"], b["content"], strict=True):
                try:
                    root = ElementTree.fromstring(content or "")
                except ElementTree.ParseError:
                    continue
                rows += [(feed, *got) for x in root.iter() if _local(x) in ("item", "entry") and (got := _entry(x))[0]]
            yield pd.DataFrame(rows, columns=["feed", "id", "title", "url", "author", "published_at", "text"], dtype=object)

    return feeds.select("feed", F.col("content").cast("string").alias("content")).mapInPandas(run, ENTRIES)


def sitemap_urls(maps: DataFrame, root: str, prefix: str | None = None, excluded: list[str] | None = None, nested: bool = False, depth: int = 5) -> DataFrame:
    """``url, lastmod`` of the pages that the site map ``root`` lists, through indexes of maps (``maps``: url, content).

    ``prefix`` (without case) and ``excluded`` (patterns) sift pages, and nested maps too if ``nested``. A map is read once.
    """

    def run(batches):
        for b in batches:
            rows = []
            for at, content in zip(b["url"], b["content"], strict=True):
                try:
                    top = ElementTree.fromstring(content or "")
                except ElementTree.ParseError:
                    continue
                for x in top:
                    got = {_local(c): (c.text or "").strip() for c in x}
                    if got.get("loc"):
                        rows.append((at, _local(top) == "sitemapindex", got["loc"], got.get("lastmod")))
            yield pd.DataFrame(rows, columns=["at", "map", "url", "lastmod"], dtype=object).astype({"map": bool})

    links = staged(maps.select("url", F.col("content").cast("string").alias("content")).mapInPandas(run, "at string, map boolean, url string, lastmod string"), "sitemap")
    ok = F.lit(True) if prefix is None else F.lower("url").startswith(prefix.lower())
    for p in excluded or []:
        ok = ok & ~F.rlike("url", F.lit(p))
    inner = links.filter("map").filter(ok if nested else F.lit(True))
    seen = front = maps.sparkSession.createDataFrame([(root,)], "at string")
    for _ in range(depth):
        front = staged(front.join(inner, "at").select(F.col("url").alias("at")).distinct().join(seen, "at", "left_anti"), "sitemap-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return links.filter(~F.col("map")).filter(ok).join(seen, "at", "left_semi").select("url", "lastmod").distinct()


# ---- crawl ---------------------------------------------------------------------------------------------------------
def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def absolute(base: Column, link: Column) -> Column:
    """A link as the page at ``base`` means it; null for what isn't http."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//", 1)
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<!/)/[^/]*$", "")
    full = (
        F.when(F.rlike(link, F.lit("^(?i)https?://")), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(site, link))
        .when(F.rlike(link, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")) | (link == "") | link.startswith("#"), F.lit(None)).otherwise(F.concat(folder, F.lit("/"), link))
    )
    return bare_url(full)


def crawl(pages: DataFrame, start: str, depth: int = 3, most: int = 200, rules: list[str] | None = None) -> DataFrame:
    """``url, depth, place`` of the pages that a breadth-first walk from ``start`` meets on its own host, up to ``most``.

    ``pages``: url, html (whatever was fetched). ``rules``: path prefixes that robots may not visit. Pages of one depth are
    visited in the order of their addresses. The limit is the walk's own feature.
    """
    html = pages.select(bare_url(F.col("url")).alias("at"), "html")
    got = html.select("at", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("tag"))
    link = href(F.col("tag"))
    edges = got.select("at", absolute(F.col("at"), link).alias("url")).filter("url is not null").distinct()
    edges = edges.filter(host(F.col("url")) == host(F.col("at")))
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    for r in rules or []:
        edges = edges.filter(~path.startswith(r)) if r else edges
    edges = staged(edges, "crawl-edges")
    spark = pages.sparkSession
    seen = front = spark.createDataFrame([(start.split("#")[0].rstrip("/"), 0)], "url string, depth int")
    for d in range(1, depth + 1):
        front = edges.join(front.select(F.col("url").alias("at")), "at", "left_semi").select("url").distinct()
        front = staged(front.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)).orderBy("url").limit(most), "crawl-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    w = Window.orderBy("depth", "url")  # at most ``most`` rows a depth
    return seen.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def robots(text: str | None) -> list[str]:
    """Path prefixes that a robots file forbids to all agents."""
    out, mine = [], False
    for line in (text or "").splitlines():
        key, _, value = line.split("#")[0].partition(":")
        if key.strip().lower() == "user-agent":
            mine = value.strip() == "*"
        elif mine and key.strip().lower() == "disallow" and value.strip():
            out.append(value.strip())
    return out


# ---- messages ------------------------------------------------------------------------------------------------------
def jobs(messages: DataFrame) -> DataFrame:
    """Ingestion jobs from JSON messages (id, body): ``id, document_id, content, file_name, tags, error``.

    A body must be an object with a document_id and either content or content_base64; ``error`` says what it lacks.
    """
    shape = "document_id string, content string, content_base64 string, file_name string, tags map<string,string>"
    m = messages.withColumn("m", F.from_json("body", shape))
    content = F.coalesce("m.content", F.expr("cast(try_to_binary(m.content_base64, 'base64') as string)"))
    error = F.when(F.col("m").isNull() | ~F.rlike(F.trim("body"), F.lit(r"^\{")), "not an object").when(F.trim(F.coalesce("m.document_id", F.lit(""))) == "", "no document_id").when(content.isNull(), "no content")
    return m.select("id", "m.document_id", content.alias("content"), F.coalesce("m.file_name", "m.document_id").alias("file_name"), "m.tags", error.alias("error"))


# Status codes after which a message is tried again.
RETRIED = (408, 429)


def settle(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (kind, http_status) with ``action``: complete, dead_letter, abandon (delivered again) or leave."""
    http = F.col("http_status")
    again = http.isin(*RETRIED) | (http >= 500)
    action = (
        F.when(F.col("kind") == "success", "complete").when(F.col("kind") == "shutdown", "leave").when(F.col("kind").isin("malformed", "validation", "no_parser", "unreadable"), "dead_letter")
        .when((F.col("kind") == "http") & ~again, "dead_letter").otherwise("abandon")
    )
    return outcomes.withColumn("action", action)


# ---- evaluation files ----------------------------------------------------------------------------------------------
def beir(spark: SparkSession, folder: str, split: str = "test", sep: str = " ") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus: id, title, text, body; queries: id, text; judgements: query, doc, grade) of a data set's folder.

    Malformed lines, a wrong header and empty files are errors; of repeated judgements the last in the file counts. ``body``
    is title and text, trimmed.
    """
    read = lambda name, extra: spark.read.schema(f"_id string, text string{extra}").option("mode", "FAILFAST").json(f"{folder}/{name}.jsonl")
    corpus, queries = read("corpus", ", title string"), read("queries", "")
    lines = spark.read.text(f"{folder}/qrels/{split}.tsv").withColumn("at", F.monotonically_increasing_id())
    head = lines.orderBy("at").limit(1).collect()
    if not head or head[0]["value"].rstrip("\r") != "query-id\tcorpus-id\tscore":
        raise ValueError("judgements need the header query-id, corpus-id, score")
    cells = lines.filter(F.col("at") != head[0]["at"]).filter(F.trim("value") != "").select("at", F.split(F.rtrim("value"), "\t").alias("c"))
    if not cells.filter("size(c) <> 3 or not c[2] rlike '^-?[0-9]+$'").isEmpty():
        raise ValueError("a line of the judgements is malformed")
    rows = cells.select("at", F.col("c")[0].alias("query"), F.col("c")[1].alias("doc"), F.col("c")[2].cast("int").alias("grade"))
    qrels = rows.groupBy("query", "doc").agg(F.max_by("grade", "at").alias("grade"))
    for name, df in (("corpus", corpus), ("queries", queries), ("judgements", qrels)):
        if df.isEmpty():
            raise ValueError(f"{name}: empty")
    title = F.trim(F.coalesce("title", F.lit("")))
    body = F.trim(F.concat(title, F.lit(sep), F.coalesce("text", F.lit(""))))
    return corpus.select(F.col("_id").alias("id"), "title", "text", body.alias("body")), queries.select(F.col("_id").alias("id"), "text"), qrels


#: Stands in a run for a query without hits.
NO_HIT = "__none__"


def trec_lines(hits: DataFrame, tag: str, queries: DataFrame | None = None) -> DataFrame:
    """``query, rank, line``: six fields of each hit (query, doc, score, rank), in the order of queries as text and rank; a
    query of ``queries`` without hits has a line for a document that doesn't exist."""
    if not tag or any(c.isspace() for c in tag):
        raise ValueError("a tag is one word")
    rows = hits.select(F.col("query").cast("string").alias("query"), F.col("doc").cast("string").alias("doc"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"))
    if queries is not None:
        none = queries.select(F.col("query").cast("string").alias("query")).distinct().join(rows.select("query"), "query", "left_anti")
        rows = rows.unionByName(none.select("query", F.lit(NO_HIT).alias("doc"), F.lit(1).alias("rank"), F.lit(0.0).alias("score")))
    return rows.select("query", "rank", F.concat_ws(" ", "query", F.lit("Q0"), "doc", "rank", F.col("score").cast("string"), F.lit(tag)).alias("line"))


def trec_faults(lines: DataFrame) -> DataFrame:
    """``query, rank, fault`` of the lines (line) of a run that break its rules: six fields, ranks from 1 on without gaps,
    scores that don't rise, documents once a query, one tag."""
    c = lines.select(F.split("line", " ").alias("c"))
    bad = c.filter(F.size("c") != 6).select(F.col("c")[0].alias("query"), F.lit(None).cast("int").alias("rank"), F.lit("fields").alias("fault"))
    r = c.filter(F.size("c") == 6).select(F.col("c")[0].alias("query"), F.col("c")[2].alias("doc"), F.col("c")[3].cast("int").alias("rank"), F.col("c")[4].cast("double").alias("score"), F.col("c")[5].alias("tag"))
    by = Window.partitionBy("query").orderBy("rank")
    first = r.agg(F.min("tag").alias("tag_"))
    r = r.withColumns({"place": F.row_number().over(by), "before": F.lag("score").over(by), "same": F.count(F.lit(1)).over(Window.partitionBy("query", "doc"))}).join(F.broadcast(first))  # one row
    fault = F.when(F.col("rank").isNull() | F.col("score").isNull(), "number").when(F.col("rank") != F.col("place"), "rank").when(F.col("score") > F.col("before"), "score").when(F.col("same") > 1, "document").when(F.col("tag") != F.col("tag_"), "tag")
    return r.select("query", "rank", fault.alias("fault")).filter("fault is not null").unionByName(bad)


def trec_read(lines: DataFrame) -> DataFrame:
    """``query, doc, score, rank`` of a run's lines; the document that doesn't exist is left out."""
    c = F.split("line", " ")
    return lines.select(c[0].alias("query"), c[2].alias("doc"), c[4].cast("double").alias("score"), c[3].cast("int").alias("rank")).filter(F.col("doc") != NO_HIT)


def multihop(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries: id, query, answer, question_type; judgements: id, url) of questions (place, query, answer, question_type,
    evidence_list<url>): ids count questions from 0 in the order of ``place``; each distinct url of evidence is one judgement."""
    n = F.row_number().over(Window.orderBy("place")) - 1  # a benchmark's questions
    q = questions.withColumn("id", F.format_string("mhr-%04d", n))
    judged = q.select("id", F.explode("evidence_list").alias("e")).select("id", F.col("e.url").alias("url")).filter("url is not null").distinct()
    return q.select("id", "query", "answer", "question_type"), judged
