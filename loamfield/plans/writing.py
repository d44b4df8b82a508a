"""Queries about sources, parsers, chunkers and ingestion, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamfield.functions import text as tx
from loamfield.operators import chunking, governance, ingest, semantic
from loamfield.plans.catalogue import _SECTIONS, _sections
from loamfield.plans.registry import query
from loamfield.session import spread, table
from loamfield.sources import delta, feeds, parsers, remote, web
from loamfield.staging import fresh_dir

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_md5 = lambda c: F.md5(F.col(c).cast("binary"))


# ---- parsers -------------------------------------------------------------------------------------------------------
@query("SELECT doc_id || '.txt' AS id, 0 AS place, md5(text) AS h FROM documents WHERE regexp_matches(text, '\\S')")
def text_sections(spark, d):
    f = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("id"), F.col("text").cast("binary").alias("content"))
    return parsers.sections(f).select("id", "place", F.md5(F.col("text").cast("binary")).alias("h"))


_MD = """l AS (SELECT doc_id, i, CASE WHEN length(x) % 9 IN (1, 2) AND regexp_matches(x, '^\\S') THEN length(x) % 9 END AS level, x FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL))"""


@query(f"""WITH {_MD}, s AS (SELECT *, sum((level IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l),
g AS (SELECT doc_id, part, max(level) AS level, max(CASE WHEN level IS NOT NULL THEN {_TRIM.format('x')} END) AS heading, {_TRIM.format("string_agg(CASE WHEN level IS NOT NULL THEN repeat('#', level::INT) || ' ' || x ELSE x END, chr(10) ORDER BY i)")} AS t FROM s GROUP BY ALL)
SELECT doc_id || '.md' AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INTEGER AS place, level::INTEGER AS level, md5(coalesce(heading, '')) AS heading, md5(t) AS h FROM g WHERE t <> ''""")
def markdown_sections(spark, d):
    ln = table(spark, d, "documents").filter("text is not null")
    marked = F.transform(F.split("text", "\n"), lambda x: F.when((F.length(x) % 9).isin(1, 2) & F.rlike(x, F.lit(r"^\S")), F.concat(F.expr("repeat('#', 1)"), F.when(F.length(x) % 9 == 2, "#").otherwise(""), F.lit(" "), x)).otherwise(x))
    f = ln.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("id"), F.array_join(marked, "\n").cast("binary").alias("content"))
    return parsers.sections(f).select("id", "place", "level", F.md5(F.coalesce("heading", F.lit("")).cast("binary")).alias("heading"), F.md5(F.col("text").cast("binary")).alias("h"))


@query("SELECT 'c' || c_nationkey || '.json' AS id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS place, c_custkey AS k, c_name AS name FROM customer")
def json_sections(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))))).alias("j"))
    s = parsers.sections(c.select(F.concat(F.lit("c"), "c_nationkey", F.lit(".json")).alias("id"), F.col("j").cast("binary").alias("content")))
    return s.select("id", "place", F.get_json_object("text", "$.k").cast("long").alias("k"), F.get_json_object("text", "$.name").alias("name"))


def _csv(spark, d, head: str, *cells):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", F.concat_ws(",", *cells).alias("x")))).alias("x"))
    body = F.concat(F.lit(head + "\n"), F.array_join(F.transform("x", lambda r: r["x"]), "\n"))
    return c.select(F.concat(F.lit("c"), "c_nationkey").alias("id"), body.cast("binary").alias("content"))


@query("SELECT 'c' || c_nationkey AS id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS place, 'key: ' || c_custkey || ' | name: ' || c_name || ' | left: ' AS text FROM customer")
def csv_rows(spark, d):
    f = _csv(spark, d, "key, name ,left", F.col("c_custkey").cast("string"), F.concat(F.lit(" "), "c_name"))
    return parsers.sections(f.withColumn("content_type", F.lit("text/csv"))).select("id", "place", "text")


@query("SELECT 'c' || c_nationkey AS id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS place, c_name AS text, c_mktsegment AS answer FROM customer WHERE c_custkey % 5 > 0")
def qa_pairs(spark, d):
    f = _csv(spark, d, "Prompt,n,Response", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise(F.lit(" ")), F.col("c_custkey").cast("string"), "c_mktsegment")
    s = parsers.sections(f.withColumn("content_type", F.lit("text/x-qa")), {"text/x-qa": parsers.qa_csv})
    return chunking.pairs(s.select(F.col("id").alias("doc"), "place", "heading", "text")).select(F.col("doc").alias("id"), F.col("part").alias("place"), "text", "answer")


@query()
def html_sections(spark, d):
    f = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").cast("binary").alias("content"), F.lit("text/html").alias("content_type"))
    return parsers.sections(f)


@query("""SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS name FROM (SELECT page_id, trim(trim(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ' ')[1:128], ' ') AS s FROM pages)""")
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN doc_id END AS v FROM documents")
def reply_json(spark, d):
    n = F.col("doc_id") % 3
    reply = F.when(n == 0, F.concat(F.lit('Here you are:\n```json\n{"v": '), "n_chars", F.lit(', "t": "} ["}\n```\nand [1]'))).when(n == 1, F.concat(F.lit('So {"v": '), "doc_id", F.lit(', "more": [1, 2, 3]} or [2]'))).otherwise(F.lit("nothing {here"))
    rows = table(spark, d, "documents").select("doc_id", reply.alias("reply"))

    def run(batches):
        for b in batches:
            b["v"] = [x.get("v") if isinstance(x := parsers.reply_json(r), dict) else None for r in b["reply"]]
            yield b[["doc_id", "v"]].astype({"v": "Int64"})

    return rows.mapInPandas(run, "doc_id long, v long")


@query()
def local_files(spark, d):
    return web.files(spark, d, [".parquet"]).select("path", "etag", "length")


# ---- web -----------------------------------------------------------------------------------------------------------
@query()
def crawl_pages(spark, d):
    pages = table(spark, d, "pages")
    start = pages.orderBy("page_id").first()["url"]
    return feeds.crawl(pages, start)


@query("SELECT 'https://x.org/' || (n_regionkey * 2)::VARCHAR || '/' || n_name AS url, '2024-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS lastmod FROM nation WHERE n_regionkey < 4 AND n_name NOT LIKE '%A'")
def sitemap_pages(spark, d):
    n = table(spark, d, "nation")
    loc = F.concat(F.lit("<url><loc> https://x.org/"), (F.col("n_regionkey") * 2).cast("string"), F.lit("/"), "n_name", F.lit("</loc><lastmod>2024-01-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    maps = n.groupBy("n_regionkey").agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("content"))
    maps = maps.select(F.concat(F.lit("https://x.org/map"), F.col("n_regionkey").cast("string")).alias("url"), "content")
    index = maps.filter("right(url, 1) < '4'").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("content"))
    return feeds.sitemap_urls(maps.unionByName(index.select(F.lit("https://x.org/root").alias("url"), "content")), "https://x.org/root", "HTTPS://X.ORG/", ["A$"])


@query("SELECT 'r' || n_regionkey AS feed, CASE WHEN n_nationkey % 2 = 0 THEN 'g' || n_nationkey ELSE 'https://x.org/' || n_nationkey END AS id, n_name AS title, 'https://x.org/' || n_nationkey AS url FROM nation")
def feed_entries(spark, d):
    n = table(spark, d, "nation")
    key = F.col("n_nationkey").cast("string")
    item = F.concat(F.lit("<item><title>"), "n_name", F.lit("</title><link>https://x.org/"), key, F.lit("</link>"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<guid>g"), key, F.lit("</guid>"))).otherwise(""), F.lit("</item>"))
    f = n.groupBy("n_regionkey").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("content"))
    return feeds.feed_entries(f.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("feed"), "content")).select("feed", "id", "title", "url")


# ---- services ------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey::VARCHAR AS id, o_orderdate::DATE::VARCHAR AS etag, o_orderpriority AS name, o_orderstatus = 'F' AS removed FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01'")
def remote_listing(spark, d):
    item = F.struct(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("updated_at"), F.col("o_orderpriority").alias("subject"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("open").alias("status"))
    pages = table(spark, d, "orders").groupBy(F.expr("o_orderkey div 100").alias("p")).agg(F.to_json(F.struct(F.collect_list(item).alias("tickets"))).alias("body"))
    return remote.since(remote.listing(pages, "zendesk_tickets"), "1995-06-01").select("id", "etag", "name", "removed")


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN 'v2' ELSE 'v1' END AS etag, lang AS name, doc_id % 7 = 0 AS gone FROM documents")
def delta_polls(spark, d):
    """Two polls of a service whose answers Spark lays out from ``documents``: all of them, then what changed or went."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("name"), F.expr("doc_id div 500").alias("p"), (F.col("doc_id") % 5 == 0).alias("newer"), (F.col("doc_id") % 7 == 0).alias("lost"))

    def answers(items, since, token):
        page = items.groupBy("p").agg(F.to_json(F.collect_list("item")).alias("value")).withColumn("after", F.lead("p").over(Window.orderBy("p")))  # a row a page
        follows = F.when(F.col("after").isNull(), F.lit(f'"@odata.deltaLink":"{token}"')).otherwise(F.concat(F.lit('"@odata.nextLink":"p'), F.col("after").cast("string"), F.lit('"')))
        first = F.row_number().over(Window.orderBy("p")) == 1
        return page.select(F.lit(since).alias("since"), F.when(first, "").otherwise(F.concat(F.lit("p"), F.col("p").cast("string"))).alias("page"), F.concat(F.lit('{"value":'), "value", F.lit(","), follows, F.lit("}")).alias("body"))

    at, where = fresh_dir(spark, "polls"), fresh_dir(spark, "answers")
    item = lambda tag: F.struct("id", F.lit(tag).alias("eTag"), "name")
    delta.put_answers(answers(docs.withColumn("item", item("v1")), "", "t1"), where)
    delta.poll(spark, at, "onedrive", answers=where)
    lost = F.struct("id", F.struct(F.lit("deleted").alias("state")).alias("deleted"))
    told = docs.filter("newer or lost").withColumn("item", F.when(F.col("lost"), F.to_json(lost)).otherwise(F.to_json(item("v2"))))
    delta.put_answers(answers(told.withColumn("item", F.from_json("item", "id string, eTag string, name string, deleted struct<state: string>")), "t1", "t2"), where)
    delta.poll(spark, at, "onedrive", answers=where)
    return delta.polled_items(spark, at).select("id", "etag", "name", "gone")


@query("SELECT event_type || '/' || strftime(ts, '%Y-%m-%d') AS id, count(*) AS n FROM events GROUP BY ALL")
def channel_days(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("channel"), "ts", F.col("props").alias("text"))
    return remote.days(e).select("id", "n")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE 'd' || doc_id END AS document_id,
CASE WHEN doc_id % 5 = 0 THEN 'not an object' WHEN doc_id % 5 = 1 THEN 'no document_id' WHEN doc_id % 5 = 2 THEN 'no content' END AS error FROM documents""")
def webhook_jobs(spark, d):
    n = F.col("doc_id") % 5
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    body = F.when(n == 0, F.lit("[1]")).when(n == 1, F.to_json(F.struct(F.lit("").alias("document_id"), F.lit("x").alias("content")))).when(n == 2, F.to_json(F.struct(name.alias("document_id"))))
    body = body.when(n == 3, F.to_json(F.struct(name.alias("document_id"), F.lit("eHk=").alias("content_base64")))).otherwise(F.to_json(F.struct(name.alias("document_id"), F.lit("xy").alias("content"))))
    return feeds.jobs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), body.alias("body"))).select("id", "document_id", "error")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'complete' WHEN event_type = 'view' THEN 'leave' WHEN event_type = 'error' AND (s IN (408, 429) OR s >= 500) THEN 'abandon' WHEN event_type = 'error' THEN 'dead_letter' ELSE 'abandon' END AS action
FROM (SELECT *, 400 + event_id % 150 AS s FROM events)""")
def settle_policy(spark, d):
    kind = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "view", "shutdown").when(F.col("event_type") == "error", "http").otherwise("storage")
    e = table(spark, d, "events").select("event_id", kind.alias("kind"), (400 + F.col("event_id") % 150).alias("http_status"))
    return feeds.settle(e).select("event_id", "action")


# ---- chunkers ------------------------------------------------------------------------------------------------------
def _embed(texts):
    """Counts of letters: what stands in for a model here."""
    return [[float(t.lower().count(c)) for c in "aeiounrst"] for t in texts]


@query()
def semantic_chunks(spark, d):
    return semantic.semantic_chunks(table(spark, d, "documents"), _embed)


_LETTERS = "aeiounrst"
_PARTS = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\.\\s+|[!?]\\s+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_GROUP = "STRUCT(a BIGINT, b BIGINT, size BIGINT)"
_VECTOR = "[" + ", ".join(f"length(t) - length(translate(t, '{c}{c.upper()}', ''))" for c in _LETTERS) + "]::DOUBLE[]"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_PARTS} AS p FROM documents), v AS (SELECT *, {_VECTOR} AS v FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM d)),
k AS (SELECT doc_id, i, length(t) AS l, v, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM v),
n AS (SELECT doc_id, i, l, u IS NULL AS lead, CASE WHEN u IS NULL THEN NULL WHEN list_dot_product(u, u) * list_dot_product(v, v) > 0 THEN list_dot_product(u, v) / sqrt(list_dot_product(u, u) * list_dot_product(v, v)) ELSE 0 END AS near FROM k),
b AS (SELECT doc_id, list_sort(list(near) FILTER (WHERE NOT lead))[(least(floor(0.25 * (count(*) - 1)), count(*) - 2) + 1)::BIGINT] AS bound FROM n GROUP BY doc_id),
g AS (SELECT doc_id, i, l, sum((lead OR near < bound)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS gid FROM n JOIN b USING (doc_id)),
s AS (SELECT doc_id, gid, min(i) - 1 AS a, max(i) AS b, sum(l) + count(*) - 1 AS size FROM g GROUP BY doc_id, gid),
m AS (SELECT doc_id, list({{a: a, b: b, size: size}}::{_GROUP} ORDER BY gid) AS gs, 1 AS i, []::{_GROUP}[] AS done, NULL::{_GROUP} AS wait FROM s GROUP BY doc_id
UNION ALL SELECT doc_id, gs, i + 1, CASE WHEN cur.size < 100 AND back THEN list_append(done[1:len(done) - 1], {{a: done[-1].a, b: cur.b, size: done[-1].size + cur.size + 1}}::{_GROUP}) WHEN cur.size >= 100 OR nxt IS NULL THEN list_append(done, cur) ELSE done END,
CASE WHEN cur.size >= 100 OR back OR nxt IS NULL THEN NULL ELSE cur END
FROM (SELECT *, len(done) > 0 AND (nxt IS NULL OR done[-1].size <= nxt.size) AS back FROM (SELECT *, gs[i + 1] AS nxt, CASE WHEN wait IS NULL THEN gs[i] ELSE {{a: wait.a, b: gs[i].b, size: wait.size + gs[i].size + 1}}::{_GROUP} END AS cur FROM m WHERE i <= len(gs)))),
z AS (SELECT doc_id, unnest(done) AS g FROM m WHERE i = len(gs) + 1), ls AS (SELECT doc_id, list(l ORDER BY i) AS ls FROM n GROUP BY doc_id),
q AS (SELECT doc_id, g.a AS a, g.b AS b, ls, g.a + 1 AS j, [g.a] AS starts, ls[g.a + 1] AS held FROM z JOIN ls USING (doc_id) WHERE g.size > 1500
UNION ALL SELECT doc_id, a, b, ls, j + 1, CASE WHEN held + 1 + ls[j + 1] > 1500 THEN list_append(starts, j) ELSE starts END, CASE WHEN held + 1 + ls[j + 1] > 1500 THEN ls[j + 1] ELSE held + 1 + ls[j + 1] END FROM q WHERE j < b),
c AS (SELECT doc_id, unnest(starts) AS first FROM q WHERE j = b UNION ALL SELECT doc_id, g.a FROM z WHERE g.size <= 1500),
e AS (SELECT doc_id, first, lead(first) OVER w AS nxt, row_number() OVER w - 1 AS k FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY first))
SELECT doc_id, k::INTEGER AS chunk_index, first::INTEGER AS first, (coalesce(nxt, len(p)) - first)::INTEGER AS n_sentences, md5(array_to_string(p[first + 1:coalesce(nxt, len(p))], ' ')) AS h FROM e JOIN d USING (doc_id)""")
def meaning_chunks(spark, d):
    """Sentences grouped by counts of letters, which stand in for a model here and are had by expressions, too."""
    without = lambda t, c: F.replace(F.replace(t, F.lit(c)), F.lit(c.upper()))
    count = lambda t: F.array(*[(F.length(t) - F.length(without(t, c))).cast("double") for c in _LETTERS])
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("vectors", F.transform(semantic.sentences(F.col("text")), count))
    return semantic.meaning_chunks(docs).select("doc_id", "chunk_index", "first", "n_sentences", F.md5(F.col("text").cast("binary")).alias("h"))


@query()
def token_chunks(spark, d):
    import public_tokenizers

    return semantic.token_chunks(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 256, 32)


@query("""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS w, regexp_extract_all(text, '(\\s*)\\S+', 1) AS g FROM conversations),
o AS (SELECT conv_id, turn, list(a ORDER BY i) AS a, list(b ORDER BY i) AS b FROM (SELECT conv_id, turn, i, sum(gl + wl) OVER k AS b, sum(gl + wl) OVER k - wl AS a FROM
(SELECT conv_id, turn, generate_subscripts(w, 1) AS i, length(unnest(w)) AS wl, length(unnest(g)) AS gl FROM t) WINDOW k AS (PARTITION BY conv_id, turn ORDER BY i)) GROUP BY ALL)
SELECT conv_id, turn, a[s + 1]::INTEGER AS start_pos, b[least(s + 16, len(b))]::INTEGER AS end_pos FROM (SELECT *, unnest(range(0, len(a), 12)) AS s FROM o) WHERE s = 0 OR s + 4 < len(a)""")
def word_windows(spark, d):
    # outer, as else a filter on the windows' number is inferred that computes all of them a second time
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode_outer(semantic.word_windows(F.col("text"), 16, 4)).alias("x"))
    return t.filter("x is not null").select("conv_id", "turn", "x.*")


def _kinds(spark, d):
    """Lines of documents as sections; the first words of some stand for headings that templates know."""
    n = (F.col("place") + F.col("doc")) % 11
    head = F.when(n == 2, "Abstract").when(n == 5, " References ").when(n == 7, "INDEX").when(n == 8, "Preface").otherwise(F.col("heading"))
    return _sections(spark, d).withColumn("heading", F.when(F.col("level").isNotNull() | n.isin(2, 5, 7, 8), head))


_KINDS = f"{_SECTIONS}, k AS (SELECT doc, place, text, level, CASE (place + doc) % 11 WHEN 2 THEN 'Abstract' WHEN 5 THEN ' References ' WHEN 7 THEN 'INDEX' WHEN 8 THEN 'Preface' ELSE heading END AS heading FROM s)"


def _merge_sql(src: str, depth: int = 2) -> str:
    return f"""r AS (SELECT *, coalesce(level <= {depth}, false) AS o, sum(coalesce(level <= {depth}, false)::INT) OVER (PARTITION BY doc ORDER BY place) AS part FROM {src}),
m AS (SELECT doc, part::BIGINT AS part, max(heading) FILTER (WHERE o) AS heading, max(level) FILTER (WHERE o) AS level, coalesce(nullif(max(heading) FILTER (WHERE o), '') || chr(10) || chr(10), '')
|| {_TRIM.format("coalesce(string_agg(" + _TRIM.format('text') + ", chr(10) ORDER BY place) FILTER (WHERE NOT o), '')")} AS body FROM r GROUP BY doc, part)"""


@query(f"""WITH {_KINDS}, f AS (SELECT doc, min(place) AS ab FROM k WHERE lower(trim(heading)) = 'abstract' GROUP BY doc),
b AS (SELECT k.* FROM k LEFT JOIN f USING (doc) WHERE (ab IS NULL OR place > ab) AND coalesce(lower(trim(heading)) NOT IN ('references', 'bibliography', 'works cited'), true)), {_merge_sql('b')}
SELECT doc, part + 1 AS part, 'body' AS kind, md5(body) AS body FROM m WHERE body <> '' UNION ALL SELECT doc, 0, 'abstract', md5(text) FROM k JOIN f USING (doc) WHERE place = ab""")
def paper_chunks(spark, d):
    return chunking.paper(_kinds(spark, d)).select("doc", "part", "kind", _md5("text").alias("body"))


@query(f"""WITH {_KINDS}, b AS (SELECT * FROM k WHERE coalesce(lower(trim(heading)) NOT IN ('index', 'foreword', 'preface', 'introduction', 'contents', 'table of contents'), true)
AND NOT coalesce(len(list_filter(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: regexp_matches(x, '\\s+\\d+\\s*$'))) > 0.5 * len(list_filter(string_split(text, chr(10)), lambda x: x <> '')), false)), {_merge_sql('b')}
SELECT doc, part, level::INTEGER AS level, md5(body) AS body, last_value(CASE WHEN level = 1 THEN heading END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY part ROWS UNBOUNDED PRECEDING) AS chapter FROM m WHERE body <> ''""")
def book_chunks(spark, d):
    return chunking.book(_kinds(spark, d), index=False, foreword=False).select("doc", "part", F.col("level").cast("int").alias("level"), "chapter", _md5("text").alias("body"))


_CLAUSE = "CASE place % 6 WHEN 1 THEN '1. ' || text WHEN 3 THEN '1.2 ' || text WHEN 4 THEN '1.2.3 ' || text ELSE text END"


@query(f"""WITH {_SECTIONS}, k AS (SELECT doc, place, {_CLAUSE} AS text, CASE WHEN regexp_matches({_CLAUSE}, '(?m)^\\d+\\.\\s') THEN 1 WHEN regexp_matches({_CLAUSE}, '(?m)^\\d+\\.\\d+\\s') THEN 2 WHEN regexp_matches({_CLAUSE}, '(?m)^\\d+\\.\\d+\\.\\d+\\s') THEN 3 END AS level FROM s),
h AS (SELECT *, CASE WHEN level IS NOT NULL THEN {_TRIM.format("regexp_replace(text, '^#{1,6}\\s+', '')")} END AS heading FROM k), {_merge_sql('h', 3)} SELECT doc, part, md5(coalesce(heading, '')) AS clause, md5(body) AS body FROM m WHERE body <> ''""")
def legal_clauses(spark, d):
    n = F.col("place") % 6
    t = F.when(n == 1, F.concat(F.lit("1. "), "text")).when(n == 3, F.concat(F.lit("1.2 "), "text")).when(n == 4, F.concat(F.lit("1.2.3 "), "text")).otherwise(F.col("text"))
    s = _sections(spark, d).select("doc", "place", t.alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("heading"))
    return chunking.clauses(s).select("doc", "part", _md5("clause").alias("clause"), _md5("text").alias("body"))


@query("SELECT conv_id AS doc, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS part, CASE WHEN role = 'system' THEN 'headers' WHEN turn % 5 = 4 THEN 'attachment:a' ELSE 'body' END AS kind FROM conversations WHERE role = 'system' OR turn % 5 <> 4")
def email_parts(spark, d):
    head = F.when(F.col("role") == "system", "headers").when(F.col("turn") % 5 == 4, "attachment:a")
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("place"), head.alias("heading"), "text")
    return chunking.mail_parts(s, attachments=False).select("doc", F.col("part").cast("long").alias("part"), "kind")


# ---- ingestion -----------------------------------------------------------------------------------------------------
@query("SELECT d.doc_id, count(x) AS n_chunks FROM documents d LEFT JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) c ON c.doc_id = d.doc_id AND regexp_matches(x, '\\S') GROUP BY d.doc_id")
def chunk_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text")).filter(F.rlike("text", F.lit(r"\S")))
    return ingest.counted(docs, chunks)


@query("SELECT DISTINCT key, value FROM (SELECT 'lang' AS key, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE value IS NOT NULL")
def tag_index(spark, d):
    tags = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return ingest.tag_values(table(spark, d, "documents").select(tags.alias("tags")))


@query("SELECT conv_id || ':' || turn AS key FROM conversations WHERE conv_id % 3 <> 0")
def parent_store_delete(spark, d):
    t = table(spark, d, "conversations")
    keyed = t.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"))
    return ingest.drop_prefixed(keyed, t.filter("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("doc_id")))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 'document_id' WHEN text IS NULL THEN 'content' WHEN doc_id % 6 = 1 THEN 'max_chunk' ELSE 'overlap' END AS fault FROM documents
WHERE doc_id % 6 IN (0, 1, 2) OR text IS NULL""")
def request_faults(spark, d):
    n = F.col("doc_id") % 6
    r = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(n == 0, " ").otherwise("x").alias("document_id"), F.col("text").alias("content"), F.when(n == 1, 0).otherwise(512).alias("max_chunk"), F.when(n == 2, 512).otherwise(50).alias("overlap"))
    return governance.ingest_faults(r)


@query("SELECT event_id, md5(json_object('kind', event_type, 'at', json_object('$date', strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z'), 'n', user_id)::VARCHAR) AS h, user_id AS n, epoch_us(ts) // 1000 AS ms FROM events")
def metadata_json(spark, d):
    j = governance.metadata_json({"kind": F.col("event_type"), "at": F.col("ts"), "n": F.col("user_id")}, {"at": "date"})
    e = table(spark, d, "events").select("event_id", j.alias("j"))
    return e.select("event_id", _md5("j").alias("h"), governance.metadata_value(F.col("j"), "n", "long").alias("n"), F.unix_millis(governance.metadata_value(F.col("j"), "at", "date")).alias("ms"))
