"""Queries by name with their SQL. Searches ask for every row whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamfield.functions import text as tx
from loamfield.operators import chunking, graph, ingest, metrics, retrieval, search
from loamfield.plans.registry import ORACLES, QUERIES, query
from loamfield.session import table
from loamfield.sources import web
from loamfield.streaming import deliveries
from loamfield.streaming import events as st


# ---- text ----------------------------------------------------------------------------------------------------------
TOK = rf"regexp_extract_all(lower(coalesce(text, '')), '{tx.TOKEN}')"
_POST = f"""t AS (SELECT doc_id AS doc, {TOK} AS t FROM documents), e AS (SELECT doc, len(t) AS len, unnest(t) AS term FROM t),
tf AS (SELECT doc, term, count(*) AS tf, any_value(len) AS len FROM e GROUP BY ALL)"""
_Q = f"q AS (SELECT item_id AS query, unnest(list_distinct({TOK})) AS term FROM benchmark)"


@query(f"SELECT doc_id, len({TOK})::BIGINT AS n_tokens, len(list_distinct({TOK}))::BIGINT AS n_terms FROM documents")
def tokenize_stats(spark, d):
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query(f"WITH {_POST}, n AS (SELECT count(*) AS n FROM t) SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM tf, n GROUP BY term")
def idf_table(spark, d):
    docs = table(spark, d, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = search.document_counts(docs)
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


_BM25 = f"""bm AS (SELECT query, doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score
FROM q JOIN tf USING (term) JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term), (SELECT count(*) AS n, avg(len(t)) AS al FROM t) GROUP BY query, doc),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 10)"""


def _bench(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


@query(f"WITH {_POST}, {_Q}, {_BM25} SELECT * FROM bm25")
def bm25_topk(spark, d):
    return search.bm25(table(spark, d, "documents"), _bench(spark, d))


_SPARSE = f"""sw AS (SELECT doc, term, ln(1 + tf) AS w FROM tf QUALIFY row_number() OVER (PARTITION BY doc ORDER BY tf DESC, term) <= 256),
qe AS (SELECT item_id AS query, unnest({TOK}) AS term FROM benchmark), qw AS (SELECT query, term, ln(1 + count(*)) AS wq FROM qe GROUP BY ALL),
sp AS (SELECT query, doc, round(sum(w * wq), 6) AS score FROM sw JOIN qw USING (term) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sp QUALIFY rank <= 10)"""


@query(f"WITH {_POST}, {_SPARSE} SELECT * FROM sparse")
def sparse_dot_topk(spark, d):
    return search.sparse(table(spark, d, "documents"), _bench(spark, d))


_RRF = "rrf AS (SELECT query, doc, round(sum(w), 9) AS score FROM (SELECT query, doc, 0.5 / (60 + rank) AS w FROM bm25 UNION ALL SELECT query, doc, 0.5 / (60 + rank) FROM sparse) GROUP BY ALL)"


@query(f"WITH {_POST}, {_Q}, {_BM25}, {_SPARSE}, {_RRF} SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM rrf QUALIFY rank <= 10")
def hybrid_rrf(spark, d):
    docs, q = search.token_table(table(spark, d, "documents")), _bench(spark, d)
    return search.fuse([(search.bm25(docs, q), 0.5), (search.sparse(docs, q), 0.5)])


def flagship(spark, sf_dir: str):
    """Hybrid retrieval: BM25 and sparse vectors, fused by reciprocal ranks."""
    return hybrid_rrf(spark, sf_dir)


@query(f"""WITH {_POST}, {_Q}, {_BM25}, m AS (SELECT query, doc, list_distinct({TOK}) AS ql FROM bm25 JOIN benchmark ON item_id = query)
SELECT query, round(avg(CASE WHEN len(list_intersect(ql, t)) >= 0.3 * len(ql) THEN 1.0 ELSE 0.0 END), 6) AS relevance FROM m JOIN t USING (doc) GROUP BY query""")
def crag_heuristic(spark, d):
    docs, q = table(spark, d, "documents"), _bench(spark, d)
    hits = search.bm25(docs, q).join(q.select("query", F.array_distinct(tx.tokens(F.col("text"))).alias("ql")), "query")
    hits = hits.join(docs.select(F.col("doc_id").alias("doc"), tx.tokens(F.col("text")).alias("t")), "doc")
    return hits.groupBy("query").agg(F.round(F.avg(F.when(F.size(F.array_intersect("ql", "t")) >= 0.3 * F.size("ql"), 1.0).otherwise(0.0)), 6).alias("relevance"))


_N = " + ".join(f"(length(l) - length(replace(l, '{p}', ''))) / {len(p)}" for p in (" and ", " also ", " additionally ", " furthermore ", " as well as "))


@query(f"""SELECT conv_id, turn, CASE WHEN {_N} >= 2 THEN 'multi_hop' WHEN contains(l, 'how') OR contains(l, 'why') OR contains(l, 'compare') OR contains(l, 'difference') OR contains(l, 'explain') THEN 'complex'
WHEN len(regexp_extract_all(text, '\\S+')) <= 6 THEN 'simple' ELSE 'complex' END AS kind FROM (SELECT *, lower(text) AS l FROM conversations)""")
def adaptive_class(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.query_class(F.col("text")).alias("kind"))


# ---- dense ---------------------------------------------------------------------------------------------------------
def _dense_sql(extra="", k=10):
    return f"""c AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 {extra}), dense AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM c QUALIFY rank <= {k})"""


def _dense(spark, d, k=10, **more):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc")
    return search.dense(v, v.filter("doc % 100 = 0").withColumnRenamed("doc", "query"), k, **more)


@query(f"WITH {_dense_sql()} SELECT * FROM dense")
def dense_topk(spark, d):
    return _dense(spark, d)


@query(f"WITH {_dense_sql('AND a.label = b.label')} SELECT * FROM dense")
def dense_filtered(spark, d):
    return _dense(spark, d, match="label")


@query(f"WITH {_dense_sql()} SELECT * FROM dense WHERE score >= 0.3")
def dense_min_score(spark, d):
    return _dense(spark, d, least=0.3)


@query(f"WITH {_dense_sql()} SELECT query, doc, score, rank FROM dense JOIN embeddings ON vec_id = doc WHERE label = 1 AND score >= 0.1")
def post_filter_after_topk(spark, d):
    hits = _dense(spark, d)
    return hits.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label"), "doc").filter("label = 1 and score >= 0.1").select("query", "doc", "score", "rank")


@query(f"WITH {_dense_sql(k=7)}, n AS (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM dense) SELECT query, doc, score, rank, CASE WHEN n <= 2 THEN rank - 1 WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE n - 1 - (rank - 2) // 2 END::INTEGER AS place FROM n")
def lost_in_middle(spark, d):
    return retrieval.lost_in_middle(_dense(spark, d, 7))


def _with_vectors(spark, d, k):
    return _dense(spark, d, k).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding"), "doc")


@query()
def mmr_select(spark, d):
    return retrieval.mmr(_with_vectors(spark, d, 15))


@query()
def redundancy_filter(spark, d):
    return retrieval.drop_redundant(_with_vectors(spark, d, 10), 0.3)


_POOL = f"""{_dense_sql('AND a.vec_id <> b.vec_id', 20)}, pool AS (SELECT d.*, (x.label = y.label)::INT AS grade FROM dense d JOIN embeddings x ON x.vec_id = query JOIN embeddings y ON y.vec_id = doc),
rel AS (SELECT query, count(*) AS relevant FROM pool WHERE grade > 0 GROUP BY query),
ideal AS (SELECT query, relevant, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= relevant) AS ideal FROM rel),
met AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS seen FROM pool WHERE grade > 0 AND rank <= 10),
got AS (SELECT query, sum(1 / log2(rank + 1)) AS dcg, count(*) AS hits, min(rank) AS first, sum(seen / rank) AS ap FROM met GROUP BY query),
ir AS (SELECT query, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(hits / relevant, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(hits / 10, 0), 6) AS precision, round(coalesce(ap / least(10, relevant), 0), 6) AS map FROM ideal LEFT JOIN got USING (query))"""


def _pool(spark, d):
    v = table(spark, d, "embeddings")
    hits = _dense(spark, d, 21).filter("query <> doc")
    from pyspark.sql import Window

    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter("rank <= 20")
    mine = v.select(F.col("vec_id").alias("query"), F.col("label").alias("ql"))
    return hits.join(mine, "query").join(v.select(F.col("vec_id").alias("doc"), "label"), "doc").withColumn("grade", (F.col("ql") == F.col("label")).cast("int"))


def _ir(spark, d, k=10):
    pool = _pool(spark, d)
    return metrics.ir_metrics(pool.select("query", "doc", "rank"), pool.select("query", "doc", "grade"), k)


@query(f"WITH {_POOL} SELECT * FROM ir")
def ir_metrics(spark, d):
    return _ir(spark, d)


@query(f"WITH {_POOL} SELECT count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(precision), 6) AS precision, round(avg(map), 6) AS map FROM ir")
def ir_summary(spark, d):
    return _ir(spark, d).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "recall", "mrr", "precision", "map")])


@query(f"WITH {_POOL} SELECT query, round(sum(CASE WHEN grade > 0 THEN s / rank END) / sum(grade), 6) AS context_precision FROM (SELECT *, sum(grade) OVER (PARTITION BY query ORDER BY rank) AS s FROM pool) GROUP BY query HAVING sum(grade) > 0")
def context_precision(spark, d):
    from pyspark.sql import Window

    s = _pool(spark, d).withColumn("s", F.sum("grade").over(Window.partitionBy("query").orderBy("rank")))
    return s.groupBy("query").agg((F.sum(F.when(F.col("grade") > 0, F.col("s") / F.col("rank"))) / F.sum("grade")).alias("p"), F.sum("grade").alias("g")).filter("g > 0").select("query", F.round("p", 6).alias("context_precision"))


@query(f"WITH {_POOL}, w AS (SELECT precision - recall AS x FROM ir) SELECT count(*) AS n, round(avg(x), 6) AS mean_delta, count(*) FILTER (WHERE x > 0.01) AS wins, count(*) FILTER (WHERE x < -0.01) AS losses, count(*) FILTER (WHERE abs(x) <= 0.01) AS ties FROM w")
def ab_delta_tally(spark, d):
    x = F.col("precision") - F.col("recall")
    return _ir(spark, d).select(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean_delta"), F.count_if(F.col("x") > 0.01).alias("wins"), F.count_if(F.col("x") < -0.01).alias("losses"), F.count_if(F.abs("x") <= 0.01).alias("ties"))


@query(f"""WITH {_POOL}, v AS (SELECT map AS v, row_number() OVER (ORDER BY map) - 1 AS i, count(*) OVER () AS n FROM ir), n AS (SELECT count(*) AS n FROM ir),
draws AS (SELECT r, ('0x' || substr(md5(r || ':' || k), 1, 12))::BIGINT % n AS i FROM n, range(1000) a(r), range(n) b(k)),
m AS (SELECT r, avg(v) AS m FROM draws JOIN v USING (i) GROUP BY r), o AS (SELECT m, row_number() OVER (ORDER BY m) AS p FROM m)
SELECT round(max(m) FILTER (WHERE p = 26), 6) AS low, round(max(m) FILTER (WHERE p = 975), 6) AS high FROM o""")
def bootstrap_ci(spark, d):
    return metrics.bootstrap(_ir(spark, d), "map")


# ---- guards, costs, latency ----------------------------------------------------------------------------------------
def _nested(patterns, x="coalesce(text, '')"):
    for mark, p in patterns:
        x = f"regexp_replace({x}, '{p}', '{mark}', 'gi')"
    return x


@query(f"SELECT doc_id, md5(r) AS redacted, length(r)::BIGINT AS n_chars FROM (SELECT doc_id, {_nested(tx.PII)} AS r FROM documents)")
def pii_redact(spark, d):
    r = tx.redact_pii(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", r.alias("r")).select("doc_id", F.md5(F.col("r").cast("binary")).alias("redacted"), F.length("r").cast("long").alias("n_chars"))


@query(f"SELECT conv_id, turn, md5({_nested([('[REDACTED]', tx.INJECTION)])}) AS redacted FROM conversations")
def injection_redact(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.redact_injection(F.coalesce("text", F.lit(""))).cast("binary")).alias("redacted"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' OR lower(source) IN ('src3', 'src5')")
def rbac_guard(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", None).otherwise(F.concat(F.lit("admin , "), F.col("source"))).alias("allowed_roles"))
    return ingest.visible(docs, ["SRC3", "src5"]).select("doc_id")


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, sum(value::DECIMAL(18, 2))::DOUBLE AS cost FROM events GROUP BY ALL")
def cost_daily(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cost"))


def _rank_sql(p):
    return f"max(value) FILTER (WHERE r = ceil({p} * n))"


@query(f"SELECT event_type, {_rank_sql(0.5)} AS p50, {_rank_sql(0.99)} AS p99, round(max(value) / min(value), 6) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0) GROUP BY event_type")
def latency_percentiles(spark, d):
    e = table(spark, d, "events").filter("value > 0")
    return e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.99) within group (order by value)").alias("p99"), F.round(F.max("value") / F.min("value"), 6).alias("spread"))


@query("SELECT event_id, round(CASE WHEN ts IS NULL THEN value ELSE value * exp(-0.01 * greatest((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 3600, 0)) END, 6) AS decayed FROM events")
def time_decay(spark, d):
    return retrieval.decay(table(spark, d, "events"), "2024-02-01 00:00:00", score="value").select("event_id", F.round("decayed", 6).alias("decayed"))


@query("SELECT source, round(count(*) FILTER (WHERE quality = 1) / count(quality), 6) AS fraction, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source")
def verdict_fraction(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.round(F.count_if(F.col("quality") == 1) / F.count("quality"), 6).alias("fraction"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def reservoir_hash_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")).cast("binary")), "doc_id").limit(100)


# ---- ingestion -----------------------------------------------------------------------------------------------------
_OLD = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3"


@query(f"""SELECT doc_id, CASE WHEN NOT coalesce(a.here, false) THEN 'new' WHEN NOT coalesce(b.here, false) THEN 'deleted' WHEN sha256(a.text) IS NOT DISTINCT FROM sha256(b.text) THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT *, true AS here FROM ({_OLD})) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN text END AS text, true AS here FROM documents WHERE doc_id % 10 <> 4) b USING (doc_id)""")
def change_detection(spark, d):
    docs = table(spark, d, "documents")
    old = docs.filter("doc_id % 10 <> 3").select("doc_id", _edited().alias("text"))
    return ingest.changes(old, docs.filter("doc_id % 10 <> 4").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text")))


def _edited():
    return F.when(F.col("doc_id") % 11 != 0, F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query(f"""SELECT doc_id, CASE WHEN NOT coalesce(a.here, false) THEN 'new' WHEN NOT coalesce(b.here, false) THEN 'deleted' WHEN a.etag IS NOT DISTINCT FROM b.etag AND a.etag IS NOT NULL THEN 'unchanged'
WHEN sha256(a.text) IS NOT DISTINCT FROM sha256(b.text) THEN 'refreshed' ELSE 'changed' END AS status
FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 > 0 THEN 'e' || (doc_id % 3)::VARCHAR END AS etag, true AS here FROM ({_OLD})) a
FULL JOIN (SELECT doc_id, text, CASE WHEN doc_id % 5 > 0 THEN 'e' || (doc_id % 6)::VARCHAR END AS etag, true AS here FROM documents WHERE doc_id % 10 <> 4) b USING (doc_id)""")
def incremental_ingest(spark, d):
    docs = table(spark, d, "documents")
    tag = lambda n: F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("e"), (F.col("doc_id") % n).cast("string"))).alias("etag")
    state = docs.filter("doc_id % 10 <> 3").select("doc_id", tag(3), ingest.content_hash(_edited()).alias("hash"))
    return ingest.plan(state, docs.filter("doc_id % 10 <> 4").select("doc_id", tag(6), "text")).select("doc_id", "status")


@query(f"SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, md5(text) FROM ({_OLD}) WHERE doc_id % 3 <> 0")
def upsert_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 10 <> 3").select("doc_id", _edited().alias("text"))
    return ingest.upsert(old, docs.filter("doc_id % 3 = 0"), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return ingest.duplicates(table(spark, d, "documents"))


@query("SELECT source, lang, count(*) AS n_docs, coalesce(sum(n_chars), 0)::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (source, lang)")
def catalog_stats(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"))


@query("SELECT 'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey AS section FROM nation")
def csv_sections(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select(web.row_text(n).alias("section"))


_LINK = web.LINK.replace("'", "''")


@query(f"""SELECT page_id, regexp_replace(regexp_replace(trim(regexp_replace(t, '^["'']|["'']$', '', 'g'), ' '), '#.*$', ''), '/+$', '') AS target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS t FROM pages) GROUP BY ALL""")
def link_graph(spark, d):
    return web.links(table(spark, d, "pages"))


@query(f"SELECT page_id, i::INTEGER - 1 AS place, trim(regexp_replace(h, '{web.TAG}', '', 'g')) AS heading FROM (SELECT page_id, unnest(x) AS h, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '{web.HEADING}', 1) AS x FROM pages))")
def page_headings(spark, d):
    return web.headings(table(spark, d, "pages"))


@query("""WITH RECURSIVE c AS (
  SELECT doc_id, text, length(text) AS n, 0 AS s, CASE WHEN length(text) <= 512 THEN length(text) ELSE 512 END AS e0 FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, n, nx, least(nx + 512, n) FROM (SELECT *, CASE WHEN e >= n THEN n WHEN e - s - 50 > 0 THEN s + e - s - 50 ELSE e END AS nx FROM (
    SELECT *, CASE WHEN e0 < n AND strpos(reverse(text[s + 2:e0]), ' ') > 0 THEN e0 - strpos(reverse(text[s + 2:e0]), ' ') ELSE e0 END AS e FROM c)) WHERE nx < n
), f AS (SELECT doc_id, s, CASE WHEN e0 < n AND strpos(reverse(text[s + 2:e0]), ' ') > 0 THEN e0 - strpos(reverse(text[s + 2:e0]), ' ') ELSE e0 END AS e, text FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS chunk_index, s::INTEGER AS start_pos, e::INTEGER AS end_pos, md5(regexp_replace(text[s + 1:e], '^\\s+|\\s+$', '', 'g')) AS body
FROM f WHERE regexp_matches(text[s + 1:e], '\\S')""")
def fixed_chunks(spark, d):
    return chunking.chunk(table(spark, d, "documents")).select("doc_id", "chunk_index", "start_pos", "end_pos", F.md5(F.col("text").cast("binary")).alias("body"))


@query()
def recursive_chunks(spark, d):
    return chunking.chunk(table(spark, d, "documents"), "recursive")


@query("""WITH c AS (SELECT doc_id AS doc, unnest(range(0, greatest(n_chars, 1), 462)) AS start, n_chars FROM documents),
p AS (SELECT doc_id AS doc, unnest(range(0, greatest(n_chars, 1), 1948)) AS start, n_chars FROM documents WHERE doc_id % 9 <> 2)
SELECT doc, start // 462 AS child, coalesce((SELECT min(p.start // 1948) FROM p WHERE p.doc = c.doc AND c.start BETWEEN p.start AND least(p.start + 2048, p.n_chars)), (SELECT max(p.start // 1948) FROM p WHERE p.doc = c.doc)) AS parent FROM c""")
def parent_range_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "n_chars")

    def cut(docs, step, name):
        return docs.select("doc", "n_chars", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_chars") - 1, F.lit(0)), F.lit(step))).alias("start")).withColumn(name, F.expr(f"start div {step}"))

    return retrieval.parents(cut(docs, 462, "child"), cut(docs.filter("doc % 9 <> 2"), 1948, "parent").withColumn("end", F.least(F.col("start") + 2048, F.col("n_chars"))))


# ---- conversations -------------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn FROM conversations QUALIFY role = 'system' OR row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) <= 6")
def memory_window(spark, d):
    return ingest.window(table(spark, d, "conversations"), 3).select("conv_id", "turn")


@query("""SELECT conv_id, turn FROM (SELECT *, len(regexp_extract_all(text, '\\S+')) AS c FROM conversations)
QUALIFY role = 'system' OR sum(CASE WHEN role = 'system' THEN c ELSE 0 END) OVER (PARTITION BY conv_id) + sum(CASE WHEN role <> 'system' THEN c ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 200""")
def memory_token_budget(spark, d):
    t = table(spark, d, "conversations").withColumn("cost", F.size(F.array_remove(F.split("text", r"\s+"), "")))
    return ingest.within(t, 200).select("conv_id", "turn")


@query("""WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM conversations)
SELECT conv_id, pair::BIGINT AS pair, count(*) - 1 AS n_replies, md5(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn)) AS body FROM t WHERE pair > 0 GROUP BY ALL""")
def exchange_docs(spark, d):
    return ingest.exchanges(table(spark, d, "conversations")).select("conv_id", "pair", "n_replies", F.md5(F.col("text").cast("binary")).alias("body"))


# ---- graph ---------------------------------------------------------------------------------------------------------
_EDGES = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def _trade(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node")), li.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))


@query(f"WITH {_EDGES} SELECT n_nationkey AS node, count(x) AS degree FROM nation LEFT JOIN (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) ON x = n_nationkey GROUP BY node")
def graph_degree(spark, d):
    return graph.degrees(*_trade(spark, d))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS a, -l_partkey - 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
s AS (SELECT DISTINCT a AS origin FROM e WHERE a % 100 = 0), h1 AS (SELECT DISTINCT origin, b AS node FROM s JOIN u ON a = origin),
h2 AS (SELECT DISTINCT origin, b AS node FROM h1 JOIN u ON a = node WHERE b <> origin EXCEPT SELECT origin, node FROM h1)
SELECT origin, node, 1 AS hop FROM h1 UNION ALL SELECT origin, node, 2 FROM h2""")
def neighbors_k(spark, d):
    e = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"))
    return graph.neighbours(e, e.filter("src % 100 = 0").select(F.col("src").alias("node")).distinct(), 2)


def _pagerank_sql(rounds=20):
    steps = ", ".join(
        f"r{i + 1} AS (SELECT n.node, 0.15 / k + 0.85 * (coalesce(came, 0) + lost / k) AS score FROM n LEFT JOIN (SELECT m.dst AS node, sum(score * share) AS came FROM r{i} JOIN m ON m.src = r{i}.node GROUP BY 1) USING (node), k, (SELECT coalesce(sum(score), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM m)))"
        for i in range(rounds)
    )
    return f"""WITH {_EDGES}, n AS (SELECT n_nationkey AS node FROM nation), k AS (SELECT count(*) AS k FROM n), g AS (SELECT src, dst, count(*) AS c FROM e WHERE src <> dst GROUP BY ALL),
m AS (SELECT src, dst, c / sum(c) OVER (PARTITION BY src) AS share FROM g), r0 AS (SELECT node, 1.0 / k AS score FROM n, k), {steps} SELECT node, round(score, 9) AS score FROM r{rounds}"""


@query(_pagerank_sql())
def pagerank(spark, d):
    # the SQL takes 20 rounds whatever they change
    return graph.pagerank(*_trade(spark, d), rounds=20, least=0.0).select("node", F.round("score", 9).alias("score"))


# ---- streams -------------------------------------------------------------------------------------------------------
@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return st.settle(st.tumbling(st.file_stream(spark, d, "events")), "tumbling")


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def stream_ingest(spark, d):
    s = st.file_stream(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return st.settle(s, "ingest", "append").select("doc_id", "h")


# ---- more retrieval ------------------------------------------------------------------------------------------------
#: Synonym groups of the sample languages' commonest words.
GROUPS = [(1, "the"), (1, "le"), (1, "der"), (2, "and"), (2, "et"), (2, "und"), (3, "of"), (3, "de")]
_GROUPS = f"g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {t!r})' for i, t in GROUPS)}) v(g, term)), y AS (SELECT DISTINCT a.term, b.term AS more FROM g a JOIN g b USING (g) WHERE a.term <> b.term)"


@query(f"""WITH {_GROUPS}, t AS (SELECT doc_id AS doc, {TOK} AS t FROM documents), e0 AS (SELECT doc, unnest(t) AS term FROM t), e AS (SELECT * FROM e0 UNION ALL SELECT doc, more FROM e0 JOIN y USING (term)),
l AS (SELECT doc, count(*) AS len FROM e GROUP BY doc), tf AS (SELECT doc, term, count(*) AS tf, any_value(len) AS len FROM e JOIN l USING (doc) GROUP BY ALL),
q0 AS (SELECT item_id AS query, unnest({TOK}) AS term FROM benchmark), q AS (SELECT DISTINCT * FROM (SELECT * FROM q0 UNION ALL SELECT query, more FROM q0 JOIN y USING (term))),
n AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT sum(len) FROM l) / (SELECT count(*) FROM t) AS al),
bm AS (SELECT query, doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN tf USING (term) JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term), n GROUP BY query, doc)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 10""")
def bm25_synonyms(spark, d):
    groups = spark.createDataFrame(GROUPS, "group_id int, term string")
    return search.bm25(table(spark, d, "documents"), _bench(spark, d), groups=groups)


def _cos(name, where, q="a.vec_id", k=10):
    dot = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
    return f"""{name}c AS (SELECT {q} AS query, b.vec_id AS doc, round({dot.format('a', 'b')} / sqrt({dot.format('a', 'a')} * {dot.format('b', 'b')}), 6) AS score FROM embeddings a JOIN embeddings b ON {where}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {name}c QUALIFY rank <= {k})"""


@query(f"""WITH {_cos('s0', 'a.vec_id % 100 = 0 AND b.vec_id % 2 = 0')}, {_cos('s1', 'a.vec_id % 100 = 0 AND b.vec_id % 2 = 1')},
u AS (SELECT *, 0 AS store FROM s0 UNION ALL SELECT *, 1 FROM s1)
SELECT query, doc, round(1 / (60 + rank), 9) AS score, store, row_number() OVER (PARTITION BY query ORDER BY round(1 / (60 + rank), 9) DESC, u.score DESC, store, u.rank, doc) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(1 / (60 + rank), 9) DESC, u.score DESC, store, u.rank, doc) <= 10""")
def federated_rrf(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc")
    q = v.filter("doc % 100 = 0").withColumnRenamed("doc", "query")
    return search.federate([search.dense(v.filter(f"doc % 2 = {i}"), q) for i in (0, 1)])


@query(f"""WITH {_cos('v0', 'a.vec_id % 100 = 0')}, {_cos('v1', 'a.vec_id % 100 = 1', 'a.vec_id - 1')}, m AS (SELECT query, doc, max(score) AS score FROM (FROM v0 UNION ALL FROM v1) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM m QUALIFY rank <= 10""")
def multi_query_max_merge(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc")
    variants = [v.filter(f"doc % 100 = {i}").withColumn("query", F.col("doc") - i).drop("doc") for i in (0, 1)]
    return search.best_of([search.dense(v, q) for q in variants])


@query(f"""WITH {_cos('h', 'a.vec_id % 100 = 0', k=20)}, m AS (SELECT h.*, label AS key FROM h JOIN embeddings ON vec_id = doc QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY rank) = 1)
SELECT query, key, doc FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 2""")
def tag_search(spark, d):
    return search.tags(_dense(spark, d, 20), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("label").alias("key")), 2)


@query(f"""WITH RECURSIVE {_POST}, {_Q}, {_BM25}, c AS (SELECT query, rank, len(t) AS c FROM bm25 JOIN t USING (doc)),
b AS (SELECT DISTINCT query, 0::BIGINT AS rank, 600::BIGINT AS room, false AS taken FROM c
UNION ALL SELECT c.query, c.rank, CASE WHEN c.c <= room THEN room - c.c ELSE room END, c.c <= room FROM b JOIN c ON c.query = b.query AND c.rank = b.rank + 1) SELECT query, rank FROM b WHERE taken""")
def context_budget(spark, d):
    docs = table(spark, d, "documents")
    hits = search.bm25(docs, _bench(spark, d)).join(docs.select(F.col("doc_id").alias("doc"), F.size(tx.tokens(F.col("text"))).cast("long").alias("cost")), "doc")
    return retrieval.budget(hits, "query", "rank", "cost", 600)


_TURNS = "documents AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"


@query(f"""WITH {_TURNS}, {_POST}, {_Q}, {_BM25.replace('rank <= 10', 'rank <= 50')}, p AS (SELECT query, doc // 1000 AS doc, max(score) AS score FROM bm25 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM p QUALIFY rank <= 10""")
def maxpool_docs(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return search.pooled(search.bm25(turns, _bench(spark, d), 50), F.expr("doc div 1000"))


# ---- more evaluation -----------------------------------------------------------------------------------------------
@query(f"""WITH {_POOL}, f AS (SELECT query, count(*) AS n_new FROM (SELECT doc, min(query) AS query FROM pool WHERE grade > 0 GROUP BY doc) GROUP BY query),
r AS (SELECT query, coalesce(n_new, 0) AS n_new, sum(coalesce(n_new, 0)) OVER (ORDER BY query)::BIGINT AS n_docs FROM (SELECT DISTINCT query FROM pool) LEFT JOIN f USING (query))
SELECT * FROM r WHERE n_docs - n_new < 15""")
def slice_walk(spark, d):
    return metrics.slice_walk(_pool(spark, d).select("query", "doc", "grade"), 15)


@query("""WITH t AS (SELECT event_type AS run, user_id AS query, value AS ms FROM events WHERE value > 0), r AS (SELECT run, max(ms) FILTER (WHERE i = ceil(0.5 * n)) AS p50 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ms) AS i, count(*) OVER (PARTITION BY run) AS n FROM t) GROUP BY run),
s AS (SELECT count(*) AS n_runs, round(max(p50) / min(p50), 6) AS spread FROM r), q AS (SELECT min(c) AS least FROM (SELECT count(DISTINCT run) AS c FROM t GROUP BY query))
SELECT n_runs, spread, least = n_runs AS same_queries, least = n_runs AND n_runs > 1 AND spread <= 3 AS passes FROM s, q""")
def cost_gate(spark, d):
    return metrics.repeat_gate(table(spark, d, "events").filter("value > 0").select(F.col("event_type").alias("run"), F.col("user_id").alias("query"), F.col("value").alias("ms")))


@query("""WITH s AS (SELECT CASE WHEN doc_id % 5 <> 0 THEN quality::DOUBLE END AS quality, toxic::DOUBLE AS toxic FROM labels),
m AS (SELECT 'quality' AS metric, avg(quality) AS mean, count(*) FILTER (WHERE quality IS NULL) AS unscoreable FROM s UNION ALL SELECT 'toxic', avg(toxic), count(*) FILTER (WHERE toxic IS NULL) FROM s)
SELECT metric, round(mean, 6) AS mean, unscoreable::BIGINT AS unscoreable FROM (FROM m UNION ALL SELECT 'overall', avg(mean), sum(unscoreable) FROM m)""")
def metric_rollup(spark, d):
    s = table(spark, d, "labels").select(F.when(F.col("doc_id") % 5 != 0, F.col("quality").cast("double")).alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return metrics.rollup(s, ["quality", "toxic"])


_BARE = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"


@query(f"""SELECT a.conv_id, a.turn, len(list_intersect(list_filter(regexp_split_to_array(lower(a.text), '[ \\n\\t]+'), lambda x: x <> ''), list_filter(regexp_split_to_array(lower(b.text), '[ \\n\\t]+'), lambda x: x <> ''))) > 0 AS shares, {_BARE.format('a.text')} = {_BARE.format('b.text')} AS equal
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def answer_match(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    shares, equal = metrics.answer_match(F.col("text"), F.col("reply"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", shares.alias("shares"), equal.alias("equal"))


# ---- more ingestion ------------------------------------------------------------------------------------------------
@query("SELECT 'documents' AS name, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'labels', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark, d):
    held = {n: table(spark, d, n).select("doc_id") for n in ("documents", "labels")}
    left = ingest.delete(held, table(spark, d, "labels").filter("toxic = 1"))
    return left["documents"].select(F.lit("documents").alias("name"), "doc_id").unionByName(left["labels"].select(F.lit("labels").alias("name"), "doc_id"))


@query("SELECT vec_id AS doc_id FROM embeddings WHERE label < 3 OR len(embedding) <> 64")
def reindex_stale(spark, d):
    stamps = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 3, "old").otherwise("new").alias("model"), F.size("embedding").alias("dim"))
    return ingest.stale(stamps, "new", 64).select("doc_id")


@query("SELECT doc_id, coalesce(lang, 'none') AS lang, 'tag' AS source, doc_id::VARCHAR AS document_id FROM documents")
def map_precedence(spark, d):
    lang = F.coalesce("lang", F.lit("none"))
    system = F.create_map(F.lit("document_id"), F.col("doc_id").cast("string"), F.lit("source"), F.lit("system"), F.lit("lang"), F.lit("system"))
    m = ingest.precedence(system, F.create_map(F.lit("source"), F.lit("tag"), F.lit("lang"), F.lit("tag")), F.create_map(F.lit("lang"), lang))
    return table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", *[F.col("m")[k].alias(k) for k in ("lang", "source", "document_id")])


@query("SELECT key, md5(any_value(text)) AS h FROM (SELECT sha256('m1' || chr(10) || text) AS key, text, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY key HAVING key NOT IN (SELECT sha256('m1' || chr(10) || text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def embed_cache_misses(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.filter("doc_id % 3 = 0").select(F.sha2(F.concat(F.lit("m1\n"), F.col("text")).cast("binary"), 256).alias("key"))
    return ingest.cache_misses(docs.select("text"), cache, "m1").select("key", F.md5(F.col("text").cast("binary")).alias("h"))


def _sections(spark, d):
    """Lines of documents as sections; the length of a line stands in for its heading level."""
    ln = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("place", "text"))
    level = F.length("text") % 5
    return ln.withColumn("level", F.when(level > 0, level)).withColumn("heading", F.when(level > 0, F.substring("text", 1, 12)))


_SECTIONS = "s AS (SELECT doc_id AS doc, i::INTEGER - 1 AS place, l AS text, nullif(length(l) % 5, 0) AS level, CASE WHEN length(l) % 5 > 0 THEN l[1:12] END AS heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL))"
_OPEN = ", ".join(f"CASE WHEN p{n} > coalesce(u{n}, -1) THEN h{n} END" for n in range(1, 5))
_RUN = ", ".join(f"max(CASE WHEN level = {n} THEN place END) OVER w AS p{n}, last_value(CASE WHEN level = {n} THEN heading END IGNORE NULLS) OVER w AS h{n}, max(CASE WHEN level < {n} THEN place END) OVER w AS u{n}" for n in range(1, 5))


@query(f"WITH {_SECTIONS}, r AS (SELECT doc, place, {_RUN} FROM s WINDOW w AS (PARTITION BY doc ORDER BY place ROWS UNBOUNDED PRECEDING)) SELECT doc, place, md5(concat_ws(' > ', {_OPEN})) AS path FROM r")
def breadcrumbs(spark, d):
    return chunking.breadcrumbs(_sections(spark, d)).select("doc", "place", F.md5(F.col("path").cast("binary")).alias("path"))


@query(f"""WITH {_SECTIONS}, r AS (SELECT *, coalesce(level <= 2, false) AS o, sum(coalesce(level <= 2, false)::INT) OVER (PARTITION BY doc ORDER BY place) AS part FROM s)
SELECT * FROM (SELECT doc, part::BIGINT AS part, count(*) AS n_sections, md5(coalesce(nullif(max(heading) FILTER (WHERE o), '') || chr(10) || chr(10), '')
|| regexp_replace(coalesce(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY place) FILTER (WHERE NOT o), ''), '^\\s+|\\s+$', '', 'g')) AS body FROM r GROUP BY doc, part) WHERE body <> md5('')""")
def hierarchical_merge(spark, d):
    return chunking.merged(_sections(spark, d)).select("doc", "part", "n_sections", F.md5(F.col("text").cast("binary")).alias("body"))


@query()
def code_chunks(spark, d):
    return chunking.chunk(table(spark, d, "documents"), "code")


# ---- more graph and streams ----------------------------------------------------------------------------------------
def _chosen(spark, d):
    return table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("node"))


_CHOSEN = "x AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 1)"
_INCIDENT = "i AS (SELECT DISTINCT src, dst FROM e WHERE src IN (FROM x) OR dst IN (FROM x))"


@query(f"WITH {_EDGES}, {_CHOSEN}, {_INCIDENT} SELECT * FROM i")
def incident_edges(spark, d):
    return graph.incident(_trade(spark, d)[1], _chosen(spark, d))


@query(f"""WITH {_EDGES}, {_CHOSEN}, {_INCIDENT}, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node),
f AS (SELECT i.*, src IN (FROM x) AND dst IN (FROM x) AS inside, a.degree + b.degree AS s, CASE WHEN src IN (FROM x) THEN dst ELSE src END AS o, CASE WHEN src IN (FROM x) THEN src ELSE dst END AS m FROM i JOIN g a ON a.node = src JOIN g b ON b.node = dst),
p AS (SELECT o, count(DISTINCT m) AS partners FROM f WHERE NOT inside GROUP BY o),
r AS (SELECT src, dst, inside, row_number() OVER (PARTITION BY inside ORDER BY CASE WHEN inside THEN 0 ELSE partners END DESC, s DESC, src, dst) AS rank FROM f LEFT JOIN p USING (o))
SELECT * FROM r WHERE inside OR rank <= 3 * (SELECT count(*) FROM x)""")
def rel_ranking(spark, d):
    nodes, edges = _trade(spark, d)
    return graph.rank_edges(edges, _chosen(spark, d), graph.degrees(nodes, edges), 3)


@query("""WITH c AS (SELECT c_nationkey AS entity, o_orderdate::DATE::VARCHAR AS chunk, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT chunk, entity, n FROM c QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY entity DESC) = 1""")
def source_chunk_rank(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cited = o.groupBy(F.col("c_nationkey").alias("entity"), F.to_date("o_orderdate").cast("string").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return graph.chunk_order(cited.withColumn("place", -F.col("entity")))


@query("""WITH n AS (SELECT n_regionkey AS community, count(*) AS n_chosen FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY ALL)
SELECT community, n_chosen, row_number() OVER (ORDER BY n_chosen DESC, community) AS rank FROM n JOIN region ON r_regionkey = community WHERE r_regionkey <> 2""")
def community_order(spark, d):
    n = table(spark, d, "nation")
    told = table(spark, d, "region").select(F.col("r_regionkey").alias("community"), F.when(F.col("r_regionkey") == 2, " ").otherwise(F.col("r_name")).alias("report"))
    return graph.order_communities(n.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community")), told, n.filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("node")))


@query("""WITH g AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INT AS o FROM events),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, regexp_replace(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    got = st.settle(st.sessions(st.file_stream(spark, d, "events")), "sessions")
    return got.withColumn("start", F.regexp_replace(F.concat("start", F.when(F.contains("start", F.lit(".")), F.lit("")).otherwise(F.lit(".0"))), r"\.?0+$", ""))


@query("""WITH a AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS message, event_type, ts, row_number() OVER w AS i, min(ts) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)),
f AS (SELECT message, min(first) AS first, min(i) FILTER (ts <= first + INTERVAL 6 HOUR AND (event_type IN ('purchase', 'error') OR i = 3)) AS e, count(*) FILTER (ts <= first + INTERVAL 6 HOUR) AS n, max(ts) AS last FROM a GROUP BY message)
SELECT message, CASE WHEN e IS NULL THEN 'abandoned' WHEN event_type = 'purchase' THEN 'done' ELSE 'dead' END AS status, coalesce(e, n)::INTEGER AS attempts,
CASE WHEN e IS NULL THEN 'deadline' WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'error' THEN 'fatal' ELSE 'attempts' END AS cause
FROM f LEFT JOIN a USING (message) WHERE i = coalesce(e, 1) AND (e IS NOT NULL OR last > f.first + INTERVAL 6 HOUR OR f.first + INTERVAL 7 HOUR < (SELECT max(ts) FROM events))""")
def stream_deliveries(spark, d):
    """Events as attempts to deliver a message of a user and a day, some of them delivered twice."""
    e = st.file_stream(spark, d, "events")
    outcome = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fatal").otherwise("retry")
    twice = F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    message = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    a = e.select(message.alias("message"), F.col("event_id").alias("attempt"), "ts", outcome.alias("outcome"), twice.alias("copy")).drop("copy")
    with deliveries.state_store(spark):
        return st.settle(deliveries.settled(a), "deliveries", "append")


from loamfield.plans import evaluating, graphs, indexes, reading, writing  # noqa: E402, F401  (they register their queries)
