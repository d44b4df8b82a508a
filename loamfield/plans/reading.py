"""Queries about searching and what happens to hits, with their SQL."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import functions as F

from loamfield.functions import text as tx
from loamfield.operators import answers, governance, ingest, retrieval, search, semantic, tree
from loamfield.plans.catalogue import _BM25, _POST, _Q, _SPARSE, TOK, _bench, _cos, _dense, _dense_sql
from loamfield.plans.registry import query
from loamfield.session import table

# ---- tokens --------------------------------------------------------------------------------------------------------
_CJK_TEXT = "translate(lower(coalesce(text, '')), 'aeou', '中文か한')"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace({_CJK_TEXT}, '([{tx.CJK}]+)', ' \\1 ', 'g'), '{tx.TOKEN}') AS t FROM documents),
x AS (SELECT doc_id, flatten(list_transform(t, lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, '^[{tx.CJK}]') THEN list_transform(range(1, length(w)), lambda i: w[i:i + 1]) ELSE [w] END)) AS t FROM d)
SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS h FROM x""")
def tokenize_cjk(spark, d):
    t = tx.tokens(F.translate(F.lower("text"), "aeou", "中文か한"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("h"))


#: Synonym groups with phrases of two words.
PHRASES = [(1, "the"), (1, "of the"), (2, "and"), (2, "in the"), (2, "und"), (3, "de la"), (3, "le")]
_PHRASES = f"g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {t!r})' for i, t in PHRASES)}) v(g, term)), y AS (SELECT term, unnest(string_split(other, ' ')) AS more FROM (SELECT DISTINCT a.term, b.term AS other FROM g a JOIN g b USING (g) WHERE a.term <> b.term))"
_GRAMS = "SELECT {0}, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM {1}"


@query(f"""WITH {_PHRASES}, t AS (SELECT doc_id AS doc, {TOK} AS t FROM documents), u AS (SELECT item_id AS query, {TOK} AS t FROM benchmark),
e AS (SELECT doc, unnest(t) AS term FROM t UNION ALL SELECT doc, more FROM ({_GRAMS.format('doc', 't')}) JOIN y USING (term)),
l AS (SELECT doc, count(*) AS len FROM e GROUP BY doc), tf AS (SELECT doc, term, count(*) AS tf, any_value(len) AS len FROM e JOIN l USING (doc) GROUP BY ALL),
q AS (SELECT DISTINCT * FROM (SELECT query, unnest(t) AS term FROM u UNION ALL SELECT query, more FROM ({_GRAMS.format('query', 'u')}) JOIN y USING (term))),
n AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT sum(len) FROM l) / (SELECT count(*) FROM t) AS al),
bm AS (SELECT query, doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN tf USING (term) JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term), n GROUP BY query, doc)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 10""")
def bm25_phrase_synonyms(spark, d):
    return search.bm25(table(spark, d, "documents"), _bench(spark, d), groups=spark.createDataFrame(PHRASES, "group_id int, term string"))


_TOXIC = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"


@query(f"WITH kept AS (SELECT * FROM documents WHERE {_TOXIC}), {_POST.replace('FROM documents', 'FROM kept')}, {_Q}, {_BM25} SELECT * FROM bm25")
def bm25_after_delete(spark, d):
    left = ingest.delete({"documents": table(spark, d, "documents")}, table(spark, d, "labels").filter("toxic = 1"))["documents"]
    return search.bm25(left, _bench(spark, d))


@query("SELECT conv_id, turn, md5(translate(text, chr(10) || chr(13) || chr(9), '   ')) AS h FROM conversations")
def wordpiece_spaces(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.translate("text", "\n\r\t", "   ").cast("binary")).alias("h"))


@query("SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS h FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\.\\s+|[!?]\\s+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark, d):
    s = semantic.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("h"))


# ---- scales and stores ---------------------------------------------------------------------------------------------
@query(f"WITH {_dense_sql()} SELECT query, doc, round((1 + score) / 2, 6) AS score, rank FROM dense")
def certainty_topk(spark, d):
    return search.scaled(_dense(spark, d), "certainty")


@query(f"WITH {_dense_sql()} SELECT query, doc, round(1 - score, 6) AS score, rank FROM dense WHERE score >= 0.2")
def distance_after_knn(spark, d):
    return search.scaled(_dense(spark, d).filter("score >= 0.2"), "distance")


_LOGITS = "SELECT vec_id // 4 AS key, vec_id % 4 AS win, i AS term, v::DOUBLE AS logit FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_POOLED = f"w AS (SELECT key, term, ln(1 + max(logit)) AS w FROM ({_LOGITS}) WHERE logit > 0 GROUP BY ALL), p AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY w DESC, term) <= 16)"


def _pooled(spark, d):
    v = table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("key"), (F.col("vec_id") % 4).alias("window"), F.posexplode("embedding").alias("term", "logit"))
    return search.pooled_logits(v.withColumn("logit", F.col("logit").cast("double")), 16)


@query(f"WITH {_POOLED} SELECT key, term::INTEGER AS term, round(w, 6) AS w FROM p")
def splade_pool(spark, d):
    return _pooled(spark, d).withColumn("w", F.round("w", 6))


@query(f"""WITH {_POOLED}, s AS (SELECT a.key AS query, b.key AS doc, round(sum(a.w * b.w), 6) AS score FROM p a JOIN p b USING (term) WHERE a.key % 25 = 0 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s WHERE score >= 0.05 QUALIFY rank <= 10""")
def sparse_inner_topk(spark, d):
    p = _pooled(spark, d)
    return search.inner(p.withColumnRenamed("key", "doc"), p.filter("key % 25 = 0").withColumnRenamed("key", "query"), least=0.05)


@query("SELECT conv_id, turn, md5(text) AS h FROM conversations WHERE (conv_id, turn) IN (SELECT conv_id * 2, turn FROM conversations WHERE turn < 2)")
def chunk_lookup(spark, d):
    t = table(spark, d, "conversations")
    return search.lookup(t, t.filter("turn < 2").select((F.col("conv_id") * 2).alias("conv_id"), "turn"), ["conv_id", "turn"]).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("h"))


# ---- vectors -------------------------------------------------------------------------------------------------------
@query("""WITH m AS (SELECT vec_id // 3 AS query, i, avg(v::DOUBLE) AS a FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
n AS (SELECT query, sqrt(sum(a * a)) AS n FROM m GROUP BY query) SELECT query, (i - 1)::INTEGER AS i, round(a / n, 6) AS v FROM m JOIN n USING (query) WHERE n > 0 AND i <= 8""")
def hyde_vectors(spark, d):
    g = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 3").alias("query")).agg(F.collect_list("embedding").alias("v"))  # three made-up answers
    return g.select("query", F.posexplode(semantic.mean_vector(F.col("v"))).alias("i", "v")).filter("i < 8").withColumn("v", F.round("v", 6))


@query(f"""WITH {_POST}, {_Q}, {_BM25.replace('rank <= 10', 'rank <= 30')}, m AS (SELECT query, doc, score, list_distinct({TOK}) AS ql FROM bm25 JOIN benchmark ON item_id = query),
r AS (SELECT query, doc, score, round(len(list_intersect(ql, t)) / len(ql), 6) AS relevance FROM m JOIN t USING (doc))
SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, score DESC, doc) AS rank FROM r QUALIFY rank <= 10""")
def rerank_overlap(spark, d):
    docs, q = table(spark, d, "documents"), _bench(spark, d)
    hits = search.bm25(docs, q, 30).drop("rank").join(q.select("query", F.col("text").alias("question")), "query").join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
    mine = F.array_distinct(tx.tokens(F.col("question")))
    hits = hits.withColumn("relevance", F.round(F.size(F.array_intersect(mine, tx.tokens(F.col("text")))) / F.size(mine), 6))
    w = F.row_number().over(search.Window.partitionBy("query").orderBy(F.desc("relevance"), F.desc("score"), "doc"))
    return hits.withColumn("rank", w).filter("rank <= 10").select("query", "doc", "score", "relevance", "rank")


_TURNS = "documents AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"


@query(f"""WITH {_TURNS}, {_POST}, {_Q}, {_BM25.replace('rank <= 10', 'rank <= 30')}, b AS (SELECT conv_id AS parent, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
h AS (SELECT query, doc, score, CASE WHEN doc // 1000 % 4 > 0 THEN doc // 1000 END AS parent FROM bm25),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query, coalesce(parent::VARCHAR, 'child ' || doc) ORDER BY score DESC, doc) = 1)
SELECT query, o.doc, md5(coalesce(body, text)) AS body, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, o.doc) AS rank FROM o LEFT JOIN b USING (parent) JOIN documents ON doc_id = o.doc QUALIFY rank <= 10""")
def parent_expand(spark, d):
    t = table(spark, d, "conversations")
    turns = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    hits = search.bm25(turns, _bench(spark, d), 30).join(turns.select(F.col("doc_id").alias("doc"), "text"), "doc")
    bodies = t.groupBy(F.col("conv_id").alias("parent")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("body"))
    links = turns.select(F.col("doc_id").alias("doc"), F.expr("doc_id div 1000").alias("parent")).filter("parent % 4 > 0")
    return retrieval.expand_parents(hits.select("query", "doc", "text", "score"), links, bodies).withColumn("body", F.md5(F.col("text").cast("binary"))).drop("text")


@query(f"WITH {_POST}, {_Q}, {_BM25}, {_SPARSE} SELECT query, doc, max(score) AS score, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, doc) AS rank FROM (SELECT query, doc, score FROM bm25 UNION ALL SELECT query, doc, score FROM sparse) GROUP BY query, doc")
def research_merge(spark, d):
    docs, q = search.token_table(table(spark, d, "documents")), _bench(spark, d)
    return search.best_of([search.bm25(docs, q), search.sparse(docs, q)], 1_000_000)


# ---- levels of a tree ----------------------------------------------------------------------------------------------
def _levels(spark, d):
    level = (F.col("vec_id") % 3).cast("int").alias("level")
    return _dense(spark, d, 30).drop("rank").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), level), "doc")


_LEVELS = f"{_cos('h', 'a.vec_id % 100 = 0', k=30)}, l AS (SELECT query, doc, score, (doc % 3)::INTEGER AS level FROM h)"
_BEST = "row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank"


@query(f"WITH {_LEVELS} SELECT query, doc, level, score, {_BEST} FROM l QUALIFY rank <= 10")
def tree_blend(spark, d):
    return tree.search_levels(_levels(spark, d))


@query(f"WITH {_LEVELS}, s AS (SELECT query, doc, level, round(CASE WHEN level > 0 THEN score * 1.2::DOUBLE ELSE score END, 9) AS score FROM l) SELECT *, {_BEST} FROM s QUALIFY rank <= 10")
def tree_boost(spark, d):
    return tree.search_levels(_levels(spark, d), "boost")


@query(f"WITH {_LEVELS} SELECT query, doc, level, score, {_BEST} FROM l WHERE level BETWEEN 1 AND 1 QUALIFY rank <= 10")
def tree_filter(spark, d):
    return tree.search_levels(_levels(spark, d), "filter", low=1, high=1)


@query("""WITH n AS (SELECT source AS scope, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), l AS (SELECT source AS scope, count(*) AS was FROM documents WHERE doc_id % 12 <> 5 AND source IS NOT NULL GROUP BY source HAVING count(*) % 3 > 0)
SELECT scope, n, was IS NULL OR n >= was * 1.1::DOUBLE AS due FROM n LEFT JOIN l USING (scope)""")
def growth_gate(spark, d):
    s = table(spark, d, "documents").filter("source is not null").select("doc_id", F.col("source").alias("scope"))
    return tree.due(s, s.filter("doc_id % 12 <> 5").groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter("n % 3 > 0"))


@query("SELECT c_nationkey AS cluster, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS children, md5(string_agg(c_name, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY c_custkey)) AS body FROM customer GROUP BY ALL")
def cluster_prompts(spark, d):
    m = table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    return tree.cluster_texts(m).select("cluster", "children", F.md5(F.col("text").cast("binary")).alias("body"))


# ---- guards, requests, answers -------------------------------------------------------------------------------------
_TRUST = "CASE doc_id % 4 WHEN 1 THEN 'Untrusted' WHEN 2 THEN 'internal' WHEN 3 THEN ' ' END"


def _trust(spark, d):
    n = F.col("doc_id") % 4
    return table(spark, d, "documents").select("doc_id", "source", F.when(n == 1, "Untrusted").when(n == 2, "internal").when(n == 3, " ").alias("trust_level"))


@query(f"SELECT doc_id, {_TRUST} AS trust_level FROM documents WHERE doc_id % 4 <> 1")
def trust_guard(spark, d):
    return governance.trusted(_trust(spark, d)).select("doc_id", "trust_level")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 1 AND (source IS NULL OR list_has_any(list_transform(string_split(source, ','), lambda x: lower(trim(x))), (SELECT list(lower(s)) FROM (SELECT DISTINCT source AS s FROM documents WHERE source IS NOT NULL ORDER BY s LIMIT 2))))")
def guard_chain(spark, d):
    docs = _trust(spark, d)
    roles = [r["source"] for r in docs.filter("source is not null").select("source").distinct().orderBy("source").limit(2).collect()]
    return governance.guarded(docs.select("doc_id", "source", "trust_level"), [governance.trusted, lambda x: ingest.visible(x, roles, "source")]).select("doc_id")


@query("SELECT conv_id, turn, 'Answer from the sources alone.' || coalesce(chr(10) || chr(10) || nullif(trim(text, ' '), ''), '') AS prompt FROM conversations WHERE role = 'system'")
def prompt_hardening(spark, d):
    t = table(spark, d, "conversations").filter("role = 'system'")
    return t.select("conv_id", "turn", governance.hardened(F.col("text"), "Answer from the sources alone.").alias("prompt"))


@query(f"WITH {_POST}, {_Q}, {_BM25} SELECT query, 'retrieval' AS kind, count(*) AS n, string_agg(doc::VARCHAR, ',' ORDER BY rank) AS chunks FROM bm25 GROUP BY query")
def audit_events(spark, d):
    return governance.audit(search.bm25(table(spark, d, "documents"), _bench(spark, d)), "retrieval")


_OPTIONS = json.dumps(asdict(governance.SearchOptions()), sort_keys=True)


@query(f"""SELECT doc_id, sha256('{_OPTIONS}' || chr(10) || n_chars::VARCHAR || chr(10) || '{{"k":"lang","v":"' || coalesce(lang, 'none') || '"}}' || chr(10) || '{{"k":"source","v":"' || coalesce(source, 'none') || '"}}') AS key FROM documents""")
def result_cache_key(spark, d):
    filters = F.create_map(F.lit("source"), F.coalesce("source", F.lit("none")), F.lit("lang"), F.coalesce("lang", F.lit("none")))
    return table(spark, d, "documents").select("doc_id", governance.cache_key(F.col("n_chars").cast("string"), filters).alias("key"))


_KIND = "CASE WHEN turn % 3 = 0 THEN 'simple' WHEN turn % 3 = 1 THEN 'multi_hop' ELSE 'complex' END"


@query(f"SELECT conv_id, turn, CASE {_KIND} WHEN 'simple' THEN 3 WHEN 'multi_hop' THEN 10 ELSE 8 END AS top_k FROM conversations")
def adaptive_top_k(spark, d):
    kind = F.when(F.col("turn") % 3 == 0, "simple").when(F.col("turn") % 3 == 1, "multi_hop").otherwise("complex")
    return table(spark, d, "conversations").select("conv_id", "turn", governance.adapted(kind).alias("top_k"))


@query("""WITH t AS (SELECT a.conv_id, a.turn, len(regexp_extract_all(a.text, '\\S+')) AS x, len(regexp_extract_all(b.text, '\\S+')) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
p AS (SELECT *, CASE WHEN x <= 30 THEN x WHEN y <= 31 THEN least(x, 61 - y) ELSE 30 END AS n_first FROM t) SELECT conv_id, turn, n_first::INTEGER AS n_first, least(y, 61 - n_first)::INTEGER AS n_second FROM p""")
def pair_token_budget(spark, d):
    n = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    t = table(spark, d, "conversations").select("conv_id", "turn", n.alias("x"))
    met = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    a, b = governance.pair_budget(F.col("x"), F.col("y"), 64)
    return met.select("conv_id", "turn", a.alias("n_first"), b.alias("n_second"))


@query(f"WITH {_POST}, {_Q}, {_BM25} SELECT query, md5(string_agg('[Source ' || rank || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM bm25 JOIN documents ON doc_id = doc GROUP BY query")
def answer_prompt(spark, d):
    docs = table(spark, d, "documents")
    hits = search.bm25(docs, _bench(spark, d)).join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return answers.prompt(hits).select("query", F.md5(F.col("context").cast("binary")).alias("context"))
