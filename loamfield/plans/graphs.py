"""Queries about entities, relationships and communities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamfield.operators import communities, entities
from loamfield.plans.catalogue import _EDGES, _dense, _dense_sql, _trade
from loamfield.plans.registry import query
from loamfield.session import table
from loamfield.staging import staged

_MENTIONS = "m AS (SELECT o_orderkey AS place, CASE WHEN o_orderkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name, o_orderpriority AS type, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey::VARCHAR ELSE '' END AS description, o_custkey::DOUBLE AS rank, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS doc FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""WITH {_MENTIONS} SELECT upper(trim(name)) AS key, arg_min(name, place) AS name, arg_max(type, place) AS type, coalesce(string_agg(description, chr(10) ORDER BY place) FILTER (WHERE description <> ''), '') AS description,
arg_max(rank, place) AS rank, arg_max(doc, CASE WHEN doc IS NOT NULL THEN place END) AS doc FROM m GROUP BY 1""")
def entity_upsert(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    m = o.select(
        k.alias("place"), F.when(k % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"), F.col("o_orderpriority").alias("type"), F.when(k % 50 == 0, k.cast("string")).otherwise("").alias("description"),
        F.col("o_custkey").cast("double").alias("rank"), F.when(k % 3 > 0, k).alias("doc"),
    )
    return entities.upsert(m)


_WEIGHT = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN -value WHEN event_id % 7 = 2 THEN 'inf'::DOUBLE ELSE value END"


def _weights(spark, d):
    n = F.col("event_id") % 7
    w = F.when(n == 0, F.lit(None)).when(n == 1, -F.col("value")).when(n == 2, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", w.cast("double").alias("weight"))


@query(f"SELECT event_id, CASE WHEN w IS NOT NULL AND isfinite(w) AND w > 0 THEN least(w, 10.0) ELSE 1.0 END AS weight FROM (SELECT event_id, {_WEIGHT} AS w FROM events)")
def relationship_weights(spark, d):
    return _weights(spark, d).withColumn("weight", entities.weight_of(F.col("weight")))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE NOT coalesce(isfinite(w) AND w > 0, false)) AS replaced, count(*) FILTER (WHERE isfinite(w) AND w > 10) AS clamped, max(w) FILTER (WHERE isfinite(w)) AS most FROM (SELECT {_WEIGHT} AS w FROM events)")
def weight_audit(spark, d):
    return entities.weight_audit(_weights(spark, d))


@query(f"WITH {_EDGES} SELECT src, dst, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT dst, src FROM e WHERE src < 5) GROUP BY ALL")
def relationship_append(spark, d):
    e = _trade(spark, d)[1]
    both = entities.append(e, e.filter("src < 5").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT n_regionkey AS community FROM nation WHERE n_nationkey % 4 = 1")
def communities_of(spark, d):
    n = table(spark, d, "nation")
    return communities.of_entities(n.select(F.col("n_regionkey").alias("community"), F.col("n_nationkey").alias("node")), n.filter("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("node")))


@query("SELECT c_custkey AS node, c_nationkey AS community FROM customer")
def community_replace(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    return communities.replace_communities(c.filter("node % 2 = 0").withColumn("community", F.lit(0)), c)


@query("SELECT 'entities' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'relationships', count(*) FROM orders WHERE o_custkey <> 3")
def graph_delete(spark, d):
    e, r = entities.without([table(spark, d, "customer").withColumn("doc", F.col("c_nationkey")), table(spark, d, "orders").withColumn("doc", F.col("o_custkey"))], 3)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return count(e, "entities").unionByName(count(r, "relationships"))


@query("SELECT doc_id, doc_id % 3 = 1 AS routed FROM documents")
def graph_routing(spark, d):
    n = F.col("doc_id") % 3
    mine, rest = entities.routed(table(spark, d, "documents").select("doc_id", F.when(n == 1, "entity").when(n == 2, " ").alias("graph_type")))
    return mine.select("doc_id", F.lit(True).alias("routed")).unionByName(rest.select("doc_id", F.lit(False).alias("routed")))


@query(f"WITH {_dense_sql('AND b.label = 1')} SELECT * FROM dense")
def graph_typed_search(spark, d):
    from loamfield.operators import search

    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc")
    return search.dense(v.filter("label = 1"), v.filter("doc % 100 = 0").withColumnRenamed("doc", "query"))


@query(f"WITH {_dense_sql()} SELECT query, doc, round(0.75::DOUBLE * score + 0.25::DOUBLE * CASE WHEN doc % 3 > 0 THEN doc / 1000 ELSE 0 END, 9) AS score FROM dense")
def local_blend(spark, d):
    ranks = table(spark, d, "embeddings").filter("vec_id % 3 > 0").select(F.col("vec_id").alias("doc"), (F.col("vec_id") / 1000).alias("pagerank"))
    return entities.blended(_dense(spark, d), ranks, 0.25)


@query("SELECT query, community, ((row_number() OVER (PARTITION BY query ORDER BY md5(query || ':' || community), community) - 1) // 5)::INTEGER AS batch FROM (SELECT item_id AS query FROM benchmark), (SELECT n_nationkey AS community FROM nation)")
def report_batches(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"))
    return entities.batches(q.crossJoin(F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("community")))))  # every query reads the same few reports


@query(f"""WITH {_dense_sql(k=20)}, n AS (SELECT query, CASE WHEN doc % 2 = 0 THEN 'N' ELSE 'n' END || (doc % 7) AS name, rank FROM dense), o AS (SELECT query, arg_min(name, rank) AS name, min(rank) AS rank FROM n GROUP BY query, lower(name))
SELECT query, name, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM o""")
def selected_entities(spark, d):
    name = F.concat(F.when(F.col("doc") % 2 == 0, "N").otherwise("n"), (F.col("doc") % 7).cast("string"))
    return entities.selected(_dense(spark, d, 20).withColumn("name", name))


@query("""WITH m AS (SELECT c_nationkey AS community, sum(length(c_name) + 1) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING) AS run FROM customer),
u AS (SELECT community, count(*) FILTER (WHERE run <= 225) AS entities, coalesce(max(run) FILTER (WHERE run <= 225), 0) AS used, count(*) AS am FROM m GROUP BY community),
e AS (SELECT s_nationkey AS community, sum(length(s_name) + 1) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS run FROM supplier),
x AS (SELECT community, count(*) FILTER (WHERE run <= 300 - used) AS edges, count(*) AS ae FROM e JOIN u USING (community) GROUP BY community)
SELECT community, entities, coalesce(edges, 0) AS edges, am - entities + coalesce(ae - edges, 0) AS left_out FROM u LEFT JOIN x USING (community)""")
def community_prompts(spark, d):
    m = table(spark, d, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("score"), F.col("c_name").alias("line"))
    e = table(spark, d, "supplier").select(F.col("s_nationkey").alias("community"), F.col("s_suppkey").alias("place"), F.col("s_name").alias("line"))
    return entities.report_prompt(m, e, 300)


_SECTION = "CASE turn % 4 WHEN 0 THEN 'history' WHEN 1 THEN 'reports' WHEN 2 THEN 'sources' ELSE 'local' END"


@query(f"""WITH r AS (SELECT conv_id AS query, {_SECTION} AS section, turn AS place, sum(length(text)) OVER (PARTITION BY conv_id, {_SECTION} ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM conversations),
h AS (SELECT query, max(run) AS told FROM r WHERE section = 'history' AND run <= 3000 GROUP BY query), x AS (SELECT r.*, 3000 - coalesce(told, 0) AS room FROM r LEFT JOIN h USING (query))
SELECT query, section, place FROM x WHERE run <= CASE section WHEN 'history' THEN 3000 WHEN 'reports' THEN floor(room * 0.15::DOUBLE) WHEN 'sources' THEN floor(room * 0.5::DOUBLE) ELSE floor(room * (1 - (0.15::DOUBLE + 0.5::DOUBLE))) END""")
def context_sections(spark, d):
    n = F.col("turn") % 4
    section = F.when(n == 0, "history").when(n == 1, "reports").when(n == 2, "sources").otherwise("local")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query"), section.alias("section"), F.col("turn").alias("place"), F.length("text").alias("cost"))
    return entities.context(rows, 3000)


@query("SELECT conv_id, turn, conv_id || '_' || turn AS name, CASE WHEN turn % 2 = 0 THEN 'a_b_' || conv_id END AS doc, CASE WHEN turn % 2 = 0 THEN turn::INTEGER END AS idx FROM conversations")
def chunk_id_codec(spark, d):
    n = F.when(F.col("turn") % 2 == 0, entities.chunk_id(F.concat(F.lit("a_b_"), F.col("conv_id").cast("string")), F.col("turn"))).otherwise(F.lit("no_index_"))
    doc, index = entities.chunk_parts(n)
    return table(spark, d, "conversations").select("conv_id", "turn", entities.chunk_id(F.col("conv_id"), F.col("turn")).alias("name"), doc.alias("doc"), index.alias("idx"))


@query()
def leiden(spark, d):
    return communities.communities(_trade(spark, d)[1])


#: What customers buy: a graph that grows with the data. Parts have negative numbers.
_BUYS = "b AS (SELECT DISTINCT o_custkey AS src, -l_partkey - 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _buys(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst")).distinct()


@query(f"WITH {_BUYS} SELECT count(*) AS n_nodes, true AS connected, true AS gains FROM (SELECT src AS node FROM b UNION SELECT dst FROM b)")
def leiden_purchases(spark, d):
    """Every node has a community, every community is connected, and they beat the graph's components by far."""
    edges = staged(_buys(spark, d), "purchases")
    of = staged(communities.communities(edges, small=20_000), "communities")
    ends = lambda c, h: of.select(F.col("node").alias(c), F.col("community").alias(h))
    inner = edges.join(ends("src", "h1"), "src").join(ends("dst", "h2"), "dst").filter("h1 = h2").select("src", "dst")
    pieces = communities.components(of.select("node"), inner).select("component").distinct().count()
    kinds = of.select("community").distinct().count()
    q = communities.graph_modularity(edges, of)
    return of.agg(F.count(F.lit(1)).alias("n_nodes")).select("n_nodes", F.lit(pieces == kinds).alias("connected"), F.lit(q > 0.1).alias("gains"))
