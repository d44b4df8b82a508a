"""Queries of kept indexes: postings that grow and shrink, and inverted files of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamfield.operators import cells, forest, mixtures, postings
from loamfield.plans.catalogue import _BM25, _Q, TOK, _bench, _dense, _dense_sql
from loamfield.plans.registry import query
from loamfield.session import table


def _over(where: str) -> str:
    return f"""WITH t AS (SELECT doc_id AS doc, {TOK} AS t FROM documents WHERE {where}), e AS (SELECT doc, len(t) AS len, unnest(t) AS term FROM t),
tf AS (SELECT doc, term, count(*) AS tf, any_value(len) AS len FROM e GROUP BY ALL), {_Q}, {_BM25} SELECT * FROM bm25"""


def _changed(spark, d):
    """An index after adding, removing and adding again, some of it in place of what was there."""
    docs, index = table(spark, d, "documents").select("doc_id", "text"), postings.create(spark)
    postings.add(spark, index, docs.filter("doc_id % 10 <> 3"))
    postings.remove(spark, index, docs.filter("doc_id % 7 = 0").select("doc_id"))
    postings.change(spark, index, added=docs.filter("doc_id % 10 = 3 or doc_id % 14 = 0 or doc_id % 5 = 1"), removed=docs.filter("doc_id % 11 = 5").select("doc_id"))
    return index


_LEFT = "doc_id % 10 = 3 OR doc_id % 14 = 0 OR doc_id % 5 = 1 OR (doc_id % 10 <> 3 AND doc_id % 7 <> 0 AND doc_id % 11 <> 5)"


@query(_over(_LEFT))
def bm25_index_changes(spark, d):
    return postings.search(spark, _changed(spark, d), _bench(spark, d))


@query(_over(_LEFT))
def bm25_index_compacted(spark, d):
    return postings.search(spark, postings.compact(spark, _changed(spark, d)), _bench(spark, d))


@query(f"""WITH t AS (SELECT doc_id, {TOK} AS t FROM documents WHERE {_LEFT}) SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM t) GROUP BY term""")
def bm25_index_counts(spark, d):
    index = _changed(spark, d)
    batches = [b for b, _, _ in postings.log(spark, index)]
    return postings._table(spark, index, "counts", batches).groupBy("term").agg(F.sum("n").alias("df")).filter("df <> 0")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")


def _asked(spark, d):
    return _vectors(spark, d).filter("doc % 100 = 0").withColumnRenamed("doc", "query")


@query()
def cell_topk(spark, d):
    """A quarter of the cells is visited."""
    index = cells.build(_vectors(spark, d))
    return cells.search(index, _asked(spark, d), probes=-(-len(index.centroids) // 4))


@query(f"WITH {_dense_sql()} SELECT * FROM dense")
def cell_topk_all_cells(spark, d):
    index = cells.build(_vectors(spark, d))
    return cells.search(index, _asked(spark, d), probes=len(index.centroids))


@query("SELECT (SELECT count(*) FROM embeddings) AS n_rows, count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def cell_recall(spark, d):
    """All rows are indexed, and three quarters of the cells give nine of ten exact neighbours even of vectors without clusters."""
    index = cells.build(_vectors(spark, d))
    n = index.rows(spark).select("doc").distinct().count()
    got = cells.recall(cells.search(index, _asked(spark, d), probes=-(-len(index.centroids) * 3 // 4)), _dense(spark, d))
    return got.select(F.lit(n).cast("long").alias("n_rows"), "n_queries", (F.col("recall") >= 0.9).alias("reached"))


@query(f"WITH {_dense_sql('AND b.vec_id % 7 <> 3')} SELECT * FROM dense")
def cell_changes(spark, d):
    """Rows that come later, and rows that go, some of them to come back."""
    v = _vectors(spark, d)
    index = cells.build(v.filter("doc % 5 <> 1"))
    cells.add(index, v.filter("doc % 5 = 1"), 1)
    cells.remove(index, v.filter("doc % 7 = 3 or doc % 6 = 1").select("doc"), 2)
    cells.add(index, v.filter("doc % 6 = 1 and doc % 7 <> 3"), 3)
    return cells.search(index, _asked(spark, d), probes=len(index.centroids))


@query(f"WITH {_dense_sql('AND a.vec_id <> b.vec_id', 5).replace('a.vec_id % 100 = 0', 'true')} SELECT query AS src, doc AS dst, rank, score FROM dense")
def neighbour_graph(spark, d):
    v = _vectors(spark, d)
    index = cells.build(v)
    return cells.neighbours(index, v, 5, probes=len(index.centroids))


@query("SELECT vec_id AS id, 0 AS level, 1 AS n_parents FROM embeddings")
def tree_leaves(spark, d):
    """Every leaf of a tree of summaries over all vectors has one parent, on the level above."""
    leaf = table(spark, d, "embeddings").select(F.lit("all").alias("scope"), F.col("label").alias("doc"), F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), "embedding")
    store = forest.create(spark)
    forest.put_leaves(spark, store, leaf)
    told = lambda t: t.select("cluster", F.substring("text", 1, 80).alias("text"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda i: F.conv(F.substr(F.md5(F.col("text").cast("binary")), i, F.lit(2)), 16, 10).cast("double"))
    forest.rebuild(spark, store, "all", told, lambda t: t.select("id", digits.alias("embedding")), rounds=8)
    nodes = forest.nodes(spark, store, "all")
    up = nodes.select(F.col("id").alias("parent"), F.col("level").alias("above"))
    met = nodes.filter("level = 0").join(up, "parent", "left").filter("above = level + 1")
    return met.groupBy("id", "level").agg(F.count(F.lit(1)).cast("int").alias("n_parents"))


@query("SELECT count(*) AS n_rows, true AS rises FROM embeddings")
def mixture_fit(spark, d):
    """All rows weigh one in the fit, and its likelihood is above that of one component."""
    v = mixtures.usable(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 64)
    one, four = mixtures.fit(v, 64, [mixtures.spread_centres(v, 64, k) for k in (1, 4)], rounds=8)
    return mixtures.assign(v, 64, four).agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(four.likelihood > one.likelihood).alias("rises"))
