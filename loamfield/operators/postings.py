"""A BM25 index that is kept: postings by term, which grow and shrink with the documents.

A change is a batch with a number. It writes postings, document rows and counts of its own beside those that are there, and
at last a row in ``log`` that makes the batch count; readers take only batches of the log, so that a change that failed half
way, or runs again, leaves nothing behind. Adding a document writes its postings alone. Removing one reads its terms from
the document rows, writes a count less for each, and names the postings that no longer hold; they are left out by readers
and dropped by :func:`compact`. Document frequencies and the mean length are sums of the counts that changes wrote.

Tables: ``postings`` (term, doc, tf, len) by batch and bucket of the term; ``docs`` (doc, len, terms, tfs) by batch and bucket of
the document, from which a batch's postings and counts are made; ``counts`` (term, n) by batch and bucket; ``gone`` (doc, before) by batch; ``log`` (batch, n, total).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamfield.functions.text import tokens
from loamfield.operators.search import K1, MOST_TERMS, B, bm25_weight, dealt, small, top
from loamfield.session import spread
from loamfield.staging import fresh_dir, staged

_SCHEMA = {
    "postings": "term string, doc long, tf long, len int, batch int, bucket int",
    "docs": "doc long, len int, terms array<string>, tfs array<int>, batch int, bucket int",
    "counts": "term string, n long, batch int, bucket int",
    "gone": "doc long, before int, batch int",
    "log": "n long, total long, batch int",
}


#: Documents that are gone, as ids and batches: so many at most are broadcast, more are joined by shuffle.
MOST_GONE = 2_000_000


@dataclass
class Index:
    """An index in a folder; ``buckets`` is fixed when it is made."""

    path: str
    buckets: int = 16


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _table(spark: SparkSession, index: Index, name: str, batches: list[int] | None) -> DataFrame:
    """Rows of the batches that count."""
    if not _exists(spark, f"{index.path}/{name}"):
        return spark.createDataFrame([], _SCHEMA[name])
    rows = spark.read.schema(_SCHEMA[name]).parquet(f"{index.path}/{name}")
    return rows if batches is None else rows.filter(F.col("batch").isin(batches))


def _write(df: DataFrame, index: Index, name: str, batch: int) -> None:
    """A batch's part of a table; what an attempt before wrote goes. Buckets lie together, sorted, but for those that are so
    large (a word of every text, say) that they are split."""
    if "bucket" in df.columns:
        df = df.hint("rebalance", "bucket").sortWithinPartitions("bucket", *[c for c in ("term", "doc") if c in df.columns])
    parts = df.write.mode("overwrite").option("compression", "zstd")
    (parts.partitionBy("bucket") if "bucket" in df.columns else parts).parquet(f"{index.path}/{name}/batch={batch}")


def log(spark: SparkSession, index: Index) -> list[tuple[int, int, int]]:
    """(batch, documents more or less, tokens more or less) of each change, in order."""
    return sorted((r.batch, r.n, r.total) for r in _table(spark, index, "log", None).collect())


def _bucket(index: Index, c: str):
    return F.pmod(F.xxhash64(c), F.lit(index.buckets)).cast("int").alias("bucket")


def create(spark: SparkSession, path: str | None = None, buckets: int = 16) -> Index:
    return Index(path or fresh_dir(spark, "postings"), buckets)


def _commit(spark: SparkSession, index: Index, batch: int, n: int, total: int) -> None:
    spark.createDataFrame([(n, total)], "n long, total long").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/log/batch={batch}")


def _alive(spark: SparkSession, index: Index, rows: DataFrame, batches: list[int]) -> DataFrame:
    """``rows`` (doc, batch and others) without those that a later batch took out."""
    gone = _table(spark, index, "gone", batches).groupBy("doc").agg(F.max("before").alias("before"))
    gone = F.broadcast(gone) if gone.limit(MOST_GONE + 1).count() <= MOST_GONE else gone
    return rows.join(gone, "doc", "left").filter("before is null or batch >= before").drop("before")


def _held(spark: SparkSession, index: Index, docs: DataFrame, batches: list[int]) -> DataFrame:
    """doc, len, terms, batch of those of ``docs`` (doc) that the index holds."""
    docs = docs.select("doc").filter("doc is not null").distinct().select("doc", _bucket(index, "doc"))
    rows = _table(spark, index, "docs", batches).drop("tfs").join(docs, ["bucket", "doc"], "left_semi")
    return _alive(spark, index, rows, batches).select("doc", "len", "terms", "batch")


def _once(added: DataFrame) -> DataFrame:
    """doc, text: of a repeated id the greatest text. Texts of other ids stay where they are; ids alone are shuffled."""
    new = added.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    again = staged(new.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc"), "repeated")
    if not again.limit(1).count():
        return new
    return new.join(again, "doc", "left_anti").unionByName(new.join(again, "doc", "left_semi").groupBy("doc").agg(F.max("text").alias("text")))


def _counted(docs: DataFrame) -> DataFrame:
    """doc, len, terms, tfs: the distinct tokens of each text in order, and how often each stands there, within the row."""
    s = spread(docs, "doc").select("doc", F.sort_array(tokens(F.col("text"))).alias("s"))
    s = s.withColumn("at", F.expr("filter(transform(s, (v, i) -> if(i = 0 or v <> s[i - 1], i, null)), i -> i is not null)"))
    terms, tfs = F.expr("transform(at, i -> s[i])"), F.expr("transform(at, (i, j) -> coalesce(get(at, j + 1), size(s)) - i)")
    return s.select("doc", F.size("s").alias("len"), terms.alias("terms"), tfs.alias("tfs"))


def change(spark: SparkSession, index: Index, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
    """One batch: ``added`` documents (doc_id, text) are put in, in place of those of their ids, and ``removed`` ones (doc_id)
    taken out; ids that aren't there change nothing. Gives the batch's number.

    Rows without an id are skipped; of a repeated id, the greatest text counts. Texts without tokens are documents of length 0.
    Only these documents' postings and rows are read or written.
    """
    done = log(spark, index)
    batches = [b for b, _, _ in done]
    batch = (batches[-1] if batches else 0) + 1
    n = total = 0
    counts = []
    ids = [t.select(F.col("doc_id").cast("long").alias("doc")) for t in (added, removed) if t is not None]
    if batches and ids:
        ids = ids[0].unionByName(ids[1]) if len(ids) > 1 else ids[0]
        held = staged(_held(spark, index, ids, batches), "held")
        lost, length = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        n, total = n - lost, total - length
        counts.append(held.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("n")))
        _write(held.select("doc", F.lit(batch).alias("before")).distinct(), index, "gone", batch)
    if added is not None:
        _write(_counted(_once(added)).select("doc", "len", "terms", "tfs", _bucket(index, "doc")), index, "docs", batch)
        rows = _table(spark, index, "docs", [batch])
        found = rows.select("doc", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), "doc", F.col("x.tfs").cast("long").alias("tf"), "len")
        _write(found.select("term", "doc", "tf", "len", _bucket(index, "term")), index, "postings", batch)
        more, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        n, total = n + more, total + length
        counts.append(rows.select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("n")))
    if counts:
        every = counts[0].unionByName(counts[1]) if len(counts) > 1 else counts[0]
        every = every.groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0")
        _write(every.select("term", "n", _bucket(index, "term")), index, "counts", batch)
    _commit(spark, index, batch, n, total)
    return batch


def add(spark: SparkSession, index: Index, docs: DataFrame) -> int:
    return change(spark, index, added=docs)


def remove(spark: SparkSession, index: Index, docs: DataFrame) -> int:
    return change(spark, index, removed=docs)


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """query, doc, score, rank of queries (query, text), as of a fresh index over the documents it holds: equal to
    :func:`loamfield.operators.search.bm25`. Only buckets of the queries' terms are read."""
    done = log(spark, index)
    batches, n, total = [x for x, _, _ in done], sum(x for _, x, _ in done), sum(x for _, _, x in done)
    q, few = small(queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).distinct(), MOST_TERMS)
    terms = q.select("term").distinct().select("term", _bucket(index, "term"))
    buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]  # as many as the index has, at most
    wanted = few(terms.select("term"))
    df = _table(spark, index, "counts", batches).filter(F.col("bucket").isin(buckets)).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    met = _table(spark, index, "postings", batches).filter(F.col("bucket").isin(buckets)).join(wanted, "term", "left_semi")
    met = _alive(spark, index, met, batches)
    gain = bm25_weight(F.lit(n), F.col("df"), F.col("tf"), F.col("len"), F.lit(total / max(n, 1)), k1, b)
    scored = met.join(few(df), "term").select("doc", "term", gain.alias("s")).repartition(dealt(n, q), "doc")
    hits = scored.join(few(q), "term").groupBy("query", "doc").agg(F.round(F.sum("s"), 6).alias("score"))
    return top(hits, ["query"], "score", "doc", k)


def compact(spark: SparkSession, index: Index, path: str | None = None) -> Index:
    """A fresh index with the documents of this one in a single batch; this one stays as it is until its readers have moved."""
    done = log(spark, index)
    batches = [x for x, _, _ in done]
    new = create(spark, path, index.buckets)
    if not batches:
        return new
    for name in ("postings", "docs"):
        rows = _alive(spark, index, _table(spark, index, name, batches), batches)
        _write(rows.drop("batch", "tfs"), new, name, 1)  # counts by text serve the change alone that writes them
    counts = _table(spark, index, "counts", batches).groupBy("term", "bucket").agg(F.sum("n").alias("n")).filter("n <> 0")
    _write(counts, new, "counts", 1)
    _commit(spark, new, 1, sum(x for _, x, _ in done), sum(x for _, _, x in done))
    return new
