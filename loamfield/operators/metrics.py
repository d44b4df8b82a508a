"""Ranking quality, latency and comparison statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ir_metrics(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query, ndcg, recall, mrr, precision, map at k. ``qrels``: query, doc, grade; queries without a positive grade are left out,
    queries without hits score 0."""
    good = qrels.filter("grade > 0")
    ideal = good.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc")))
    ideal = ideal.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 1))).alias("ideal"))
    met = hits.filter(F.col("rank") <= k).join(good, ["query", "doc"])
    met = met.withColumn("seen", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    got = met.groupBy("query").agg(
        F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"), F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.col("seen") / F.col("rank")).alias("ap")
    )
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return ideal.join(got, "query", "left").select(
        "query", z(F.col("dcg") / F.col("ideal")).alias("ndcg"), z(F.col("hits") / F.col("relevant")).alias("recall"), z(1 / F.col("first")).alias("mrr"),
        z(F.col("hits") / F.lit(k)).alias("precision"), z(F.col("ap") / F.least(F.lit(k), F.col("relevant"))).alias("map"),
    )


def percentile(df: DataFrame, by: str, value: str, p: float, name: str) -> DataFrame:
    """Nearest rank: the value at ceil(p n)."""
    return df.groupBy(by).agg(F.expr(f"percentile_disc({p}) within group (order by {value})").alias(name))


def bootstrap(df: DataFrame, value: str, rounds: int = 1000, trim: float = 0.025) -> DataFrame:
    """``low, high`` of the resampled mean; the i-th draw of a round is chosen by a hash, so equal input gives equal bounds.

    ``df`` is a table of per-query scores. Each value is numbered; a round draws n numbers.
    """
    n = df.count()
    numbered = df.select(F.col(value).alias("v"), (F.row_number().over(Window.orderBy(value)) - 1).alias("i"))
    draws = df.sparkSession.range(rounds).select(F.col("id").alias("round"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("k"))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", "round", "k").cast("binary")), 1, 12), 16, 10).cast("long") % max(n, 1)
    means = draws.select("round", at.cast("int").alias("i")).join(numbered, "i").groupBy("round").agg(F.avg("v").alias("m"))
    r = means.withColumn("r", F.row_number().over(Window.orderBy("m")))
    cut = int(trim * rounds)
    return r.agg(F.round(F.max(F.when(F.col("r") == cut + 1, F.col("m"))), 6).alias("low"), F.round(F.max(F.when(F.col("r") == rounds - cut, F.col("m"))), 6).alias("high"))


def slice_walk(qrels: DataFrame, least: int = 60) -> DataFrame:
    """query, n_new, n_docs: queries in ascending order until ``least`` distinct relevant documents are gathered.

    The running sum sees one row for each judged query, never the judgements themselves.
    """
    fresh = qrels.filter("grade > 0").groupBy("doc").agg(F.min("query").alias("query")).groupBy("query").agg(F.count(F.lit(1)).alias("n_new"))
    every = qrels.select("query").distinct().join(fresh, "query", "left").fillna(0, ["n_new"])
    run = F.sum("n_new").over(Window.orderBy("query").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return every.withColumn("n_docs", run).filter(F.col("n_docs") - F.col("n_new") < least)


def repeat_gate(timings: DataFrame, most: float = 3.0) -> DataFrame:
    """n_runs, spread, same_queries, passes for ``timings`` (run, query, ms): two runs or more, over the same queries, whose
    medians differ by a factor of ``most`` at most."""
    runs = percentile(timings, "run", "ms", 0.5, "p50").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.max("p50") / F.min("p50"), 6).alias("spread"))
    shared = timings.groupBy("query").agg(F.countDistinct("run").alias("c")).agg(F.min("c").alias("least"))
    same = F.col("least") == F.col("n_runs")
    return runs.crossJoin(shared).select("n_runs", "spread", same.alias("same_queries"), (same & (F.col("n_runs") > 1) & (F.col("spread") <= most)).alias("passes"))  # one row each


def rollup(scores: DataFrame, names: list[str]) -> DataFrame:
    """metric, mean, unscoreable of each column, and the mean of the means that exist as ``overall``."""
    one = scores.unpivot([], names, "metric", "value").groupBy("metric").agg(F.avg("value").alias("mean"), F.count_if(F.col("value").isNull()).alias("unscoreable"))
    total = one.agg(F.lit("overall").alias("metric"), F.avg("mean").alias("mean"), F.sum("unscoreable").alias("unscoreable"))
    return one.unionByName(total).select("metric", F.round("mean", 6).alias("mean"), "unscoreable")


def answer_match(a: F.Column, b: F.Column) -> tuple[F.Column, F.Column]:
    """Whether two answers share a lower-cased word, and whether they are equal but for case, punctuation and spaces."""
    bare = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}]+", " "))
    word = lambda x: F.array_remove(F.split(F.lower(x), "[ \\n\\t]+"), "")
    return F.arrays_overlap(word(a), word(b)), bare(a) == bare(b)


def distance(pairs: DataFrame) -> DataFrame:
    """``id, score`` of pairs of vectors (id, a, b): their cosine, 0 where a length is 0 or sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot("a", "a") * dot("b", "b"))
    return pairs.select("id", F.when((F.size("a") == F.size("b")) & (norm > 0), dot("a", "b") / norm).otherwise(0.0).alias("score"))


def ab_report(results: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """One row about two variants' results (sample, variant a or b, score, ms): pairs, those that both score, their means,
    wins, ties within ``epsilon``, and the mean difference of times. A pair that lacks a score is not compared."""
    side = lambda v: results.filter(F.col("variant") == v).select("sample", F.col("score").alias(v), F.col("ms").alias(f"ms_{v}"))
    p = side("a").join(side("b"), "sample")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return p.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(both).alias("n_comparable"), F.round(F.avg(F.when(both, F.col("a"))), 6).alias("mean_a"), F.round(F.avg(F.when(both, F.col("b"))), 6).alias("mean_b"),
        F.count_if(F.col("b") - F.col("a") > epsilon).alias("wins_b"), F.count_if(F.col("a") - F.col("b") > epsilon).alias("wins_a"), F.count_if(F.abs(F.col("a") - F.col("b")) <= epsilon).alias("ties"),
        F.round(F.avg(F.col("ms_b") - F.col("ms_a")), 6).alias("ms_delta"),
    )


def accuracy(answers: DataFrame) -> DataFrame:
    """``question_type, n, accuracy`` of answers (question_type, right), and of ``all``."""
    return answers.rollup("question_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("right").cast("int")), 6).alias("accuracy"), F.grouping("question_type").alias("g")).select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("question_type")).alias("question_type"), "n", "accuracy"
    )


def corpus(docs: DataFrame, chosen: DataFrame | None, key: str, most: int | None = None) -> DataFrame:
    """``key, place``: the chosen documents of a corpus in its order, or its first ``most``. A slice is small."""
    d = docs.select(key) if chosen is None else docs.select(key).join(chosen.select(key).distinct(), key, "left_semi")
    d = d.orderBy(key).limit(most) if most is not None else d
    return d.withColumn("place", F.row_number().over(Window.orderBy(key)))


def timings(records: DataFrame) -> DataFrame:
    """``query, stage, n, ms`` of JSON records (body): query and its stages' times. Negative times are an error."""
    r = records.select(F.from_json("body", "query long, stages array<struct<stage: string, ms: double>>", {"mode": "FAILFAST"}).alias("r")).select("r.query", F.explode("r.stages").alias("s"))
    ms = F.when(F.col("s.ms") >= 0, F.col("s.ms")).otherwise(F.raise_error(F.lit("a negative time")).cast("double"))
    return r.select("query", "s.stage", ms.alias("ms")).groupBy("query", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ms"), 2).alias("ms"))
