"""Entity graphs as edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamfield.staging import staged


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree: times a node stands as source or target (a loop counts twice); nodes without edges have 0."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return nodes.join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbours(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """origin, node, hop: nodes within ``hops`` undirected steps of each start, the start left out.

    Links are written once, as they come, and met from both ends; what is made distinct is what a hop reaches, not all links.
    """
    links = staged(edges.select("src", "dst"), "links")
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = links.select(ends.alias("e")).select("e.src", "e.dst")
    seen = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("hop"))
    front = seen
    for h in range(1, hops + 1):
        front = front.select("origin", F.col("node").alias("src")).join(both, "src").select("origin", F.col("dst").alias("node")).distinct()
        front = front.join(seen, ["origin", "node"], "left_anti").withColumn("hop", F.lit(h))
        front = staged(front, "front") if h < hops else front  # else each hop would be computed again by all after it
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, least: float = 1e-6) -> DataFrame:
    """node, score: parallel edges count, loops and unknown ends don't, and nodes without targets share theirs with all. Ends
    after ``rounds``, or as soon as no score changes by ``least``.

    The links lie by source and each round's scores by node, so a round shuffles sums by target alone. A round is written;
    what comes to the driver of it is one row.
    """
    nodes = nodes.select("node").distinct()
    good = edges.filter("src <> dst").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    links = good.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    out = links.groupBy("src").agg(F.sum("c").alias("out"))
    moves = staged(links.join(out, "src").select("src", "dst", (F.col("c") / F.col("out")).alias("share")).repartition("src"), "moves")
    ends = moves.select(F.col("src").alias("node")).distinct().withColumn("out_", F.lit(True))
    score = staged(nodes.join(ends, "node", "left").select("node", F.col("out_").isNull().alias("end"), F.lit(1.0).alias("score")), "nodes")
    n, lost = score.agg(F.count(F.lit(1)), F.sum(F.when(F.col("end"), F.col("score")))).first()
    if not n:
        return score.select("node", "score")
    score, lost = score.withColumn("score", F.lit(1.0 / n)), (lost or 0.0) / n
    for _ in range(rounds):
        came = score.select(F.col("node").alias("src"), "score").join(moves, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("came"))
        now = (1 - damping) / n + damping * (F.coalesce("came", F.lit(0.0)) + F.lit(lost / n))
        moved = staged(score.join(came, "node", "left").select("node", "end", now.alias("score"), F.abs(now - F.col("score")).alias("change")), "pagerank")
        lost, change = moved.agg(F.coalesce(F.sum(F.when(F.col("end"), F.col("score"))), F.lit(0.0)), F.max("change")).first()
        score = moved.drop("change")
        if change < least:
            break
    return score.select("node", "score")


def incident(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with an end among ``chosen`` (node), each once."""
    ends = [edges.join(chosen.select(F.col("node").alias(c)), c, "left_semi").select(edges.columns) for c in ("src", "dst")]
    return ends[0].unionByName(ends[1]).distinct()


def rank_edges(edges: DataFrame, chosen: DataFrame, degree: DataFrame, k: int = 10) -> DataFrame:
    """src, dst, inside, rank: edges between chosen nodes by the sum of degrees, then those that leave, by how many chosen
    nodes their outer end meets and the sum of degrees; of these, k for each chosen node where there are two or more."""
    mark = lambda c: chosen.select(F.col("node").alias(c), F.lit(1).alias(f"in_{c}"))
    weight = lambda c: degree.select(F.col("node").alias(c), F.col("degree").alias(f"deg_{c}"))
    e = incident(edges.select("src", "dst"), chosen).join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    e = e.join(weight("src"), "src", "left").join(weight("dst"), "dst", "left").fillna(0)
    e = e.withColumns({"inside": F.col("in_src") + F.col("in_dst") == 2, "sum_": F.col("deg_src") + F.col("deg_dst")})
    outer = e.withColumns({"outer": F.when(F.col("in_src") == 1, F.col("dst")).otherwise(F.col("src")), "mine": F.when(F.col("in_src") == 1, F.col("src")).otherwise(F.col("dst"))})
    met = outer.filter("not inside").groupBy("outer").agg(F.countDistinct("mine").alias("partners"))
    e = outer.join(met, "outer", "left").withColumn("partners", F.when(F.col("inside"), 0).otherwise(F.col("partners")))
    most = chosen.count() * k
    order = [F.desc("partners"), F.desc("sum_"), F.asc("src"), F.asc("dst")]
    w = Window.partitionBy("inside").orderBy(*order)
    inner = e.filter("inside").withColumn("rank", F.row_number().over(w))  # edges among the chosen
    outer = e.filter("not inside").orderBy(*order).limit(most).withColumn("rank", F.row_number().over(w))  # each task keeps ``most``
    return inner.unionByName(outer).select("src", "dst", "inside", "rank")


def chunk_order(cited: DataFrame) -> DataFrame:
    """chunk, entity, n from ``cited`` (place, entity, chunk, n): each chunk stands with the first entity that has it."""
    return cited.groupBy("chunk").agg(F.min_by(F.struct("entity", "n"), F.struct("place", "entity")).alias("x")).select("chunk", "x.entity", "x.n")


def order_communities(members: DataFrame, reports: DataFrame, chosen: DataFrame) -> DataFrame:
    """community, n_chosen, rank: communities (community, report) by how many chosen nodes they hold; blank reports are skipped."""
    n = members.join(chosen, "node", "left_semi").distinct().groupBy("community").agg(F.count(F.lit(1)).alias("n_chosen"))
    told = reports.filter(F.trim(F.coalesce("report", F.lit(""))) != "").select("community").join(n, "community")
    return told.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chosen"), "community")))  # a row for each community met
