"""Quantiles of groups of any size: sketches that are kept by period and merged, and the exact nearest rank beside them."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamfield.staging import staged

#: The size of sketches; at 400 a rank is told to about 0.7 % of the number of values.
SIZE = 400
# the cuts of a pass: which of the quantiles of so many equal steps are taken, counted from the rank that is looked for
_STEPS = 200
_AROUND = (-8, -3, -1, 0, 1, 3, 8)


def sketches(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by..., n, n_nan, least, most, sketch``: one row a group, which can be kept and merged with others. Nulls don't count;
    values are read as doubles; not-a-numbers stand above all others and outside the sketch (null where there is nothing else)."""
    v = F.col(value).cast("double") + F.lit(0.0)
    real = F.when(~F.isnan(v), v)
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(v)).alias("n_nan"), F.min(real).alias("least"), F.max(real).alias("most"),
        F.when(F.count(real) > 0, F.kll_sketch_agg_double(real, SIZE)).alias("sketch"),
    )


def merged(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of fewer and larger groups from kept ones."""
    some = F.kll_merge_agg_double("sketch", SIZE)
    return kept.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_nan").alias("n_nan"), F.min("least").alias("least"), F.max("most").alias("most"), F.when(F.count("sketch") > 0, some).alias("sketch")
    )


def about(kept: DataFrame, p: float, name: str = "about") -> DataFrame:
    """``kept`` with the quantile that its sketches tell, between the least and the greatest value, which are exact."""
    rank = F.lit(min(max(p, 0.0), 1.0))
    told = F.kll_sketch_get_quantile_double("sketch", rank)
    return kept.withColumn(name, F.when(F.col("sketch").isNotNull(), F.when(rank == 0, F.col("least")).when(rank == 1, F.col("most")).otherwise(told)))


def nearest_rank(df: DataFrame, by: str, value: str, ps: Sequence[float], kept: DataFrame | None = None, small: int = 100_000) -> DataFrame:
    """``by, p, n, value``: of each group and p the value at rank ceil(p n), at least 1, exactly.

    A pass cuts what is left of a group by values near the rank, which a sketch tells, counts below, at and between the cuts
    (some fifteen sums a group, added up before the shuffle), and keeps the part that holds the rank. A cut is a value of the
    group, so a part shrinks in every pass, to a hundredth or so, and a frequent value is found as a cut. Parts of at most
    ``small`` values end with a running sum. ``kept``: sketches of the groups, as of :func:`merged`, which save the first look.
    Groups of nulls alone are left out.
    """
    rows = df.select(F.col(by).alias("g"), (F.col(value).cast("double") + F.lit(0.0)).alias("v")).filter("v is not null")
    first = sketches(rows, ["g"], "v") if kept is None else kept.withColumnRenamed(by, "g")
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(Decimal(str(p))).cast("decimal(12,10)").alias("exact")) for p in ps]))
    rank = F.greatest(F.ceil(F.col("x.exact") * F.col("n").cast("decimal(20,0)")).cast("long"), F.lit(1))
    none = F.lit(None).cast("double")
    parts = first.select("g", "n", "n_nan", "sketch", wanted.alias("x")).select(
        "g", F.col("x.p").alias("p"), "n", rank.alias("r"), none.alias("lo"), none.alias("hi"), (F.col("n") - F.col("n_nan")).alias("left"), "sketch"
    )
    nan = F.when(F.col("r") > F.col("left"), F.lit(float("nan")))
    parts = staged(parts.withColumn("found", nan), "quantiles")  # r counts within what is left
    within = (F.isnull("lo") | (F.col("v") > F.col("lo"))) & (F.isnull("hi") | (F.col("v") < F.col("hi"))) & ~F.isnan("v")
    w = Window.partitionBy("g", "p").orderBy("cell")
    done = []
    while True:
        open_ = F.isnull("found") & (F.col("left") > small)
        done.append(parts.filter(~open_).drop("sketch"))
        large = parts.filter(open_)
        if large.isEmpty():
            break
        grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / _STEPS) for i in range(_STEPS + 1)]))
        step = F.floor(F.col("r") / F.col("left") * _STEPS).cast("int")
        near = F.array(*[F.get("grid", F.greatest(F.lit(0), F.least(F.lit(_STEPS), step + d))) for d in _AROUND])
        cut = large.withColumn("grid", grid).withColumn("cuts", F.array_sort(F.array_distinct(near))).drop("sketch", "grid")
        cut = staged(cut, "cuts")
        cell = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        met = _beside(rows, cut.select("g", "p", "lo", "hi", "cuts")).filter(within)
        counts = met.groupBy("g", "p", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
        placed = _beside(counts, cut, "p").withColumn("sum", F.sum("c").over(w))
        chosen = placed.filter((F.col("sum") >= F.col("r")) & (F.col("sum") - F.col("c") < F.col("r")))
        j = F.expr("cell div 2").cast("int")
        at_cut, at = F.col("cell") % 2 == 1, lambda i: F.get("cuts", i)
        parts = chosen.select(
            "g", "p", "n", (F.col("r") - F.col("sum") + F.col("c")).alias("r"),
            F.coalesce(F.when(j > 0, at(j - 1)), "lo").alias("lo"), F.coalesce(F.when(j < F.size("cuts"), at(j)), "hi").alias("hi"),
            F.col("c").alias("left"), F.when(at_cut, at(j)).alias("found"),
        )
        parts = staged(parts, "parts")
        going = parts.filter(open_)
        inner = _beside(rows, going.select("g", "p", "lo", "hi")).filter(within).groupBy("g", "p").agg(F.kll_sketch_agg_double("v", SIZE).alias("sketch"))
        parts = staged(_beside(parts, inner, "p", "left"), "sketched")
    ends = done[0]
    for x in done[1:]:
        ends = ends.unionByName(x)
    ends = staged(ends, "ends")
    last = _beside(rows, ends.filter("found is null").select("g", "p", "lo", "hi", "r")).filter(within).groupBy("g", "p", "r", "v").agg(F.count(F.lit(1)).alias("c"))
    run = last.withColumn("sum", F.sum("c").over(Window.partitionBy("g", "p").orderBy("v"))).filter("sum >= r and sum - c < r")
    out = _beside(ends, run.select("g", "p", "v"), "p", "left")
    return out.select(F.col("g").alias(by), "p", "n", F.coalesce("found", "v").alias("value"))


def _beside(a: DataFrame, b: DataFrame, also: str | None = None, how: str = "inner") -> DataFrame:
    """Joined on g, where null is a group, too (and on ``also``)."""
    b = b.withColumnsRenamed({"g": "g_", **({also: f"{also}_"} if also else {})})
    on = F.col("g").eqNullSafe(F.col("g_"))
    if also:
        on = on & (F.col(also) == F.col(f"{also}_"))
    return a.join(b, on, how).drop("g_", f"{also}_")
