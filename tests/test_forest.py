"""Mixtures and trees over tables."""

import numpy as np
from pyspark.sql import functions as F

from loamfield.operators import forest, mixtures, tree


def _vectors(spark, x, more=()):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(more), "id long, embedding array<double>")


def test_mixture_equals_one_task(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in (-3, 0, 3)]) + 1000
    table = mixtures.usable(_vectors(spark, x, [(900, None), (901, [1.0]), (902, [None, 1.0, 2.0])]), 3).repartition(3).persist()
    starts = [x[[5]], x[[5, 100]], x[[5, 70, 150]]]
    for start, m in zip(starts, mixtures.fit(table, 3, starts, rounds=25), strict=True):
        r, criterion = tree.mixture(x - 1000, len(start), rounds=25, start=start - 1000)
        assert abs(m.criterion - criterion) < 1e-4
        got = {r.id: r.cluster for r in mixtures.assign(table, 3, m).collect()}
        assert [got[i] for i in range(len(x))] == r.argmax(axis=1).tolist()
    assert m.criterion < 1300
    centres = mixtures.spread_centres(table, 3, 3)
    assert len({int(np.abs(x - c).sum(axis=1).argmin()) // 60 for c in centres}) == 3


def test_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) * [5, 3, 1, 0.5, 0.2, 0.1] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    table = _vectors(spark, x)
    mean, axes = mixtures.components(table, 6, 3)
    got = np.array([r.embedding for r in mixtures.projected(table, 6, mean, axes).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(tree.reduced(x, 3)))


def test_trees_are_rebuilt_by_scope(spark):
    rng = np.random.default_rng(3)
    store = forest.create(spark)
    kind = "scope string, doc long, id long, text string, embedding array<double>"
    rows = lambda scope, at, n: [(scope, at + i // 4, 100 * at + i, f"{scope}{i}", [float(v) for v in rng.normal((i % 2) * 6, 0.3, 3)]) for i in range(n)]
    forest.put_leaves(spark, store, spark.createDataFrame(rows("a", 0, 24) + rows("b", 50, 8), kind))
    summarise = lambda t: t.select("cluster", F.concat(F.lit("about "), F.substring("text", 1, 9)).alias("text"))
    embed = lambda t: t.select("id", F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("embedding"))
    assert forest.rebuild(spark, store, "a", summarise, embed, rounds=10, most=2) == 26
    forest.rebuild(spark, store, "b", summarise, embed, rounds=10, most=2)
    got = forest.nodes(spark, store, "a").collect()
    leaves = [r for r in got if r.level == 0]
    assert len(leaves) == 24 and {r.parent for r in leaves} == {r.id for r in got if r.level == 1} and len({(r.id % 2, r.parent) for r in leaves}) == 2
    assert all(r.text.startswith("about a") for r in got if r.level == 1)
    forest.drop_leaves(spark, store, spark.createDataFrame([(50,), (51,), (1,)], "doc long"))
    forest.put_leaves(spark, store, spark.createDataFrame(rows("a", 0, 3), kind))  # document 0 is put anew, with three leaves
    assert forest.leaves(spark, store, "a").filter("id is not null").count() == 24 - 4 - 4 + 3
    before = sorted(r.id for r in forest.nodes(spark, store, "a").collect())
    assert forest.rebuild(spark, store, "b", summarise, embed) == 0
    assert forest.nodes(spark, store, "b").count() == 0 and sorted(r.id for r in forest.nodes(spark, store, "a").collect()) == before
    assert forest.rebuild(spark, store, "a", summarise, embed, rounds=10, most=2) == 19 + 2
