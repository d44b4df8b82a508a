"""Sketches and exact ranks against sorted lists."""

import math
import random

import pytest

from loamfield.operators import quantiles

PS = [0.0, 0.07, 0.5, 0.9, 0.99, 1.0]


def ranked(values, p):
    from decimal import ROUND_CEILING, Decimal

    r = max(1, int((Decimal(str(p)) * len(values)).to_integral_value(ROUND_CEILING)))
    return sorted(values, key=lambda v: (math.isnan(v), v))[r - 1]


def table(spark):
    rng = random.Random(5)
    groups = {
        "even": [rng.random() for _ in range(3000)],
        "heavy": [1.0] * 900 + [2.0] * 1100 + [rng.random() * 4 for _ in range(500)],
        "two": [1.0, 2.0] * 700,
        "one": [4.0],
        "ends": [float("inf")] * 50 + [float("-inf")] * 60 + [rng.gauss(0, 1e9) for _ in range(700)],
        "nan": [float("nan")] * 3,
        "some nan": [float("nan")] * 40 + [float(i) for i in range(400)],
        None: [-0.0, 0.0, 5.0] * 100,
    }
    rows = [(g, i % 7, v) for g, vs in groups.items() for i, v in enumerate(vs)] + [("even", 0, None), ("nothing", 0, None)]
    rng.shuffle(rows)
    return groups, spark.createDataFrame(rows, "g string, day int, v double").repartition(4)


@pytest.mark.parametrize("small", [0, 25, 100_000])
def test_nearest_rank(spark, small):
    groups, df = table(spark)
    kept = quantiles.merged(quantiles.sketches(df, ["g", "day"], "v"), ["g"]) if small == 25 else None
    got = {(r.g, r.p): (r.n, r.value) for r in quantiles.nearest_rank(df, "g", "v", PS, kept, small).collect()}
    assert len(got) == len(groups) * len(PS)
    for g, vs in groups.items():
        for p in PS:
            n, v = got[g, p]
            want = ranked(vs, p)
            assert n == len(vs) and (v == want or math.isnan(v) and math.isnan(want)), (g, p, v, want)


def test_sketches(spark):
    groups, df = table(spark)
    merged = quantiles.about(quantiles.merged(quantiles.sketches(df, ["g", "day"], "v"), ["g"]), 0.5)
    got = {r.g: r for r in merged.collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        r, real = got[g], sorted(v for v in vs if not math.isnan(v))
        assert r.n == len(vs) and r.n_nan == len(vs) - len(real)
        if real:
            assert (r.least, r.most) == (real[0], real[-1])
            lo, hi = sum(v < r.about for v in real), sum(v <= r.about for v in real)
            assert lo - 0.03 * len(real) - 1 <= len(real) / 2 <= hi + 0.03 * len(real) + 1
        else:
            assert r.sketch is None and r.about is None
    empty = df.limit(0)
    assert quantiles.sketches(empty, ["g"], "v").count() == 0 and quantiles.nearest_rank(empty, "g", "v", [0.5]).count() == 0
