"""Windows of words by expressions against the loop over tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loamfield.operators import semantic


@pytest.mark.parametrize(("size", "overlap"), [(16, 4), (5, 4), (3, 1), (200, 150), (1, 0), (7, 0)])
def test_word_windows_against_the_loop(spark, size, overlap):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abüx.\U0001f600") for _ in range(rng.randint(1, 9)))
    texts = [rng.choice(["", " ", "\n\t"]) + "".join(word() + rng.choice([" ", "  ", "\n"]) for _ in range(n)) for n in [1, 2, 12, 16, 63, 64, 65, 66, 128, 129, 1000]]
    texts += ["", None, " \n", "x", "\U0001f600 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in df.select("text", semantic.word_windows(F.col("text"), size, overlap).alias("w")).collect():
        spans = [m.span() for m in re.finditer(r"\S+", r.text or "")]
        want = semantic.token_windows(len(r.text or ""), spans, size, overlap)
        if not overlap:  # these begin and end with words too
            want = [(spans[i][0], spans[min(i + size, len(spans)) - 1][1]) for i in range(0, len(spans), size)]
        assert [(w.start_pos, w.end_pos) for w in r.w] == ([] if not spans else want)


def test_word_windows_part_a_text_once(spark):
    """Words were found, and all places counted, again for each window."""
    got = semantic.word_windows(F.col("text"), 16, 4).alias("w")
    plan = spark.createDataFrame([("a",)], "text string").select(got)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    long = spark.range(1).select(F.repeat(F.lit("ab cde "), 50_000).alias("text")).select(F.size(got).alias("n"), F.element_at(got, -1).alias("last")).first()
    assert long.n == 8333 and (long.last.start_pos, long.last.end_pos) == (8332 * 42, 349_999)
