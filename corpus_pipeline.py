"""A training corpus from ``documents``, in stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamfield.llm import decontam, linededup, ngramjoin, piecewise, quality
from loamfield.staging import fresh_dir, remove, scratch, staged

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", linededup.stage),
    ("ngram_jaccard", ngramjoin.stage),
    ("decontamination", decontam.stage),
    ("sentencepiece", piecewise.stage),
]

#: The similarity join, the templates and the segmentation aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's result is written as Parquet and read again by the next.

    The rows that come back are the corpus: the columns of ``documents`` with the ids of the pieces of each text. A stage's own
    tables, and what the stage before kept, are deleted as soon as its result is written. An empty table gives none.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        at = fresh_dir(spark, f"stage-{name}")
        with scratch(spark, [at]):
            docs = staged(stage(spark, docs, sf_dir), name, at)
        remove(spark, *before)
        before = [at]
    return STAGES[-1][1](spark, docs, sf_dir)
