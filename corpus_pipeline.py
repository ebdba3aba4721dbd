"""From raw documents to packed training bins: the stages of the corpus pipeline and a runner.

Every stage takes (spark, docs, sf_dir), where ``docs`` has the columns of ``documents``, and works on all rows that the
stage before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.cluster import materialise
from claimlens.llm import decontamination, jaccard, lines, packing, quality


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality ranking accepts; it learns from the labels of ``docs`` that are not held out."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has, equal or one word apart; documents that lose all words go."""
    return lines.cleaned(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one with the smallest doc_id."""
    return jaccard.firsts(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into bins of 2,048 tokens, one row per piece."""
    return packing.pack(docs)


STAGES = [("quality_classifier", good), ("line_dedup", fresh_lines), ("jaccard_join", one_of_each), ("decontamination", unleaked), ("best_fit_packing", packed)]

#: Learned scores, connected components and greedy packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is stored and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
