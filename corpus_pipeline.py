"""From documents to packed training rows: five stages, each one operator, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, mixing, ngram_join, packing, quality
from llm.common import read, remainder, written

MIX_WEIGHTS = [3, 1, 2]

# Boosted trees have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose quality score is below the threshold; learned from labels that are not held out."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 4) != 2)
    return quality.keep(docs, model)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten words in a row of a benchmark item, or a whole shorter one."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def balanced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document is there as often as it is taken."""
    return mixing.mixed(docs, MIX_WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rows of one length."""
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", different), ("decontamination", unseen), ("mixing", balanced), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
