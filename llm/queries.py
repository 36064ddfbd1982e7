"""Registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from llm import decontaminate as DC
from llm import language, lexical_search, line_templates, mixing, neighbours, ngram_join, packing, quality, token_counts, toxicity, warc, whitening
from llm.common import read, remainder, shared_folder
from llm.sql import ORACLES

MIX_WEIGHTS = [3, 1, 2]


def held_out(divisor: int, rest: int) -> Column:
    return F.coalesce(remainder(F.col("doc_id"), divisor) == rest, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.learn(docs, F.when(remainder(F.col("doc_id"), 3) != 1, F.col("lang")))
    return language.identify(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(read(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(read(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.learn(docs, read(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 4) != 2)
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return quality.score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", predicted)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 3) != 1)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", predicted)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DC.digest(DC.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slop=20))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), token_counts.load_pieces())


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = read(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    return warc.pages_of(warc.read_archives(spark, path, payloads=False), pages.schema["page_id"].dataType.simpleString())


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
