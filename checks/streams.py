"""Structured Streaming forms of the scan and the gate, run to the end over the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import Registry
from checks.scan import corpus_sql
from codestrata.sources.tables import shared_folder
from codestrata.streaming import gate as ST

registry = Registry()
add = registry.add


def scratch(spark) -> str:
    """A folder of its own below the shared folder of the session."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def arriving(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return ST.read_stream(spark, sf_dir, "documents.parquet", schema)


def stream_scan(spark, sf_dir):
    folder = scratch(spark)
    found = ST.stream_scan(arriving(spark, sf_dir), ["doc_id"], "text", "thorough").select("doc_id", "line_number", "pattern")
    query = (
        found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def stream_gate(spark, sf_dir):
    folder = scratch(spark)
    writer = ST.stream_gate(arriving(spark, sf_dir).select("doc_id", "text"), "text", f"{folder}/clean", f"{folder}/quarantine", "standard")
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    sides = [spark.read.parquet(f"{folder}/{side}").select("doc_id", F.lit(side).alias("side")) for side in ("clean", "quarantine")]
    return sides[0].unionByName(sides[1])


add("stream_scan", stream_scan, corpus_sql("SELECT doc_id, line_number, pattern FROM hits", "doc_id", "documents", "text", "thorough"))
add("stream_gate", stream_gate,
    corpus_sql("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM hits) THEN 'quarantine' ELSE 'clean' END AS side FROM documents",
               "doc_id", "documents", "text", "standard"))
