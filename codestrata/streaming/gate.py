"""The scan and the gate on arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from codestrata.operators.scan import has_blocker, scan_content


def read_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """Parquet tables with a given name, one file or a folder of files each, that arrive in a folder or in its ``key=value`` folders.

    The table of the folder itself may be divided into ``key=value`` folders of its own, whose keys are columns of ``schema``: its batches
    find them below the base path. The other tables are read without one, so that their folders may come after the start.
    """
    own = spark.readStream.schema(schema).option("basePath", folder).parquet(f"{folder}/{{{name}}}")
    others = spark.readStream.schema(schema).parquet(f"{folder}/*=*/{name}")
    return own.select(*schema.names).unionByName(others.select(*schema.names))


def stream_scan(stream: DataFrame, keys: list[str], text: str, level: str = "standard") -> DataFrame:
    """Findings of arriving rows: no state, so rows can be appended as they come."""
    return scan_content(stream, keys, text, level)


def stream_gate(stream: DataFrame, text: str, clean: str, quarantine: str, level: str = "standard") -> DataStreamWriter:
    """Sends every arriving row to ``clean`` or to ``quarantine``.

    The verdict of a batch is computed once and kept for both writes. A batch
    has its own folder, which is replaced when the batch is repeated, so a
    restart leaves no row twice.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("_blocked", F.coalesce(has_blocker(F.col(text), level), F.lit(False))).persist()
        try:
            for blocked, target in ((False, clean), (True, quarantine)):
                rows = judged.filter(F.col("_blocked") == blocked).drop("_blocked")
                rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        finally:
            judged.unpersist()

    return stream.writeStream.foreachBatch(route)
