"""Helpers shared by the operators: written tables, text chunks inside a task, ragged arrays, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_ROWS = 1 << 15  # of a slice of texts
_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one (tests) gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="llm-"))
    return _local_folder[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and the size of the table is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character left alone.

    A text without other letters than ASCII's takes the fast function, which does the same to it.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id gives null."""
    return F.crc32(doc_id.cast("string")) % divisor


# --- inside a task --------------------------------------------------------------------------------------------------


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Slices of the batches whose texts come to about ``limit`` bytes (one longer text is a slice of its own).

    Gives the slice and its ``text`` column, nulls as empty strings. Bounds the memory of what is derived from a text.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column("text")
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + limit, side="right"))), start + MOST_ROWS)
            part = pc.fill_null(text.slice(start, stop - start).cast(pa.large_string()), "")
            yield batch.slice(start, stop - start), pa.concat_arrays([part])
            start = stop


def ragged(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list array and the offset of each list in them."""
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return lists.flatten(), offsets - offsets[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of an array of strings as numbers, and the offset of each string in them."""
    texts = texts.cast(pa.large_string())
    raw, bounds = texts.buffers()[2], np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = raw.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if raw is not None else b""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(texts), dtype=np.int64))])


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets (empty segments give 0); rows may be vectors."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# --- graphs ---------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a long, b long): rows (node, label).

    Minimum labels travel along edges and every round also follows labels of labels, so that long chains shorten by
    half. Each round is written; nothing but the number of changed nodes reaches the driver. Hot nodes are joins that
    the adaptive planner splits and minima that are taken before the shuffle.
    """
    both = written(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        f"{name}-edges",
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), name)
    while True:
        sent = both.join(labels, both.a == labels.node).groupBy("b").agg(F.min("label").alias("m"))
        nearer = labels.join(sent, labels.node == sent.b, "left").select("node", F.col("label").alias("before"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = nearer.join(jump, nearer.label == jump.via, "left").select("node", "before", F.least("label", "further").alias("label"))
        after = written(after, name)
        labels = after.select("node", "label")
        if after.filter("label <> before").isEmpty():
            return labels
