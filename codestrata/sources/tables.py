"""Tables written on the way, in the folder that the session names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MOST_WORDS = 1 << 20  # of 64 bits: 8 MB


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session that names none gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), "codestrata-checkpoints")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later steps see fixed rows, read only the columns they need, and the
    planner knows the size of what was written.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def likely_among(small: DataFrame, keys: list[str]) -> Column:
    """Whether a row of another table may have one of the keys of ``small``: always true for those, seldom for others.

    A blocked Bloom filter, built by one aggregation and read as a scalar subquery: a key sets four bits of one of the filter's words. It has at
    least sixteen bits a key, and ``MOST_WORDS`` words at most; a fuller one lets more rows pass and loses none.
    """
    words = 1 << min(max(small.count() * BITS_PER_KEY // 64, 1).bit_length(), MOST_WORDS.bit_length() - 1)
    hashed = F.xxhash64(*keys)
    word = F.pmod(hashed, F.lit(words)).cast("int")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 40 + 6 * i).bitwiseAND(63).cast("int"))
    mask = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))
    held = small.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    every = small.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(held, "word", "left").na.fill(0, ["bits"])
    filled = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])
    return F.get(every.agg(filled).scalar(), word).bitwiseAND(mask) == mask


def look_up(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the few rows of a large table that ``small`` names.

    ``small`` is written first, so its size is measured: the planner sends it
    to every task while it is small and otherwise shuffles both sides. Rows of
    the large table that cannot be among them are left out where they are read,
    so that about as many texts move as are named.
    """
    small = settle(small)
    return big.filter(likely_among(small, keys)).join(small, keys)
