"""First rows, first n rows and ordered assembly per group, safe when one group holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.sources.tables import settle

PART_BYTES = 4_000_000
PART_ROWS = 20_000


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Every task reduces its own rows before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"first.{c}").alias(c) for c in [*order, *rest]])


def head_per_group(df: DataFrame, keys: list[str], order: list[str | Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank.

    Spark turns the filter into a limit that runs in every task before the
    shuffle, so a large group arrives as at most ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def joined_head(
    df: DataFrame, keys: list[str], order: list[str], text: Column, n: int, alias: str, separator: str = ", "
) -> DataFrame:
    """The first ``n`` texts of each group joined in order: one row per group, of bounded size."""
    items = df.select(*keys, *order, text.alias("_text"))
    head = head_per_group(items, keys, list(order), n, "_rank")
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "_text")))
    return head.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["_text"]), separator).alias(alias))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, alias: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, in order, for groups of any size.

    A window alone would sort a whole group in one task. Here the rows are
    range-partitioned by group and order, so a large group spreads over many
    tasks; each range sums its own rows and starts from the total of the ranges
    before it. The rows are written before the ranges are drawn, which takes a
    sample and would compute them twice, and again with their range, as both
    steps must see the same ones.
    """
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = settle(df.withColumn("_value", value))
    placed = settle(rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "_range")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(starts, [*keys, "_range"])
        .withColumn(alias, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_range", "_start")
    )


def assemble(blocks: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "\n") -> DataFrame:
    """Joins the texts of each group in order into bodies of bounded size.

    A body that would pass the part limits goes on in the next ``part``; the
    parts of a group, read in order, are the whole text. Usual groups have one.
    """
    weight = F.greatest(F.octet_length(text), F.lit(PART_BYTES // PART_ROWS))
    placed = running_total(blocks, keys, order, weight, "_before").withColumn(
        "part", F.floor(F.col("_before") / PART_BYTES) + 1
    )
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return placed.groupBy(*keys, "part").agg(
        F.array_join(F.transform(ordered, lambda s: s["_text"]), separator).alias("body")
    )
