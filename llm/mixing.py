"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. These expectations are summed in order within
the source, one offset drawn for the source is added, and a document is taken once for every whole number that its
step crosses. The order is by size, so that each stretch of the sum holds documents alike in size and the words taken
stay within about one document of the target.

The order is made by range partitioning over (source, size, id): a source with most of the rows is many tasks. Sums
inside a partition are windows over that partition, sums across partitions are taken over one row for each source and
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import written

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row_key, size): words of each row; a null text has none."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", F.xxhash64("text").alias("row_key"), count.alias("size"))


def numbered(df: DataFrame, order: list[Column], group: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``, counting from 1 within ``group`` along ``order`` (which begins with the group)."""
    dealt = written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    inside = dealt.withColumn("k", F.row_number().over(Window.partitionBy("part", *group).orderBy(*order)))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part", *group).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = F.col("i.part") == F.col("s.part")
    for column in group:
        same &= F.col(f"i.{column}").eqNullSafe(F.col(f"s.{column}"))
    return inside.alias("i").join(starts.alias("s"), same).select("i.*", (F.col("k") + F.col("start")).alias("rank")).drop("part", "k")


def targets(sized: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target): shares of ``share`` times all words by weight, none above ``most`` times its source.

    Weights repeat over the sources in the order of their code points, null last. What a source cannot take is shared
    again by weight among the others until none is above its limit. Only sums over the sources reach the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals, [F.col("source").asc_nulls_last()], [], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "source-weights")
    unit, full = 0.0, -1
    while True:
        capped = F.lit(unit) * F.col("weight") > F.lit(most) * F.col("source_size")
        row = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weights"), F.count(F.when(capped, 1)).alias("capped"),
        ).first()
        if row["capped"] == full or row["weights"] == 0:
            break
        full, unit = row["capped"], (share * row["all"] - most * row["used"]) / row["weights"]
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.lit(unit) * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) drawn for the source."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 8), 16, 10)
    return drawn.cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """How often each document is taken: doc_id, source, row_key, size, source_size, target, copies.

    Needs doc_id, text and source; other columns are ignored. One row per row of ``docs``. Empty and null texts have
    size 0; a source of size 0 has target 0 and gives nothing; a null source is a source; rows equal in source, size
    and id are exchangeable. An empty table gives an empty result.
    """
    sized = written(sizes(docs.select("doc_id", "source", "text")), "sizes")
    goal = targets(sized, weights, share, most)
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id"), F.col("row_key")]
    ranked = numbered(sized, order, ["source"], "mix-order").alias("r")
    joined = ranked.join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.*", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    reached = lambda rank: F.floor(rate * rank + offset(F.col("source"), seed))
    copies = reached(F.col("rank")) - reached(F.col("rank") - 1)
    return joined.select("doc_id", "source", "row_key", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as it is taken. Rows that repeat id, source and text share one decision."""
    drawn = mix(docs, weights, share, most, seed).filter("copies > 0").groupBy("doc_id", "source", "row_key").agg(F.max("copies").cast("int").alias("copies"))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key"))
    same = (F.col("key") == F.col("m.row_key")) & F.col("row.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("row.source").eqNullSafe(F.col("m.source"))
    taken = keyed.join(written(drawn, "mix-decisions").alias("m"), same)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("m.copies")))).select("row.*")
