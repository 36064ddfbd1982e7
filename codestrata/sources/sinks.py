"""Writers: one dataset per kind of result, split by a column with few values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.sources.folders import NO_VALUE, local, on_disk, tree, write_files
from codestrata.sources.trees import scan_files, shares


def write_profile(tables: dict[str, DataFrame], profile: DataFrame, path: str, lists: list[str]) -> None:
    """The profile rows as JSON, and each of the named lists as its own JSON dataset."""
    profile.write.mode("overwrite").json(f"{path}/profile")
    for name in lists:
        tables[name].write.mode("overwrite").json(f"{path}/{name}")


def placed(rows: DataFrame, folder: str, filename: str, body: str, order: str | None) -> DataFrame:
    """(folder, filename, body), those of one file in one task and in order."""
    keys = [F.col(folder).cast("string").alias("folder"), F.col(filename).cast("string").alias("filename")]
    place = F.lit(0) if order is None else F.col(order)
    rows = rows.select(*keys, F.col(body).alias("body"), place.alias("place")).repartition("folder", "filename")
    return rows.sortWithinPartitions("folder", "filename", "place").select("folder", "filename", "body")


def name(segment: Column | str) -> Column:
    """The name that a segment of a path stands for."""
    return F.url_decode(F.replace(segment, F.lit("+"), F.lit("%2B")))


def write_documents(documents: DataFrame, path: str, as_text: bool = False) -> None:
    """Bodies by document type as Parquet rows; or as text, one file in a folder of its own for each document.

    The text of a document is below ``repo=…/filename=…`` and ends in one line
    break; its parts (``part``, where there is such a column) follow in order.
    A local folder is written by tasks of our own: Spark's writer has the driver
    rename every file.
    """
    keys, order = ["repo", "filename"], "part" if "part" in documents.columns else None
    if as_text and on_disk(documents.sparkSession, path):
        named = documents.withColumns({k: F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys})  # one folder for both
        write_files(placed(named, *keys, "body", order), path, keys)
    elif as_text:
        order = [*keys, order] if order else keys
        rows = documents.repartition(*keys).sortWithinPartitions(*order).select(*keys, F.col("body").alias("value"))
        rows.write.mode("overwrite").partitionBy(*keys).option("lineSep", "\n").text(path)
    else:
        documents.withColumn("body", F.concat("body", F.lit("\n"))).write.mode("overwrite").partitionBy("doc_type").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """(repo, filename, body) of what ``write_documents`` wrote as text; names are texts, so ``007`` is not ``7``."""
    if on_disk(spark, path):  # listed by tasks
        rows = tree(spark, local(path), "[!._]*", shares(spark)).filter("repo LIKE 'repo=%' AND path LIKE 'filename=%/%'")
        value = lambda c: name(F.nullif(F.substring_index(c, "=", -1), F.lit(NO_VALUE)))
        return rows.select(value(F.col("repo")).alias("repo"), value(F.substring_index("path", "/", 1)).alias("filename"), F.col("content").alias("body"))
    rows = spark.read.schema("value string, repo string, filename string").text(path, wholetext=True)
    return rows.select("repo", "filename", F.col("value").alias("body"))


def write_named(rows: DataFrame, path: str, folder: str = "repo", filename: str = "filename", body: str = "body", order: str | None = None) -> None:
    """One text file for each (folder, filename), with that name, below ``path``, a folder that every task can open.

    A file's rows (``order`` says which comes first) end in a line break each. The files appear when all are written.
    """
    write_files(placed(rows, folder, filename, body, order), path)


def read_named(spark, path: str) -> DataFrame:
    """(folder, filename, body) of the files that ``write_named`` wrote."""
    return scan_files(spark, path).select(name("repo").alias("folder"), name("path").alias("filename"), F.col("content").alias("body"))


def write_report(report: DataFrame, path: str) -> None:
    """Sensitive-data reports, one row per repository and part."""
    report.write.mode("overwrite").parquet(path)
