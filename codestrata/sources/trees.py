"""File tables: one row per file, keyed by (repo, path)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.paths import file_name, file_suffix, under
from codestrata.sources.folders import local, tree

# Folder names that hold no source of the repository.
IGNORED_FOLDERS = [
    ".git", ".next", ".venv", "venv", "node_modules", "dist", "build", ".idea", ".pytest_cache", "__pycache__",
]

# Names (whole segment) and suffixes the sensitive-data scan passes over.
SCAN_SKIPPED = [
    ".git", "node_modules", ".venv", "venv", "__pycache__", ".pyc", ".pyo", ".so", ".dll", ".exe", ".bin",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".lock", ".sum",
]

# Lock files, whose hashes look like secrets.
LOCK_FILES = ["package-lock.json", "yarn.lock", "poetry.lock", "go.sum", "Cargo.lock"]


def shares(spark: SparkSession) -> int:
    """Of how many tasks a tree is listed and read."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scan_files(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    """Every regular file below ``root``, where each direct subfolder of ``root`` is one repository.

    Bytes that are not UTF-8 become replacement characters, so that the rest
    of such a file is still read. ``name_glob`` is applied by the file listing,
    before anything is read. A local ``root`` is resolved first, and listed and read
    by tasks; another store is read by Spark, which gives paths below the folder
    that was asked for.
    """
    if "://" not in root or root.startswith("file:"):
        return tree(spark, local(root), name_glob, shares(spark))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    # Both without store and host: the listing may name a host that the caller left out.
    base = re.sub(r"^[^:/]+://[^/]*", "", root).rstrip("/") + "/"
    place = F.regexp_replace("path", r"^[^:/]+:(?://[^/]*)?", "")
    below = F.substring(place, len(base) + 1, 1_000_000)
    return reader.load(root).select(
        F.substring_index(below, "/", 1).alias("repo"),
        F.regexp_extract(below, r"(?s)^[^/]+/(.*)$", 1).alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size_bytes"),
    ).filter(F.col("path") != "")


def ignore_dirs(files: DataFrame) -> DataFrame:
    """Files with no ignored folder name among their repository-relative segments."""
    return files.filter(~under("path", IGNORED_FOLDERS))


def is_scannable(path: str = "path") -> Column:
    return ~under(path, SCAN_SKIPPED) & ~F.lower(file_suffix(path)).isin(SCAN_SKIPPED) & ~file_name(path).isin(LOCK_FILES)


def scannable_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files the sensitive-data scan reads: no skipped folder, suffix or lock file; with ``max_bytes``, none larger."""
    kept = files.filter(is_scannable())
    return kept if max_bytes is None else kept.filter(F.col("size_bytes") <= max_bytes)


def readable_text(text: Column) -> Column:
    """The whole text; unreadable content is empty."""
    return F.coalesce(text, F.lit(""))


def capped_text(text: Column, limit: int) -> Column:
    """At most ``limit`` leading characters; unreadable content is empty. For a caller who asks for it: nothing here does."""
    return F.substring(readable_text(text), 1, limit)


def capped_content(files: DataFrame, limit: int) -> DataFrame:
    return files.withColumn("content", capped_text(F.col("content"), limit))
