"""Per-file features, all in one narrow projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.sources.trees import ignore_dirs


def file_parts(files: DataFrame) -> DataFrame:
    """Name, lower-case name, suffix and depth of each path."""
    return files.select(
        "repo", "path",
        P.file_name("path").alias("name"),
        F.lower(P.file_name("path")).alias("lower_name"),
        P.file_suffix("path").alias("suffix"),
        P.depth("path").alias("depth"),
    )


def file_features(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """What the path and the size tell about each file that is not ignored. ``keep`` carries further columns."""
    named = ignore_dirs(files).select(
        "repo", "path", "size_bytes", *(keep or []),
        P.language("path").alias("language"),
        P.category("path").alias("category"),
        P.is_entry_point("path").alias("is_entry_point"),
    )
    return named.select(
        "*",
        P.doc_signal("path", F.col("category")).alias("doc_signal"),
        P.importance_tenths("path", F.col("category"), F.col("is_entry_point")).alias("score10"),
        P.directory_key("path").alias("dir_key"),
    ).withColumn("importance_score", F.col("score10") / F.lit(10.0))


def is_key_file(features: DataFrame) -> DataFrame:
    """Files that matter: importance of at least 0.3, or an entry point."""
    return features.filter((F.col("score10") >= 3) | F.col("is_entry_point"))


def existing_docs(files: DataFrame) -> DataFrame:
    return ignore_dirs(files).filter(P.is_doc("path")).select("repo", "path")


def config_files(files: DataFrame) -> DataFrame:
    """Files with a well-known configuration name, their format and purpose."""
    return (
        ignore_dirs(files)
        .select("repo", "path", P.config_format("path").alias("config_type"), P.config_purpose("path").alias("purpose"))
        .filter(F.col("config_type").isNotNull())
    )


def by_importance(features: DataFrame) -> DataFrame:
    """All files of all repositories in descending importance: a global, range-partitioned sort."""
    return features.orderBy("repo", F.desc("score10"), "path")
