"""Counts, directory summaries and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import CATEGORY_NAMES, LANGUAGE_NAMES, directory_purpose
from codestrata.operators.features import is_key_file
from codestrata.operators.ordering import head_per_group, joined_head


def language_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("repo", "language").agg(F.count("*").alias("files"))


def category_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("repo", "category").agg(F.count("*").alias("files"))


def counted_map(column: str, names: list[str]) -> Column:
    """Aggregate: how often each of the fixed names occurs, as a map without zeros. Needs no second grouping."""
    counts = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.count(F.when(F.col(column) == n, 1)) for n in names])
    )
    return F.map_filter(counts, lambda _, n: n > 0)


def by_count(counts: Column) -> Column:
    """Entries of a counted map as structs, most frequent first, ties by name."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("name")))
    return F.array_sort(entries)


def format_counts(counts: Column, n: int = 1000, empty: str = "None detected") -> Column:
    """``name (count)`` of the ``n`` most frequent entries."""
    shown = F.transform(
        F.slice(by_count(counts), 1, n), lambda e: F.concat(e["name"], F.lit(" ("), (-e["n"]).cast("string"), F.lit(")"))
    )
    return F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise(empty)


def top_counter(features: DataFrame, n: int = 5) -> DataFrame:
    """The most common languages and categories of each repository in one line each."""
    return features.groupBy("repo").agg(
        format_counts(counted_map("language", LANGUAGE_NAMES), n).alias("languages"),
        format_counts(counted_map("category", CATEGORY_NAMES), n).alias("categories"),
    )


def files_by_extension(features: DataFrame, suffix: Column, show_all: int = 20, show_first: int = 15) -> DataFrame:
    """Per suffix the number of files and their paths: all of a small group, the first ones of a large group."""
    named = features.select("repo", F.when(suffix != "", suffix).otherwise("no-ext").alias("suffix"), "path")
    counts = named.groupBy("repo", "suffix").agg(F.count("*").alias("files"))
    head = head_per_group(named, ["repo", "suffix"], ["path"], show_all)
    paths = head.groupBy("repo", "suffix").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    few = F.col("files") <= show_all
    more = F.concat(F.lit("... and "), (F.col("files") - show_first).cast("string"), F.lit(" more"))
    return counts.join(paths, ["repo", "suffix"]).select(
        "repo", "suffix", "files",
        F.when(few, F.array_join("paths", ", "))
        .otherwise(F.concat(F.array_join(F.slice("paths", 1, show_first), ", "), more))
        .alias("sample"),
    )


def extension_groups_by_size(features: DataFrame, suffix: Column) -> DataFrame:
    named = features.select("repo", F.when(suffix != "", suffix).otherwise("no-ext").alias("suffix"))
    return named.groupBy("repo", "suffix").agg(F.count("*").alias("files")).orderBy("repo", F.desc("files"), "suffix")


def symbol_totals(symbols: DataFrame) -> DataFrame:
    """Classes (with interfaces) and functions per repository."""
    return symbols.groupBy("repo").agg(
        F.count(F.when(F.col("symbol_type") != "function", 1)).alias("classes"),
        F.count(F.when(F.col("symbol_type") == "function", 1)).alias("functions"),
    )


def majority_category() -> Column:
    """Aggregate: the most frequent category, the first by name among equals. Never more than seven are compared."""
    return F.get(by_count(counted_map("category", CATEGORY_NAMES)), F.lit(0))["name"]


def top_symbols(symbols: DataFrame, n: int = 50) -> DataFrame:
    """First symbols of each directory: described ones first, then by name."""
    return head_per_group(symbols, ["repo", "dir_key"], [F.col("docstring") == "", "name", "path", "pos"], n)


def _distinct_names(symbols: DataFrame, functions: bool, alias: str, per_file: int, per_dir: int) -> DataFrame:
    """Distinct names of a directory, from the first ones of each file, and how many of its names are not among them.

    A file's symbols come from one row and are ranked there; a directory is reduced to its different names, and these
    to their number and the first of them, before anything of it meets in one place.
    """
    keys = ["repo", "dir_key"]
    chosen = symbols.filter((F.col("symbol_type") == "function") if functions else (F.col("symbol_type") != "function"))
    place = F.row_number().over(Window.partitionBy("repo", "path").orderBy("pos"))
    names = chosen.select(*keys, "name", (place <= per_file).alias("early")).groupBy(*keys, "name").agg(F.max("early").alias("early"))
    early = names.filter("early").select(*keys, "name")
    totals = names.groupBy(*keys).agg(F.count("*").alias("_all"), F.count(F.when(F.col("early"), 1)).alias("_early"))
    return joined_head(early, keys, ["name"], F.col("name"), per_dir, alias).join(totals, keys).select(
        *keys, alias, (F.col("_all") - F.least("_early", F.lit(per_dir))).alias(f"{alias}_left")
    )


def directory_summaries(
    features: DataFrame, symbols: DataFrame, names_per_file: int = 10, names_per_dir: int = 30, key_files_per_dir: int = 10
) -> DataFrame:
    """One row per directory. All parts are keyed alike and bounded, so the joins move little.

    Beside each list stands how many entries it leaves out: ``key_files_left``, ``classes_left``, ``functions_left``.
    """
    keys = ["repo", "dir_key"]
    base = features.groupBy(*keys).agg(
        F.count("*").alias("file_count"),
        counted_map("language", LANGUAGE_NAMES).alias("languages"),
        counted_map("category", CATEGORY_NAMES).alias("categories"),
        majority_category().alias("majority_category"),
    )
    key = is_key_file(features)
    left = F.greatest(F.count("*") - key_files_per_dir, F.lit(0)).alias("key_files_left")
    key_files = joined_head(key, keys, ["path"], F.col("path"), key_files_per_dir, "key_files").join(key.groupBy(*keys).agg(left), keys)
    symbol_count = symbols.groupBy(*keys).agg(F.count("*").alias("symbols"))
    return (
        base.withColumn("description", directory_purpose(F.col("dir_key"), F.col("majority_category")))
        .join(key_files, keys, "left")
        .join(_distinct_names(symbols, False, "classes", names_per_file, names_per_dir), keys, "left")
        .join(_distinct_names(symbols, True, "functions", names_per_file, names_per_dir), keys, "left")
        .join(symbol_count, keys, "left")
        .na.fill("", ["key_files", "classes", "functions"])
        .na.fill(0, ["symbols", "key_files_left", "classes_left", "functions_left"])
    )
