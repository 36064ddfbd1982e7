"""Which files explain a repository best, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import file_name
from codestrata.operators.ordering import head_per_group, running_total
from codestrata.sources.tables import look_up
from codestrata.sources.trees import readable_text

MAX_FILES = 30
MAX_TOTAL_CHARS = 500_000
EXAMPLES, APPLICATION = 5, 10

# File names that always come first.
MUST_HAVE = [
    "README.md", "readme.md", "README.rst", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "Makefile",
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".env.example", ".env.sample",
]


def priority_files(features: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """The chosen files with their tier: must-have names, entry points, examples, application code, the rest.

    A file counts for the first tier that names it. The last tier only fills up
    to ``max_files``; tiers one to four are never cut. ``sort_score`` and path
    order the files of a tier.
    """
    c = F.col
    base = features.select(
        "repo", "path", "score10",
        file_name("path").isin(MUST_HAVE).alias("must"),
        c("is_entry_point").alias("entry"),
        ((c("category") == "examples") & (c("language") == "Python")).alias("example"),
        ((c("category") == "application") & (c("score10") >= 3)).alias("app"),
    )
    first = c("must") | c("entry")
    fixed = base.filter(first).select("repo", "path", "score10", F.when(c("must"), 1).otherwise(2).alias("tier"))

    # A file can be ranked as an example or as application code (both count the files of earlier tiers as well)
    # and among the rest. Only the best of each list can matter: every task keeps those before the shuffle.
    roles = F.array_compact(F.array(
        F.when(c("example"), F.lit("example")), F.when(c("app"), F.lit("app")), F.when(~first, F.lit("rest"))
    ))
    ranked = head_per_group(
        base.select("repo", "path", "score10", first.alias("first"), F.explode(roles).alias("role")),
        ["repo", "role"], [F.desc("score10"), "path"], max_files + EXAMPLES + APPLICATION, "place",
    )

    def within(role: str, n: int) -> Column:
        return F.max((c("role") == role) & (c("place") <= n))

    tier = F.when(within("example", EXAMPLES), 3).when(within("app", APPLICATION), 4).otherwise(5)
    others = (
        ranked.groupBy("repo", "path", "score10", "first")
        .agg(tier.alias("tier"), F.max(c("role") == "rest").alias("rest"))
        .filter(~c("first") & (c("rest") | (c("tier") < 5)))
    )
    # From here on a repository has a fixed number of rows at most.
    by_tier = Window.partitionBy("repo").orderBy("tier", F.desc("score10"), "path")
    taken = fixed.groupBy("repo").agg(F.count("*").alias("taken"))
    filled = (
        others.withColumn("place", F.row_number().over(by_tier))
        .join(taken, "repo", "left")
        .filter((c("tier") < 5) | (F.coalesce("taken", F.lit(0)) + c("place") <= max_files))
        .select("repo", "path", "score10", "tier")
    )
    # Must-have files keep the order of the tree: their score does not count.
    score = F.when(c("tier") == 1, 0).otherwise(-c("score10"))
    return fixed.unionByName(filled).withColumn("sort_score", score)


def priority_rank(features: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """The chosen files with their rank; exact for a repository of any size."""
    chosen = priority_files(features, max_files)
    ranked = running_total(chosen, ["repo"], ["tier", "sort_score", "path"], F.lit(1), "_before")
    return ranked.select("repo", "path", "tier", "score10", (F.col("_before") + 1).alias("rank"))


def context_budget(
    candidates: DataFrame, keys: list[str], order: list[str], length: str, max_total: int = MAX_TOTAL_CHARS
) -> DataFrame:
    """Takes rows in order while the rows taken before sum to less than the budget; empty rows are passed over.

    Two steps keep a large group apart. Each of many slices of a group first
    drops the rows that already have a full budget of better rows in their own
    slice: they can never be taken. What is left of a group is at most one
    budget per slice, whatever its size, and is decided in the second step.
    """
    slices = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = candidates.filter(F.col(length) > 0).withColumn("_slice", F.pmod(F.xxhash64(*keys, *order), F.lit(slices)))

    def taken_before(*partition: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(length).over(window), F.lit(0))

    possible = sliced.withColumn("_before", taken_before(*keys, "_slice")).filter(F.col("_before") < max_total)
    return (
        possible.withColumn("_before", taken_before(*keys))
        .filter(F.col("_before") < max_total)
        .withColumn("chars_before", F.col("_before"))
        .drop("_before", "_slice")
    )


def important_files(
    files: DataFrame, features: DataFrame, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL_CHARS, lengths: DataFrame | None = None
) -> DataFrame:
    """Rank, path and content of the files that go into a context.

    The choice is made on lengths alone (``lengths``: repo, path, chars, when
    they are known already); the text of the chosen files is joined last.
    """
    texts = files.select("repo", "path", readable_text(F.col("content")).alias("content"))
    if lengths is None:
        lengths = texts.select("repo", "path", F.length("content").alias("chars"))
    chosen = priority_files(features, max_files).join(lengths, ["repo", "path"])
    taken = context_budget(chosen, ["repo"], ["tier", "sort_score", "path"], "chars", max_total)
    # Every taken file has a character of the budget, so a repository has at most that many rows here.
    window = Window.partitionBy("repo").orderBy("tier", "sort_score", "path")
    ranked = taken.select("repo", "path", F.row_number().over(window).alias("rank"))
    return look_up(texts, ranked, ["repo", "path"])
