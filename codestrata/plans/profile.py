"""The profile of every repository: one table per list, and one row of totals."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import CATEGORY_NAMES, LANGUAGE_NAMES
from codestrata.operators import facts
from codestrata.operators.facts import file_facts
from codestrata.operators.decisions import doc_needs, infra_score, repo_facts
from codestrata.operators.features import config_files, existing_docs, file_features
from codestrata.operators.priority import important_files
from codestrata.sources.tables import settle
from codestrata.operators.summaries import counted_map, directory_summaries, symbol_totals, top_symbols

COUNTED = [
    "dependencies", "env_variables", "entry_points", "config_files", "scripts", "api_endpoints", "ci_workflows",
    "existing_docs", "directories",
]


class ProfileTables(dict):
    """Tables of a profile by name, each planned at its first use.

    With ``keep``, each list is also written at its first use: plans that read
    a list in many places then read a small table, whose size the planner
    knows, instead of taking it from the facts again.
    """

    def __init__(self, builders: dict[str, Callable[[ProfileTables], DataFrame]], known: dict[str, DataFrame], keep: bool = False) -> None:
        super().__init__(known)
        self._builders, self._keep = builders, keep

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._made(name)
        return self[name]

    def _made(self, name: str) -> DataFrame:
        table = self._builders[name](self)
        return settle(table) if self._keep and name not in WITH_TEXT else table

    def together(self, *names: str) -> ProfileTables:
        """Plans the named tables now; with ``keep``, their jobs run at the same time, as they are small and wait for each other otherwise."""
        for step in (set(names) - set(FROM_TABLES), set(names) & set(FROM_TABLES)):
            missing = sorted(name for name in step if name not in self)
            with ThreadPoolExecutor(max(1, len(missing))) as pool:
                self.update(zip(missing, pool.map(self._made, missing), strict=True))
        return self

    def extended(self, **more: DataFrame) -> ProfileTables:
        """The same tables and some more."""
        return ProfileTables(self._builders, {**self, **more}, self._keep)

    def kept(self) -> ProfileTables:
        """The same tables, each written at its first use from here on."""
        return self if self._keep else ProfileTables(self._builders, {name: self[name] for name in ("files", "per_file")}, True)


WITH_TEXT = ["important_files"]  # read once, and too large to be written again
FROM_TABLES = ["doc_needs", "top_symbols", "directories", "important_files"]  # made of other tables than the facts of files


BUILDERS: dict[str, Callable[[ProfileTables], DataFrame]] = {
    "features": lambda t: file_features(t["per_file"]),
    "symbols": lambda t: facts.symbols(t["per_file"]),
    "facts": lambda t: repo_facts(t["per_file"]),
    "doc_needs": lambda t: doc_needs(t["facts"]),
    "dependencies": lambda t: facts.dependencies(t["per_file"]),
    "env_variables": lambda t: facts.env_variables(t["per_file"]),
    "entry_points": lambda t: facts.entry_points(t["per_file"]),
    "config_files": lambda t: config_files(t["per_file"]),
    "scripts": lambda t: facts.scripts(t["per_file"]),
    "api_endpoints": lambda t: facts.api_endpoints(t["per_file"]),
    "ci_workflows": lambda t: facts.ci_workflows(t["per_file"]),
    "existing_docs": lambda t: existing_docs(t["per_file"]),
    "markers": lambda t: facts.repo_markers(t["per_file"]),
    "codeowners": lambda t: facts.codeowners(t["per_file"]),
    "dependabot": lambda t: facts.dependabot(t["per_file"]),
    "issue_templates": lambda t: facts.issue_templates(t["per_file"]),
    "custom_actions": lambda t: facts.custom_actions(t["per_file"]),
    "funding": lambda t: facts.funding(t["per_file"]),
    "labels": lambda t: facts.labels(t["per_file"]),
    "hosting_flags": lambda t: facts.hosting_flags(t["per_file"]),
    "top_symbols": lambda t: top_symbols(t["symbols"]),
    "directories": lambda t: directory_summaries(t["features"], t["symbols"]),
    "important_files": lambda t: important_files(t["files"], t["features"], lengths=t["per_file"].select("repo", "path", "chars")),
}


def profile_tables(files: DataFrame) -> ProfileTables:
    """Every list of the profile as its own table keyed by repository.

    The text is read once: the facts of all files are written, and the lists
    come from there. Only the important files are looked up again at the end.
    """
    return ProfileTables(BUILDERS, {"files": files, "per_file": settle(file_facts(files))})


def assemble_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per repository: counts of every list, and the lists whose size has a fixed bound.

    The counts of all lists travel in one union and one grouping instead of a
    join per list.
    """
    base = tables["features"].groupBy("repo").agg(
        F.count("*").alias("total_files"),
        counted_map("language", LANGUAGE_NAMES).alias("languages"),
        counted_map("category", CATEGORY_NAMES).alias("categories"),
    )
    counted = None
    for name in COUNTED:
        one = tables[name].groupBy("repo").agg(F.count("*").alias("n")).withColumn("list", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    sizes = counted.groupBy("repo").pivot("list", COUNTED).agg(F.sum("n"))
    sizes = sizes.select("repo", *[F.col(name).alias(f"n_{name}") for name in COUNTED])

    def names(kind: str):
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("marker"))))

    markers = tables["markers"].groupBy("repo").agg(names("tool").alias("tools"), names("framework").alias("frameworks"))
    needs = tables["doc_needs"].groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("ord", "doc_type"))).alias("_n")).select(
        "repo", F.transform("_n", lambda s: s["doc_type"]).alias("doc_needs")
    )
    infra = infra_score(tables["facts"]).select("repo", "infra_score", "is_infra")
    out = base
    for part in (sizes, symbol_totals(tables["symbols"]), markers, needs, infra):
        out = out.join(part, "repo", "left")
    empty = F.array().cast("array<string>")
    return out.na.fill(0, [*[f"n_{name}" for name in COUNTED], "classes", "functions"]).withColumns(
        {name: F.coalesce(name, empty) for name in ("tools", "frameworks", "doc_needs")}
    )


def profile_json(profile: DataFrame) -> DataFrame:
    """The row of each repository as one JSON text."""
    return profile.select("repo", F.to_json(F.struct("*")).alias("json"))
