"""What kind of repository this is and which documents it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions.doc_types import in_order, with_added
from codestrata.operators.facts import file_facts
from codestrata.sources.trees import ignore_dirs

INFRA_HALF_POINTS = 10

# Document types in the order they are listed, and the order they are decided in.
DOCUMENT_TYPES = [
    "repository-overview", "architecture-guide", "configuration-guide", "deployment-runbook", "operations-runbook",
    "api-reference", "quality-and-validation", "usage-patterns", "developer-workflows",
]
DECISION_ORDER = [
    "repository-overview", "architecture-guide", "developer-workflows", "quality-and-validation", "configuration-guide",
    "deployment-runbook", "operations-runbook", "usage-patterns", "api-reference",
]

API_FRAMEWORKS = ["FastAPI", "Flask", "Django", "Express"]


def repo_facts(files: DataFrame) -> DataFrame:
    """Counts and yes/no facts of each repository, gathered from all files in a single grouping."""
    lists = {"env": ["env_declared", "env_read"], "scripts": ["scripts"], "endpoints": ["api_endpoints"]}
    table = files if "scripts" in files.columns else file_facts(files)

    def filled(names: list[str]) -> F.Column:
        return F.coalesce(P.any_of([F.coalesce(F.size(n), F.lit(0)) > 0 for n in names]), F.lit(False))

    per_file = ignore_dirs(table).select(
        "repo",
        P.category("path").alias("category"),
        P.language("path").alias("language"),
        P.infra_halves("path").alias("halves"),
        P.tools("path").alias("tools"),
        P.frameworks("path").alias("frameworks"),
        P.has_deploy_word("path").alias("deploy"),
        P.config_format("path").isNotNull().alias("config"),
        *[filled(names).alias(alias) for alias, names in lists.items()],
    )

    def count(condition: F.Column, alias: str) -> F.Column:
        return F.count(F.when(condition, 1)).alias(alias)

    def has(condition: F.Column, alias: str) -> F.Column:
        return F.max(condition).alias(alias)

    frameworks = F.array(*[F.lit(f) for f in API_FRAMEWORKS])
    return per_file.groupBy("repo").agg(
        F.count("*").alias("files"),
        *[count(F.col("category") == c, c) for c in ("application", "infrastructure", "tests", "examples")],
        *[count(F.col("language") == name, name.lower()) for name in ("Python", "JavaScript", "YAML", "JSON")],
        F.sum("halves").alias("halves"),
        has(F.array_contains("tools", "docker"), "docker"),
        has(F.array_contains("tools", "make"), "make"),
        has(F.array_contains("tools", "npm"), "npm"),
        has(F.arrays_overlap("frameworks", frameworks), "api_framework"),
        has(F.col("deploy"), "deploy"),
        has(F.col("config"), "config"),
        has(F.col("env"), "env"),
        has(F.col("scripts"), "scripts"),
        has(F.col("endpoints"), "endpoints"),
    )


def infra_score(facts: DataFrame) -> DataFrame:
    """Infrastructure points of each repository and whether they make it an infrastructure repository."""
    halves = F.col("halves") + F.when(F.col("infrastructure") > F.col("application"), 6).otherwise(0)
    return facts.withColumn("infra_score", halves / F.lit(2.0)).withColumn("is_infra", halves >= INFRA_HALF_POINTS)


def doc_needs(facts: DataFrame, generate_all: bool = False) -> DataFrame:
    """Document types each repository needs, one row each, numbered in the order they were decided.

    Added types (``codestrata.functions.doc_types``) are decided with the others.
    """
    if generate_all:
        needs = F.array(*[F.lit(d) for d in in_order(DOCUMENT_TYPES)])
        return facts.select("repo", F.posexplode(needs).alias("ord", "doc_type"))
    c = F.col
    infra = c("is_infra")
    app = (c("application") > 0) | (c("python") > 5) | (c("javascript") > 5)
    rules = {
        "repository-overview": F.lit(True),
        "architecture-guide": app | infra | (c("files") > 10),
        "developer-workflows": c("files") > 5,
        "quality-and-validation": (c("tests") > 0) | app | infra,
        "configuration-guide": infra | c("env") | c("config") | (c("yaml") > 0) | (c("json") > 3),
        "deployment-runbook": infra | c("docker") | c("deploy"),
        "operations-runbook": infra | c("scripts") | c("make") | c("npm"),
        "usage-patterns": (c("examples") > 0) | (c("files") > 20),
        "api-reference": c("endpoints") | c("api_framework"),
    }
    rules |= {name: when() for name, when in with_added({}, "when").items()}
    needs = F.array_compact(F.array(*[F.when(rules[d], F.lit(d)) for d in in_order(DECISION_ORDER)]))
    return infra_score(facts).select("repo", F.posexplode(needs).alias("ord", "doc_type"))
