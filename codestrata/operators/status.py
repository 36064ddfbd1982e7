"""Counts, compliance status and the gate on top of findings.

Findings are counted per key before anything else, so a key with very many of
them reaches the last step as a handful of rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.catalog import SEVERITIES
from codestrata.operators.ordering import head_per_group

BLOCKING = ["critical", "high"]


def _count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per severity and in total, one row per key with a finding."""
    per_severity = [_count_where(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy(*keys).agg(*per_severity, F.count("*").alias("total"))


def scan_totals(subjects: DataFrame, findings: DataFrame, group: str, member: str) -> DataFrame:
    """Members scanned per group and members with at least one finding; clean groups count too."""
    scanned = subjects.groupBy(group).agg(F.count("*").alias("scanned"))
    members = findings.select(group, member).distinct().groupBy(group).agg(F.count("*").alias("with_findings"))
    return scanned.join(members, group, "left").select(
        group, "scanned", F.coalesce("with_findings", F.lit(0)).cast("bigint").alias("with_findings")
    )


def files_with_findings(subjects: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """The subjects that have a finding."""
    return subjects.join(findings.select(*keys).distinct(), keys, "left_semi")


def compliance_status(subjects: DataFrame, findings: DataFrame, group: str) -> DataFrame:
    """One row per group: compliant or not by kind of data, and why its text may not leave."""
    blocking = F.col("severity").isin(BLOCKING)
    facts = findings.filter(blocking).groupBy(group).agg(
        F.max(F.col("category") == "phi").alias("has_phi"),
        F.max((F.col("category") == "pii") & F.lower("description").contains("credit")).alias("has_card"),
        # Five categories exist, so the set is small whatever the group holds.
        F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"),
    )
    reason = F.concat(
        F.lit("Repository contains "), F.col("categories"), F.lit(" data. AI refinement blocked to prevent data exposure.")
    )
    return subjects.select(group).distinct().join(facts, group, "left").select(
        group,
        (~F.coalesce("has_phi", F.lit(False))).alias("hipaa_compliant"),
        (~F.coalesce("has_card", F.lit(False))).alias("pci_compliant"),
        F.col("categories").isNull().alias("ai_safe"),
        F.coalesce(reason, F.lit("")).alias("ai_blocked_reason"),
    )


def medium_by_category(findings: DataFrame, group: str) -> DataFrame:
    medium = findings.filter(F.col("severity") == "medium")
    counts = medium.groupBy(group, "category").agg(F.count("*").alias("findings"))
    return counts.orderBy(group, F.desc("findings"), "category")


def severity_rollup(findings: DataFrame, group: str) -> DataFrame:
    """Subtotals by group, severity and category. Counted once per combination before the levels are built."""
    counts = findings.groupBy(group, "severity", "category").agg(F.count("*").alias("n"))
    return counts.rollup(group, "severity", "category").agg(
        F.sum("n").alias("findings"), F.grouping_id().cast("bigint").alias("level")
    )


def report_head(findings: DataFrame, group: str, order: list[str], n: int = 50) -> DataFrame:
    """The first ``n`` high findings of each group with the number left out."""
    high = findings.filter(F.col("severity") == "high").select(group, *order, "description", "category")
    totals = high.groupBy(group).agg(F.count("*").alias("_total"))
    return head_per_group(high, [group], list(order), n).join(totals, group).select(
        group, "rank", *order, "description", "category", F.greatest(F.col("_total") - n, F.lit(0)).alias("more")
    )


def gate(status: DataFrame, mode: str, force: bool = False) -> DataFrame:
    """What may happen next: ``healthcare`` blocks, ``scan`` warns, ``off`` lets everything pass."""
    if mode not in ("healthcare", "scan", "off"):
        raise ValueError("mode must be healthcare, scan or off")
    blocked = ~F.col("ai_safe") & F.lit(mode == "healthcare" and not force)
    warned = ~F.col("ai_safe") & F.lit(mode == "scan" and not force)
    return status.withColumn("allowed", ~blocked).withColumn("warn", warned).withColumn(
        "reason", F.when(blocked, F.col("ai_blocked_reason")).otherwise("")
    )
