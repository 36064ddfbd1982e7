"""The text of a sensitive-data report, built as ordered blocks and joined per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.catalog import SEVERITIES
from codestrata.operators.ordering import assemble
from codestrata.plans.context import union_all
from codestrata.sources.tables import settle
from codestrata.operators.status import compliance_status, medium_by_category, report_head, scan_totals, severity_counts

ORDER = ["section", "path", "line_number", "pattern"]

CLOSING = "\n".join([
    "## What to do",
    "",
    "1. Critical findings come first: no release before they are fixed.",
    "2. Personal and health data belong in a protected store, never in code.",
    "3. Credentials belong in the environment or in a secrets manager.",
    "4. Tests should run on synthetic data.",
    "",
    "- [ ] All critical findings reviewed",
    "- [ ] Hard-coded data removed",
    "- [ ] Scan repeated",
    "- [ ] Scan added to the commit checks",
])


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _block(df: DataFrame, section: int, text: Column, path: Column | None = None, line: Column | None = None,
           pattern: Column | None = None) -> DataFrame:
    empty = F.lit("")
    return df.select(
        "repo",
        F.lit(section).alias("section"),
        (empty if path is None else path).alias("path"),
        (F.lit(0) if line is None else line).cast("int").alias("line_number"),
        (empty if pattern is None else pattern).alias("pattern"),
        text.alias("text"),
    )


def compliance_report_blocks(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Blocks of every report: summary, status, all critical rows, the first high rows, medium counts, advice."""
    totals = scan_totals(files, findings, "repo", "path")
    counts = severity_counts(findings, ["repo"])
    summary = totals.join(counts, "repo", "left").na.fill(0, [*SEVERITIES, "total"])
    status = compliance_status(files, findings, "repo")

    rows = [_text(f"| {s.capitalize()} findings | ", F.col(s), " |\n") for s in SEVERITIES]
    head = _text(
        "# Sensitive data report\n\n**Repository:** ", F.col("repo"), "\n\n## Summary\n\n| Metric | Value |\n|---|---|\n",
        "| Files scanned | ", F.col("scanned"), " |\n| Files with findings | ", F.col("with_findings"), " |\n", *rows,
    )

    def yes(column: str, no: str) -> Column:
        return F.when(F.col(column), "YES").otherwise(f"NO - {no}")

    state = _text(
        "## Status\n\n- **HIPAA:** ", yes("hipaa_compliant", "health data found"),
        "\n- **PCI:** ", yes("pci_compliant", "payment card data found"),
        "\n- **AI safe:** ", yes("ai_safe", "blocked"), "\n",
        F.when(F.col("ai_safe"), "").otherwise(_text("\n> ", F.col("ai_blocked_reason"), "\n")),
    )

    critical = findings.filter(F.col("severity") == "critical")
    critical_row = _text(
        "| `", F.col("path"), "` | ", F.col("line_number"), " | ", F.col("description"), " | ", F.upper("category"), " | ",
        F.col("recommendation"), " |",
    )
    high = report_head(findings, "repo", ["path", "line_number", "pattern"])
    high_row = _text(
        "| `", F.col("path"), "` | ", F.col("line_number"), " | ", F.col("description"), " | ", F.upper("category"), " |"
    )
    more = high.filter((F.col("rank") == 1) & (F.col("more") > 0))
    medium = medium_by_category(findings, "repo")
    has_critical, has_high = counts.filter(F.col("critical") > 0), counts.filter(F.col("high") > 0)
    has_medium = counts.filter(F.col("medium") > 0)

    return union_all([
        _block(summary, 10, head),
        _block(status, 20, state),
        _block(has_critical, 30, F.lit("## Critical findings\n\n| File | Line | Issue | Category | Recommendation |\n|---|---|---|---|---|")),
        _block(critical, 31, critical_row, F.col("path"), F.col("line_number"), F.col("pattern")),
        _block(has_high, 40, F.lit("\n## High findings\n\n| File | Line | Issue | Category |\n|---|---|---|---|")),
        _block(high, 41, high_row, F.col("path"), F.col("line_number"), F.col("pattern")),
        _block(more, 42, _text("| ... | ... | *", F.col("more"), " more findings* | ... |")),
        _block(has_medium, 50, _text("\n## Medium findings\n\n*", F.col("medium"), " findings.*\n")),
        # Largest category first: the order key is the count turned round.
        _block(medium, 51, _text("- ", F.upper("category"), ": ", F.col("findings")), F.lpad((F.lit(10**15) - F.col("findings")).cast("string"), 16, "0"), None, F.col("category")),
        _block(summary, 60, F.lit("\n" + CLOSING)),
    ])


def compliance_report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Report text per repository; a very long report continues in further parts.

    The findings feed ten kinds of blocks. They are written once, so the text
    of the files is scanned a single time.
    """
    return assemble(compliance_report_blocks(files.select("repo", "path"), settle(findings)), ["repo"], ORDER, "text")
