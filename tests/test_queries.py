"""Registered queries against their SQL. CHECK_ALL=1 compares every query instead of one of each kind."""

from __future__ import annotations

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries

SOME = [
    "scannable_files", "explode_lines_documents", "categorize", "importance_score", "config_files", "scan_level_thorough",
    "scan_repository", "redact_corpus_planted", "ai_safe_documents", "compliance_status", "severity_rollup", "compliance_report",
    "dependencies", "env_variables", "entry_points", "ci_workflows", "protected_branches", "symbols", "humanize_symbol",
    "directory_summaries", "doc_needs", "priority_rank_12", "important_files", "markdown_table_cells", "markdown_spans", "clean_text",
    "assemble_profile", "section_requests", "sections_architecture_guide", "stream_gate", "write_documents", "write_report", "write_profile",
]
OWN = {name for name in queries() if not re.match(r"op\d+_|pipeline$", name)}  # the others have tests of their own
NAMES = sorted(OWN) if os.environ.get("CHECK_ALL") else SOME


def rows(columns, values):
    return sorted(repr([v for _, v in sorted(zip(columns, row))]) for row in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = queries()[name](spark, sf_dir)
    expected = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())


def test_every_query_has_sql():
    assert OWN <= set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["stream_gate", "stream_scan"])
def test_streams_over_a_table_of_many_files(spark, sf_dir, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found, expected = (queries()[name](spark, folder) for folder in (str(tmp_path), sf_dir))
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.collect()) != []


@pytest.mark.parametrize("name", ["stream_gate", "stream_scan"])
def test_streams_over_a_table_in_key_folders(spark, sf_dir, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.partitionBy("lang", "source").parquet(str(tmp_path / "documents.parquet"))
    found, expected = (queries()[name](spark, folder) for folder in (str(tmp_path), sf_dir))
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.collect()) != []
