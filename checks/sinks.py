"""Writers, checked by reading back what they wrote to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import Registry, feature_sql, tree
from checks.documents import BODIES, CTES, DOCUMENTS, blocks_sql
from checks.documents import tables as document_tables
from checks.scan import registry as scans
from codestrata.plans import documents as DO
from codestrata.plans.profile import assemble_profile, profile_tables
from codestrata.sources import sinks as S
from codestrata.sources.tables import shared_folder
from codestrata.sources.trees import scan_files as scan_tree

registry = Registry()
add = registry.add


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_documents(s, d):
    folder = fresh(s, "documents")
    S.write_documents(DO.repo_documents(document_tables(s, d)), folder, as_text=True)
    return S.read_documents(s, folder).withColumn("body", F.md5("body"))


def write_report(s, d):
    folder = fresh(s, "report")
    S.write_report(scans.queries["compliance_report"](s, d), folder)
    return s.read.parquet(folder)


def write_profile(s, d):
    folder, tables = fresh(s, "profile"), profile_tables(tree(s, d))
    S.write_profile(tables, assemble_profile(tables), folder, ["doc_needs"])
    needs = s.read.json(f"{folder}/doc_needs").groupBy("repo").agg(F.count("*").alias("needs"))
    return s.read.json(f"{folder}/profile").select("repo", "total_files").join(needs, "repo", "left")


def scan_files(s, d):
    """The tree written to a folder, read back as files, each by its name; a line break follows every text."""
    folder = fresh(s, "tree")
    S.write_named(tree(s, d), folder, "repo", "path", "content")
    found = scan_tree(s, folder)
    return found.select("repo", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), F.md5("content").alias("content"), "size_bytes")


def named_documents(s, d):
    folder = fresh(s, "named")
    S.write_named(DO.repo_documents(document_tables(s, d)), folder, order="part")
    return S.read_named(s, folder).select(F.col("folder").alias("repo"), "filename", F.md5("body").alias("body"))


add("scan_files", scan_files, feature_sql("SELECT repo, path, md5(coalesce(content, '') || chr(10)) AS content, octet_length(encode(coalesce(content, ''))) + 1 AS size_bytes FROM files"))
add("named_documents", named_documents,
    feature_sql("SELECT repo, replace(upper(doc_type), '-', '_') || '.md' AS filename, md5(body || chr(10)) AS body FROM bodies", *CTES, blocks_sql(list(DOCUMENTS)), BODIES))
add("write_documents", write_documents,
    feature_sql("SELECT repo, replace(upper(doc_type), '-', '_') || '.md' AS filename, md5(body || chr(10)) AS body FROM bodies", *CTES, blocks_sql(list(DOCUMENTS)), BODIES))
add("write_report", write_report, scans.sql["compliance_report"])
add("write_profile", write_profile, feature_sql(
    "SELECT repo, total_files, needs FROM (SELECT repo, count(*) AS total_files FROM kept GROUP BY repo) LEFT JOIN (SELECT repo, count(*) AS needs FROM needs GROUP BY repo) USING (repo)", *CTES))
