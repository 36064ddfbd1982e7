"""File sources, per-file features, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    KEPT, Registry, conversations, docs, feature_sql, hit_case, in_list, pages, text_list, tree, tree_sql, view,
    view_sql,
)
from codestrata.functions import naming as N
from codestrata.functions import paths as P
from codestrata.operators import features as FT
from codestrata.sources import lines as L
from codestrata.sources import trees as T

registry = Registry()
add = registry.add

BREAK = r"\r\n|[\n\v\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines_sql(key: str, table: str, text: str) -> str:
    return f"""
    SELECT {key}, CAST(ln AS BIGINT) AS line_number, line FROM (
      SELECT {key}, unnest(parts) AS line, generate_subscripts(parts, 1) AS ln, len(parts) AS n
      FROM (SELECT {key}, string_split_regex({text}, '{BREAK}') AS parts FROM {table}))
    WHERE NOT (ln = n AND line = '')"""


add("ignore_dirs", lambda s, d: T.ignore_dirs(tree(s, d)).select("repo", "path"),
    tree_sql("SELECT repo, path FROM kept", KEPT))

SCANNABLE_SQL = f"""
scannable AS (
  SELECT repo, path, content, size_bytes FROM (
    SELECT *, regexp_extract(path, '[^/]*$') AS name FROM files)
  WHERE NOT list_has_any(string_split(path, '/'), {text_list(T.SCAN_SKIPPED)})
    AND lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) NOT IN {in_list(T.SCAN_SKIPPED)}
    AND name NOT IN {in_list(T.LOCK_FILES)}
)"""
add("scannable_files", lambda s, d: T.scannable_files(tree(s, d)).select("repo", "path", "size_bytes"),
    tree_sql("SELECT repo, path, size_bytes FROM scannable", SCANNABLE_SQL))
add("scannable_small_files", lambda s, d: T.scannable_files(tree(s, d), 1000).select("repo", "path", "size_bytes"),
    tree_sql("SELECT repo, path, size_bytes FROM scannable WHERE size_bytes <= 1000", SCANNABLE_SQL))

add("capped_content",
    lambda s, d: docs(s, d).select("doc_id", T.capped_text(F.col("text"), 1000).alias("content")),
    "SELECT doc_id, coalesce(substring(text, 1, 1000), '') AS content FROM documents")

add("explode_lines_documents", lambda s, d: L.explode_lines(docs(s, d), ["doc_id"], "text"), lines_sql("doc_id", "documents", "text"))
add("explode_lines_conversations",
    lambda s, d: L.explode_lines(conversations(s, d), ["conv_id", "turn"], "text"),
    lines_sql("conv_id, turn", "conversations", "text"))
add("explode_lines_pages", lambda s, d: L.explode_lines(pages(s, d), ["page_id"], "html"), lines_sql("page_id", "pages", "html"))
add("text_source", lambda s, d: L.text_source(conversations(s, d), ["conv_id", "turn"], "text"),
    "SELECT conv_id, turn, text AS content FROM conversations")

add("file_parts",
    lambda s, d: FT.file_parts(tree(s, d)).withColumn("depth", F.col("depth").cast("bigint")),
    tree_sql("""SELECT repo, path, name, lname AS lower_name, suffix, depth
      FROM (SELECT repo, path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/]*$')) AS lname,
        regexp_extract(regexp_extract(path, '[^/]*$'), '^.+([.][^.]+)$', 1) AS suffix, len(string_split(path, '/')) AS depth FROM files)"""))

add("url_parts",
    lambda s, d: pages(s, d).select(
        "page_id", P.file_name("url").alias("name"), P.file_suffix("url").alias("suffix"), P.directory_key("url").alias("dir_key"),
        P.depth("url").cast("bigint").alias("depth")),
    """SELECT page_id, seg[-1] AS name, regexp_extract(seg[-1], '^.+([.][^.]+)$', 1) AS suffix,
      CASE WHEN len(seg) > 2 THEN seg[1] || '/' || seg[2] WHEN len(seg) = 2 THEN seg[1] ELSE 'root' END AS dir_key, len(seg) AS depth
    FROM (SELECT page_id, string_split(url, '/') AS seg FROM pages)""")


def feature_query(*columns: str):
    return lambda s, d: FT.file_features(tree(s, d)).select("repo", "path", *columns)


for column in ("language", "category", "doc_signal", "is_entry_point", "dir_key"):
    name = {"language": "detect_language", "category": "categorize"}.get(column, column)
    add(name, feature_query(column), feature_sql(f"SELECT repo, path, {column} FROM feat"))
add("importance_score", feature_query("importance_score"), feature_sql("SELECT repo, path, score10 / 10.0::DOUBLE AS importance_score FROM feat"))
add("existing_docs", lambda s, d: FT.existing_docs(tree(s, d)),
    feature_sql(f"SELECT repo, path FROM feat WHERE lsuf IN {in_list(P.DOC_SUFFIXES)}"))
add("config_files", lambda s, d: FT.config_files(tree(s, d)), feature_sql(
    f"""SELECT repo, path, {"CASE lname " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.CONFIG_FORMATS.items()) + " END"} AS config_type,
      coalesce({hit_case('lname', P.CONFIG_PURPOSES)}, 'Configuration') AS purpose
    FROM feat WHERE lname IN {in_list(list(P.CONFIG_FORMATS))}"""))
add("key_files", lambda s, d: FT.is_key_file(FT.file_features(tree(s, d))).select("repo", "path", "score10"),
    feature_sql("SELECT repo, path, score10 FROM feat WHERE score10 >= 3 OR is_entry_point"))
add("by_importance", lambda s, d: FT.by_importance(FT.file_features(tree(s, d))).select("repo", "path", "importance_score"),
    feature_sql("SELECT repo, path, score10 / 10.0::DOUBLE AS importance_score FROM feat ORDER BY repo, score10 DESC, path"))

add("document_identity",
    lambda s, d: view(s, d, "responses").select("repo", "doc_type").distinct().select(
        "repo", "doc_type", N.document_filename(F.col("doc_type")).alias("filename"),
        N.document_title(F.col("repo"), F.col("doc_type")).alias("title"), N.control_id(F.col("repo"), F.col("doc_type")).alias("control_id")),
    view_sql("responses", """SELECT DISTINCT repo, doc_type, replace(upper(doc_type), '-', '_') || '.md' AS filename,
      repo || ' ' || CASE doc_type WHEN 'repository-overview' THEN 'Repository Overview' WHEN 'architecture-guide' THEN 'Architecture Guide'
        ELSE 'Quality And Validation' END AS title,
      'DOC-' || substring(upper(repo), 1, 10) || '-' || substring(upper(doc_type), 1, 15) AS control_id FROM responses"""))
add("estimated_tokens_documents", lambda s, d: docs(s, d).select("doc_id", N.estimated_tokens(F.col("text")).alias("tokens")),
    "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
add("estimated_tokens_conversations",
    lambda s, d: conversations(s, d).groupBy("conv_id").agg(F.sum(N.estimated_tokens(F.col("text"))).alias("tokens")),
    "SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
