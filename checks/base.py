"""Inputs shared by the registered queries and by their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.sources.samples import sample_sql, sample_view
from codestrata.sources.trees import IGNORED_FOLDERS

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and their SQL under one name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None) -> None:
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql


# --- Spark inputs ---------------------------------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """``name`` under ``sf_dir``. The small tables are files of a few row groups, which as many tasks would read: their rows are dealt out.

    Which tasks have rows is told by the files' footers. A table of more row groups than cores is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    busy = df.select(F.spark_partition_id().alias("task")).distinct().limit(cores).count()
    return df if busy >= cores else df.repartition(cores, *keys)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations", "conv_id", "turn")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", "page_id")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of repositories derived from the documents."""
    table = docs(spark, sf_dir)
    return sample_view(table, "files").unionByName(sample_view(table, "host_files"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sample_view(docs(spark, sf_dir), name)


def joined(column: str, separator: str = "|") -> F.Column:
    """Array of strings as one string, so that both engines compare it as text."""
    return F.array_join(F.col(column), separator)


# --- SQL inputs -----------------------------------------------------------------------------------------------------


def text_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def in_list(values: list[str]) -> str:
    return "(" + text_list(values)[1:-1] + ")"


def _map_case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def hit_case(column: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{k}') THEN '{v}'" for k, v in rules) + " END"


TREE = f"files AS ({sample_sql('files')} UNION ALL {sample_sql('host_files')})"

KEPT = f"""
kept AS (
  SELECT repo, path, coalesce(content, '') AS content, size_bytes, string_split(path, '/') AS seg,
    string_split(lower(path), '/') AS lseg, len(string_split(path, '/')) AS depth,
    regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/]*$')) AS lname, lower(path) AS lpath,
    regexp_extract(regexp_extract(path, '[^/]*$'), '^.+([.][^.]+)$', 1) AS suffix,
    lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+([.][^.]+)$', 1)) AS lsuf,
    regexp_replace(regexp_extract(path, '[^/]*$'), '(.)[.][^.]+$', '\\1') AS stem
  FROM files WHERE NOT list_has_any(string_split(path, '/'), {text_list(IGNORED_FOLDERS)})
)"""

FEATURES = f"""
feat0 AS (
  SELECT *, coalesce({_map_case('lsuf', P.LANGUAGES)}, 'Other') AS language,
    CASE WHEN lsuf IN {in_list(P.DOC_SUFFIXES)} OR list_contains(lseg, 'docs') THEN 'documentation'
      WHEN list_has_any(lseg, ['test', 'tests']) OR starts_with(lname, 'test_') THEN 'tests'
      WHEN list_contains(lseg, 'scripts') OR lname LIKE '%.sh' THEN 'automation'
      WHEN list_has_any(lseg, ['infra', '.github']) OR contains(lname, 'docker') THEN 'infrastructure'
      WHEN list_has_any(lseg, {text_list(P.APPLICATION_FOLDERS)}) THEN 'application'
      WHEN list_contains(lseg, 'examples') THEN 'examples' ELSE 'misc' END AS category,
    lname IN {in_list(P.ENTRY_NAMES)} AS is_entry_point
  FROM kept
),
feat AS (
  SELECT *,
    CASE category WHEN 'infrastructure' THEN 'operational' WHEN 'application' THEN 'architecture' WHEN 'tests' THEN 'quality'
      ELSE CASE WHEN contains(lname, 'api') OR contains(lname, 'schema') THEN 'interface'
                WHEN category = 'automation' THEN 'workflow' ELSE 'overview' END END AS doc_signal,
    least(10, (CASE WHEN is_entry_point THEN 4 ELSE 0 END) + (CASE WHEN lname IN {in_list(P.IMPORTANT_NAMES)} THEN 3 ELSE 0 END)
      + (CASE WHEN category = 'application' THEN 2 ELSE 0 END)
      + (CASE WHEN category IN ('infrastructure', 'automation') THEN 1 ELSE 0 END) + (CASE WHEN depth <= 2 THEN 1 ELSE 0 END)) AS score10,
    CASE WHEN depth > 2 THEN seg[1] || '/' || seg[2] WHEN depth = 2 THEN seg[1] ELSE 'root' END AS dir_key
  FROM feat0
)"""

MANIFEST_LINES = """
ml AS (
  SELECT repo, path, name, unnest(string_split(content, chr(10))) AS line,
    generate_subscripts(string_split(content, chr(10)), 1) AS ln
  FROM kept
)"""

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(expression: str) -> str:
    return f"trim({expression}, {BLANK})"


def tree_sql(body: str, *ctes: str) -> str:
    """SQL over the file view with the named common table expressions in front."""
    return "WITH " + ",\n".join([TREE, *ctes]) + "\n" + body


def feature_sql(body: str, *ctes: str) -> str:
    return tree_sql(body, KEPT, FEATURES, *ctes)


def view_sql(name: str, body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([f"{name} AS ({sample_sql(name)})", *ctes]) + "\n" + body
