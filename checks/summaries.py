"""Counts, directory summaries, decisions, priorities and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import KEPT, Registry, docs, feature_sql, hit_case, in_list, text_list, tree, tree_sql
from checks.facts import (
    ENDPOINTS, ENTRY_CTES, ENV_CTES, MARKERS, SCRIPTS, START, SYMBOL_CTES, big,
)
from codestrata.functions import paths as P
from codestrata.operators import decisions as D
from codestrata.operators import facts as FA
from codestrata.operators import features as FT
from codestrata.operators import priority as PR
from codestrata.operators import summaries as SU
from codestrata.operators.ordering import head_per_group
from codestrata.plans.context import route_by_size

registry = Registry()
add = registry.add


def features(s, d):
    return FT.file_features(tree(s, d))


add("language_counts", lambda s, d: SU.language_counts(features(s, d)),
    feature_sql("SELECT repo, language, count(*) AS files FROM feat GROUP BY ALL"))
add("category_counts", lambda s, d: SU.category_counts(features(s, d)),
    feature_sql("SELECT repo, category, count(*) AS files FROM feat GROUP BY ALL"))
add("detected_tools_frameworks",
    lambda s, d: FA.repo_markers(tree(s, d)).groupBy("repo").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "tool", F.col("marker")))), ", ").alias("tools"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "framework", F.col("marker")))), ", ").alias("frameworks")),
    tree_sql("""SELECT repo, coalesce(string_agg(marker, ', ' ORDER BY marker) FILTER (kind = 'tool'), '') AS tools,
      coalesce(string_agg(marker, ', ' ORDER BY marker) FILTER (kind = 'framework'), '') AS frameworks FROM markers GROUP BY repo""", KEPT, MARKERS))


def counted_sql(column: str, n: int = 1000) -> str:
    return f"""(SELECT repo, string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) AS {column} FROM (
      SELECT repo, v, n FROM (SELECT repo, {column} AS v, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, {column}) AS rk FROM feat GROUP BY repo, {column})
      WHERE rk <= {n}) GROUP BY repo)"""


add("top_counter", lambda s, d: SU.top_counter(features(s, d)),
    feature_sql(f"SELECT repo, l.language AS languages, c.category AS categories FROM {counted_sql('language', 5)} l JOIN {counted_sql('category', 5)} c USING (repo)"))
SUFFIX_SQL = """
suf AS (SELECT repo, CASE WHEN suffix = '' THEN 'no-ext' ELSE suffix END AS suffix, path FROM feat),
by_ext AS (SELECT repo, suffix, count(*) AS files, CASE WHEN count(*) <= 3 THEN string_agg(path, ', ' ORDER BY path)
    ELSE array_to_string(list_sort(list(path))[1:2], ', ') || '... and ' || (count(*) - 2) || ' more' END AS sample FROM suf GROUP BY ALL)"""
add("files_by_extension", lambda s, d: SU.files_by_extension(features(s, d), P.file_suffix("path"), 3, 2),
    feature_sql("SELECT * FROM by_ext", SUFFIX_SQL))
add("extension_groups_by_size", lambda s, d: SU.extension_groups_by_size(features(s, d), P.file_suffix("path")),
    feature_sql("SELECT repo, suffix, files FROM by_ext", SUFFIX_SQL))
add("symbol_totals", lambda s, d: SU.symbol_totals(FA.symbols(tree(s, d))),
    feature_sql("SELECT repo, count(*) FILTER (symbol_type <> 'function') AS classes, count(*) FILTER (symbol_type = 'function') AS functions FROM symbols GROUP BY repo", *SYMBOL_CTES))
add("majority_category", lambda s, d: features(s, d).groupBy("repo", "dir_key").agg(SU.majority_category().alias("majority_category")),
    feature_sql("""SELECT repo, dir_key, category AS majority_category FROM (SELECT *, row_number() OVER (PARTITION BY repo, dir_key ORDER BY n DESC, category) AS rk FROM (
      SELECT repo, dir_key, category, count(*) AS n FROM feat GROUP BY ALL)) WHERE rk = 1"""))

TOP_SYMBOLS = """
top_sym AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, dir_key ORDER BY docstring = '', name, path, pos) AS rank FROM symbols) WHERE rank <= 50)"""
add("top_symbols", lambda s, d: big()(SU.top_symbols(FA.symbols(tree(s, d)), 3).select("repo", "dir_key", "name", "path", "rank")),
    feature_sql("SELECT repo, dir_key, name, path, rank FROM top_sym WHERE rank <= 3", *SYMBOL_CTES, TOP_SYMBOLS))
add("per_group_head", lambda s, d: big()(head_per_group(features(s, d), ["repo", "category"], ["path"], 2).select("repo", "category", "path", "rank")),
    feature_sql("SELECT repo, category, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, category ORDER BY path) AS rank FROM feat) WHERE rank <= 2"))


def names_sql(alias: str, condition: str) -> str:
    return f"""
{alias}_n AS (SELECT DISTINCT repo, dir_key, name FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY pos) AS rk FROM symbols WHERE {condition}) WHERE rk <= 10),
{alias}_t AS (SELECT repo, dir_key, count(DISTINCT name) AS n FROM symbols WHERE {condition} GROUP BY ALL),
{alias}_e AS (SELECT repo, dir_key, least(count(*), 30) AS n FROM {alias}_n GROUP BY ALL),
{alias} AS (SELECT repo, dir_key, string_agg(name, ', ' ORDER BY name) AS {alias} FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, dir_key ORDER BY name) AS rk FROM {alias}_n) WHERE rk <= 30 GROUP BY ALL)"""


DIRECTORIES = f"""
dir_n AS (SELECT repo, dir_key, count(*) AS file_count FROM feat GROUP BY ALL),
dir_lang AS (SELECT repo, dir_key, string_agg(language || ' (' || n || ')', ', ' ORDER BY n DESC, language) AS languages FROM (SELECT repo, dir_key, language, count(*) AS n FROM feat GROUP BY ALL) GROUP BY ALL),
dir_cat AS (SELECT repo, dir_key, string_agg(category || ' (' || n || ')', ', ' ORDER BY n DESC, category) AS categories,
    (list(category ORDER BY n DESC, category))[1] AS majority FROM (SELECT repo, dir_key, category, count(*) AS n FROM feat GROUP BY ALL) GROUP BY ALL),
dir_keys AS (SELECT repo, dir_key, string_agg(path, ', ' ORDER BY path) AS key_files FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, dir_key ORDER BY path) AS rk FROM feat WHERE score10 >= 3 OR is_entry_point) WHERE rk <= 10 GROUP BY ALL),
dir_keys_t AS (SELECT repo, dir_key, greatest(count(*) - 10, 0) AS n FROM feat WHERE score10 >= 3 OR is_entry_point GROUP BY ALL),
{names_sql('classes', "symbol_type <> 'function'")}, {names_sql('functions', "symbol_type = 'function'")},
dir_sym AS (SELECT repo, dir_key, count(*) AS symbols FROM symbols GROUP BY ALL),
directories AS (
  SELECT repo, dir_key, file_count, languages, categories, coalesce(key_files, '') AS key_files, coalesce(classes, '') AS classes, coalesce(functions, '') AS functions,
    coalesce(symbols, 0) AS symbols, coalesce(dir_keys_t.n, 0) AS key_files_left,
    coalesce(classes_t.n - classes_e.n, 0) AS classes_left, coalesce(functions_t.n - functions_e.n, 0) AS functions_left, coalesce({hit_case('lower(dir_key)', P.DIRECTORY_PURPOSES)}, upper(substring(majority, 1, 1)) || substring(majority, 2) || ' files') AS description
  FROM dir_n JOIN dir_lang USING (repo, dir_key) JOIN dir_cat USING (repo, dir_key) LEFT JOIN dir_keys USING (repo, dir_key)
    LEFT JOIN classes USING (repo, dir_key) LEFT JOIN functions USING (repo, dir_key) LEFT JOIN dir_sym USING (repo, dir_key) LEFT JOIN dir_keys_t USING (repo, dir_key)
    LEFT JOIN classes_t USING (repo, dir_key) LEFT JOIN classes_e USING (repo, dir_key) LEFT JOIN functions_t USING (repo, dir_key) LEFT JOIN functions_e USING (repo, dir_key)
)"""
add("directory_summaries",
    lambda s, d: SU.directory_summaries(features(s, d), FA.symbols(tree(s, d))).drop("majority_category")
    .withColumn("languages", SU.format_counts(F.col("languages"))).withColumn("categories", SU.format_counts(F.col("categories"))),
    feature_sql("SELECT * FROM directories", *SYMBOL_CTES, DIRECTORIES))
add("directory_purpose",
    lambda s, d: SU.directory_summaries(features(s, d), FA.symbols(tree(s, d))).select("repo", "dir_key", "description"),
    feature_sql("SELECT repo, dir_key, description FROM directories", *SYMBOL_CTES, DIRECTORIES))

# --- decisions ------------------------------------------------------------------------------------------------------

TOOLS_SQL = f"""(CASE WHEN lsuf = '.tf' THEN 1 ELSE 0 END + CASE WHEN lname IN ('playbook.yml', 'playbook.yaml', 'site.yml', 'ansible.cfg') THEN 1 ELSE 0 END
  + CASE WHEN lname IN ('chart.yaml', 'chart.yml') THEN 1 ELSE 0 END + CASE WHEN lname IN ('kustomization.yaml', 'kustomization.yml') THEN 1 ELSE 0 END
  + CASE WHEN lname IN ('pulumi.yaml', 'pulumi.yml') THEN 1 ELSE 0 END + CASE WHEN contains(lpath, 'cloudformation') OR lname LIKE '%.template' THEN 1 ELSE 0 END)"""
INFRA = f"""
infra AS (SELECT repo, sum(2.0 * {TOOLS_SQL} + CASE WHEN lsuf IN {in_list(P.INFRA_SUFFIXES)} THEN 0.5 ELSE 0 END + CASE WHEN lname LIKE '%.tf' THEN 2 ELSE 0 END
    + CASE WHEN lname IN {in_list(P.TERRAFORM_NAMES)} THEN 3 ELSE 0 END + CASE WHEN lname IN {in_list(P.ANSIBLE_NAMES)} THEN 3 ELSE 0 END
    + CASE WHEN lname IN {in_list(P.HELM_NAMES)} THEN 3 ELSE 0 END + CASE WHEN lname IN {in_list(P.KUSTOMIZE_NAMES)} THEN 3 ELSE 0 END
    + CASE WHEN contains(lpath, 'cloudformation') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lpath, '{"|".join(P.INFRA_WORDS)}') THEN 1 ELSE 0 END)
    + CASE WHEN count(*) FILTER (category = 'infrastructure') > count(*) FILTER (category = 'application') THEN 3 ELSE 0 END AS score FROM feat GROUP BY repo)"""
add("infra_score", lambda s, d: D.infra_score(D.repo_facts(tree(s, d))).select("repo", "infra_score", "is_infra"),
    feature_sql("SELECT repo, score::DOUBLE AS infra_score, score >= 5 AS is_infra FROM infra", INFRA))

FACTS_CTES = [*ENTRY_CTES, *ENV_CTES[1:], SCRIPTS, ENDPOINTS, START, INFRA]
NEEDS = f"""
needs_f AS (SELECT repo, count(*) AS files, count(*) FILTER (category = 'application') AS application, count(*) FILTER (category = 'tests') AS tests,
    count(*) FILTER (category = 'examples') AS examples, count(*) FILTER (language = 'Python') AS python, count(*) FILTER (language = 'JavaScript') AS javascript,
    count(*) FILTER (language = 'YAML') AS yaml, count(*) FILTER (language = 'JSON') AS json, bool_or(lname IN {in_list(list(P.CONFIG_FORMATS))}) AS config,
    bool_or(lname = 'dockerfile') AS docker, bool_or(lname = 'makefile') AS make, bool_or(lname = 'package.json') AS npm,
    bool_or(regexp_matches(lpath, '{"|".join(P.DEPLOY_WORDS)}')) AS deploy, bool_or(contains(lpath, 'fastapi') OR contains(lpath, 'django')) AS framework
  FROM feat GROUP BY repo),
needs_b AS (SELECT *, (application > 0 OR python > 5 OR javascript > 5) AS app, (SELECT score >= 5 FROM infra WHERE infra.repo = f.repo) AS is_infra,
    EXISTS (SELECT 1 FROM envs WHERE envs.repo = f.repo) AS env, EXISTS (SELECT 1 FROM scripts WHERE scripts.repo = f.repo) AS script,
    EXISTS (SELECT 1 FROM endpoints WHERE endpoints.repo = f.repo) AS endpoint FROM needs_f f),
needs AS (SELECT repo, unnest(l) AS doc_type, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT repo, list_filter(['repository-overview',
    CASE WHEN app OR is_infra OR files > 10 THEN 'architecture-guide' END, CASE WHEN files > 5 THEN 'developer-workflows' END,
    CASE WHEN tests > 0 OR app OR is_infra THEN 'quality-and-validation' END, CASE WHEN is_infra OR env OR config OR yaml > 0 OR json > 3 THEN 'configuration-guide' END,
    CASE WHEN is_infra OR docker OR deploy THEN 'deployment-runbook' END, CASE WHEN is_infra OR script OR make OR npm THEN 'operations-runbook' END,
    CASE WHEN examples > 0 OR files > 20 THEN 'usage-patterns' END, CASE WHEN endpoint OR framework THEN 'api-reference' END], lambda x: x IS NOT NULL) AS l FROM needs_b))"""
add("doc_needs", lambda s, d: big()(D.doc_needs(D.repo_facts(tree(s, d)))),
    feature_sql("SELECT repo, doc_type, ord FROM needs", *FACTS_CTES, NEEDS))
add("doc_needs_all", lambda s, d: big()(D.doc_needs(D.repo_facts(tree(s, d)), True)),
    feature_sql(f"SELECT repo, unnest({text_list(D.DOCUMENT_TYPES)}) AS doc_type, generate_subscripts({text_list(D.DOCUMENT_TYPES)}, 1) - 1 AS ord FROM (SELECT DISTINCT repo FROM feat)"))

# --- priorities -----------------------------------------------------------------------------------------------------


def priority_sql(max_files: int) -> str:
    return f"""
pr0 AS (SELECT *, name IN {in_list(PR.MUST_HAVE)} AS must, category = 'examples' AND language = 'Python' AS ex, category = 'application' AND score10 >= 3 AS app FROM feat),
pr1 AS (SELECT *, CASE WHEN ex THEN row_number() OVER (PARTITION BY repo, ex ORDER BY score10 DESC, path) END AS ex_n,
    CASE WHEN app THEN row_number() OVER (PARTITION BY repo, app ORDER BY score10 DESC, path) END AS app_n FROM pr0),
pr2 AS (SELECT *, CASE WHEN must THEN 1 WHEN is_entry_point THEN 2 WHEN ex_n <= 5 THEN 3 WHEN app_n <= 10 THEN 4 ELSE 5 END AS tier FROM pr1),
pr3 AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tier, CASE WHEN tier = 1 THEN 0 ELSE -score10 END, path) AS rank FROM pr2),
prio AS (SELECT * FROM pr3 WHERE tier < 5 OR rank <= {max_files})"""


for n in (30, 15, 12):
    add(f"priority_rank_{n}", lambda s, d, n=n: big()(PR.priority_rank(features(s, d), n)),
        feature_sql("SELECT repo, path, tier, score10, rank FROM prio", priority_sql(n)))


def budget_sql(limit: int) -> str:
    return f"""
bud AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY repo ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM prio WHERE content <> ''),
important AS (SELECT repo, path, content, row_number() OVER (PARTITION BY repo ORDER BY rank) AS rank FROM bud WHERE before < {limit})"""


add("important_files", lambda s, d: big()(PR.important_files(tree(s, d), features(s, d), 30, 4000)),
    feature_sql("SELECT repo, path, content, rank FROM important", priority_sql(30), budget_sql(4000)))
add("context_budget_documents",
    lambda s, d: PR.context_budget(docs(s, d).select("source", "doc_id", F.length("text").cast("bigint").alias("chars")), ["source"], ["doc_id"], "chars", 20000)
    .select("source", "doc_id", "chars", "chars_before"),
    """SELECT source, doc_id, chars, CAST(before AS BIGINT) AS chars_before FROM (SELECT source, doc_id, length(text) AS chars,
      coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE text <> '')
    WHERE before < 20000""")
add("route_by_size",
    lambda s, d: route_by_size(docs(s, d).groupBy("source").agg(F.sum(F.length("text")).alias("chars")), "chars", 25000).select("source", "tokens", "route"),
    "SELECT source, sum(length(text)) // 4 AS tokens, CASE WHEN sum(length(text)) // 4 > 25000 THEN 'chunked' ELSE 'whole' END AS route FROM documents GROUP BY source")
