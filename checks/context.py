"""Profiles, evidence text, requests and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, feature_sql, sample_sql, text_list, tree, view
from checks.facts import (
    CI, DEPS_CTES, ENTRY_CTES, ENV_CTES, ENDPOINTS, HOSTING, MARKERS, SCRIPTS, SYMBOL_CTES, big,
)
from checks.markdown import RULES, rule_ctes
from checks.summaries import DIRECTORIES, INFRA, NEEDS, TOP_SYMBOLS, budget_sql, priority_sql
from codestrata.functions import paths as P
from codestrata.functions.naming import DOCUMENT_TITLES
from codestrata.operators import decisions as D
from codestrata.operators.decisions import doc_needs, repo_facts
from codestrata.operators.summaries import format_counts
from codestrata.plans import context as G
from codestrata.plans import profile as PF

registry = Registry()
add = registry.add

ALL = [*DEPS_CTES, *ENV_CTES[1:], *ENTRY_CTES[1:], SCRIPTS, ENDPOINTS, CI, HOSTING, MARKERS, INFRA, NEEDS, *SYMBOL_CTES, TOP_SYMBOLS, DIRECTORIES]


def tables(s, d):
    return PF.profile_tables(tree(s, d))


def counts_sql(column: str) -> str:
    return f"""(SELECT repo, string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) AS x FROM (
      SELECT repo, {column} AS v, count(*) AS n FROM feat GROUP BY ALL) GROUP BY repo)"""


HEAD = f"""
head AS (SELECT f.repo, f.files, l.x AS languages, c.x AS categories, coalesce(tools, '') AS tools, coalesce(frameworks, '') AS frameworks
  FROM (SELECT repo, count(*) AS files FROM feat GROUP BY repo) f JOIN {counts_sql('language')} l USING (repo) JOIN {counts_sql('category')} c USING (repo)
  LEFT JOIN (SELECT repo, string_agg(marker, ', ' ORDER BY marker) FILTER (kind = 'tool') AS tools,
    string_agg(marker, ', ' ORDER BY marker) FILTER (kind = 'framework') AS frameworks FROM markers GROUP BY repo) m USING (repo))"""

SIZES = {"dependencies": "deps", "env_variables": "envs", "entry_points": "entries", "scripts": "scripts", "api_endpoints": "endpoints",
         "ci_workflows": "workflows", "directories": "directories"}
PROFILE = f"""
profile AS (SELECT repo, files AS total_files, languages, categories, replace(tools, ', ', '|') AS tools, replace(frameworks, ', ', '|') AS frameworks,
    {", ".join(f"(SELECT count(*) FROM {t} x WHERE x.repo = head.repo) AS n_{n}" for n, t in SIZES.items())},
    (SELECT count(*) FROM feat x WHERE x.repo = head.repo AND lname IN {tuple(P.CONFIG_FORMATS)}) AS n_config_files,
    (SELECT count(*) FROM feat x WHERE x.repo = head.repo AND lsuf IN ('.md', '.mdx', '.rst', '.adoc')) AS n_existing_docs,
    (SELECT count(*) FROM symbols x WHERE x.repo = head.repo AND symbol_type <> 'function') AS classes,
    (SELECT count(*) FROM symbols x WHERE x.repo = head.repo AND symbol_type = 'function') AS functions,
    (SELECT string_agg(doc_type, '|' ORDER BY ord) FROM needs x WHERE x.repo = head.repo) AS doc_needs,
    (SELECT score::DOUBLE FROM infra x WHERE x.repo = head.repo) AS infra_score, (SELECT score >= 5 FROM infra x WHERE x.repo = head.repo) AS is_infra
  FROM head)"""


def profile_rows(s, d):
    out = PF.assemble_profile(tables(s, d))
    return out.withColumns({
        "languages": format_counts(F.col("languages")), "categories": format_counts(F.col("categories")),
        "tools": F.array_join("tools", "|"), "frameworks": F.array_join("frameworks", "|"), "doc_needs": F.array_join("doc_needs", "|"),
    })


add("assemble_profile", profile_rows, feature_sql("SELECT * FROM profile", *ALL, HEAD, PROFILE))
add("profile_json",
    lambda s, d: PF.profile_json(profile_rows(s, d)).select(
        "repo", *[F.get_json_object("json", f"$.{k}").alias(k) for k in ("total_files", "languages", "tools", "classes", "doc_needs")]),
    feature_sql("SELECT repo, CAST(total_files AS VARCHAR) AS total_files, languages, tools, CAST(classes AS VARCHAR) AS classes, doc_needs FROM profile", *ALL, HEAD, PROFILE))


def listed_sql(alias: str, table: str, order: str, item: str, limit: int, title: str, sep: str) -> str:
    """A counted list: all in one row per repository."""
    join = "chr(10)" if sep == "\n" else "', '"
    gap = "chr(10)" if sep == "\n" else "' '"
    return f"""
{alias} AS (SELECT repo, '{title} (' || max(n) || ' total):' || {gap} || string_agg(item, {join} ORDER BY rk) FILTER (rk <= {limit}) AS text FROM (
    SELECT repo, {item} AS item, row_number() OVER (PARTITION BY repo ORDER BY {order}) AS rk, count(*) OVER (PARTITION BY repo) AS n FROM {table}) GROUP BY repo)"""


def symbol_list_sql(kind: str, limit: int, signature: str) -> str:
    return f"""(SELECT string_agg('     - ' || name || {signature} || CASE WHEN docstring <> '' THEN ' - ' || docstring ELSE '' END, chr(10) ORDER BY rank) FROM (
      SELECT *, row_number() OVER (ORDER BY rank) AS rk FROM top_sym t WHERE t.repo = x.repo AND t.dir_key = x.dir_key AND symbol_type = '{kind}') WHERE rk <= {limit})"""


CONTEXT = ",".join([
    listed_sql("b_deps", "deps", "source_ord, pos", "name || coalesce('==' || version, '')", 40, "Dependencies", ", "),
    listed_sql("b_envs", "envs", "source_ord, source_file, pos", "'  ' || name || '=' || coalesce(default_value, '...')", 50, "Environment variables", "\n"),
    listed_sql("b_apis", "endpoints", "path, pos", "'  - ' || method || ' ' || endpoint || ' (' || path || ')'", 20, "API endpoints", "\n"),
    listed_sql("b_scripts", "scripts", "source_ord, pos", "'  - ' || name || ': ' || command", 25, "Scripts/Commands", "\n"),
]) + f""",
b_owners AS (SELECT repo, 'CODEOWNERS: ' || max(n) || ' rules defined' || chr(10) || string_agg('  ' || rule, chr(10) ORDER BY pos) FILTER (pos < 5)
    || CASE WHEN max(n) > 5 THEN chr(10) || '  ... and ' || (max(n) - 5) || ' more' ELSE '' END AS text FROM (SELECT *, count(*) OVER (PARTITION BY repo) AS n FROM owners) GROUP BY repo),
b_flags AS (SELECT repo, array_to_string(list_filter([CASE WHEN pr_template THEN 'PR Template: yes' END,
    CASE WHEN protected_branches <> '' THEN 'Protected Branches (inferred): ' || replace(protected_branches, '|', ', ') END,
    CASE WHEN release_drafter THEN 'Release Drafter: enabled' END, CASE WHEN auto_release THEN 'Automated Releases: detected' END], lambda x: x IS NOT NULL), chr(10)) AS text FROM flags),
b_dirs AS (SELECT repo, dir_key, '## ' || dir_key || '/ (' || file_count || ' files)' || chr(10) || '   Purpose: ' || description || chr(10) || '   Languages: ' || languages
    || coalesce(chr(10) || '   Classes:' || chr(10) || cl, '') || coalesce(chr(10) || '   Interfaces/Types:' || chr(10) || it, '') || coalesce(chr(10) || '   Functions:' || chr(10) || fu, '')
    || CASE WHEN key_files <> '' THEN chr(10) || '   Key files: ' || array_to_string(string_split(key_files, ', ')[1:5], ', ') ELSE '' END AS text FROM (
    SELECT *, {symbol_list_sql('class', 15, "CASE WHEN signature <> '' THEN '(' || signature || ')' ELSE '' END")} AS cl,
      {symbol_list_sql('interface', 10, "''")} AS it, {symbol_list_sql('function', 15, "CASE WHEN signature <> '' THEN signature ELSE '()' END")} AS fu FROM directories x)),
b_ext AS (SELECT repo, suffix || ' files (' || count(*) || '): ' || CASE WHEN count(*) <= 20 THEN string_agg(path, ', ' ORDER BY path)
    ELSE array_to_string(list_sort(list(path))[1:15], ', ') || '... and ' || (count(*) - 15) || ' more' END AS text, count(*) AS n
  FROM (SELECT repo, CASE WHEN suffix = '' THEN 'no-ext' ELSE suffix END AS suffix, path FROM feat) GROUP BY repo, suffix),
fund AS (SELECT repo, unnest(regexp_extract_all(content, '(?m)^([a-z_]+):', 1)) AS platform, generate_subscripts(regexp_extract_all(content, '(?m)^([a-z_]+):', 1), 1) AS i FROM pick WHERE what = 'FUNDING'),
ctx AS (
  SELECT repo, 10 AS section, '' AS k1, 0 AS k2, concat('# Repository: ', repo, chr(10), chr(10), 'Total files: ', files, chr(10), chr(10), 'Languages: ', languages, chr(10), chr(10), 'Categories: ', categories,
    chr(10), chr(10), 'Tools: ', tools, chr(10), chr(10), 'Frameworks: ', frameworks) AS text FROM head
  UNION ALL SELECT repo, 20, '', 0, text FROM b_deps UNION ALL SELECT repo, 30, '', 0, text FROM b_envs
  UNION ALL SELECT repo, 40, source_ord || ' ' || target, pos, '  - ' || name || ': ' || coalesce(command, entry_type) FROM entries
  UNION ALL SELECT repo, 50, '', 0, text FROM b_apis UNION ALL SELECT repo, 60, '', 0, text FROM b_scripts
  UNION ALL SELECT repo, 70, platform_ord || ' ' || path, 0, '## ' || name || ' (' || platform || ')' || chr(10) || '   File: ' || path
    || CASE WHEN triggers <> '' THEN chr(10) || '   Triggers: ' || replace(triggers, '|', ', ') ELSE '' END || CASE WHEN jobs <> '' THEN chr(10) || '   Jobs: ' || replace(jobs, '|', ', ') ELSE '' END
    || CASE WHEN environments <> '' THEN chr(10) || '   Environments: ' || replace(environments, '|', ', ') ELSE '' END || CASE WHEN secrets_used <> '' THEN chr(10) || '   Secrets: ' || replace(secrets_used, '|', ', ') ELSE '' END FROM workflows
  UNION ALL SELECT repo, 80, '', 0, text FROM b_owners
  UNION ALL SELECT repo, 81, '', 0, 'Dependabot: enabled for ' || array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'package-ecosystem:\\s*["'']?([a-z-]+)', 1))), ', ') FROM pick WHERE what = 'dependabot'
  UNION ALL SELECT repo, 82, path, 0, 'Issue Template: ' || template FROM templates
  UNION ALL SELECT repo, 83, action, 0, 'Custom Action: ' || action FROM actions
  UNION ALL SELECT repo, 84, '', 0, text FROM b_flags WHERE text <> ''
  UNION ALL SELECT repo, 85, '', row_number() OVER (PARTITION BY repo ORDER BY i) - 1, 'Funding: ' || platform FROM fund WHERE platform <> 'custom'
  UNION ALL SELECT repo, 90, dir_key, 0, text FROM b_dirs
  UNION ALL SELECT repo, 95, lpad(CAST(1000000000000000 - n AS VARCHAR), 16, '0') || ' ' || text, 0, text FROM b_ext
  UNION ALL SELECT repo, 99, '', rank, '## ' || path || chr(10) || '```' || chr(10) || content || chr(10) || '```' FROM important
)"""
CONTEXT_CTES = [*ALL, priority_sql(30), budget_sql(500000), HEAD, CONTEXT]
add("repo_context_blocks", lambda s, d: big()(G.repo_context_blocks(tables(s, d))),
    feature_sql("SELECT repo, section, k1, k2, text FROM ctx", *CONTEXT_CTES))
add("repo_context", lambda s, d: G.repo_context(tables(s, d)),
    feature_sql("SELECT repo, 1::BIGINT AS part, string_agg(text, chr(10) || chr(10) ORDER BY section, k1, k2) AS body FROM ctx GROUP BY repo", *CONTEXT_CTES))


def short_sql(title: str, table: str, order: str, item: str, limit: int, separator: str) -> str:
    """A list of the short evidence: its first items, and how many follow."""
    return f"""coalesce(chr(10) || '{title}:' || right({separator}, 1) || (
    SELECT string_agg(item, {separator} ORDER BY rk) FILTER (rk <= {limit}) || CASE WHEN count(*) > {limit} THEN {separator} || '... and ' || (count(*) - {limit}) || ' more' ELSE '' END
    FROM (SELECT {item} AS item, row_number() OVER (ORDER BY {order}) AS rk FROM {table} x WHERE x.repo = head.repo)), '')"""


def short_cte(limits: dict[str, int] = {}) -> str:  # noqa: B006
    lists = [
        ("dependencies", "Dependencies", "deps", "source_ord, pos", "name", 30, "', '"),
        ("env_variables", "Environment variables", "envs", "source_ord, source_file, pos", "name", 40, "', '"),
        ("scripts", "Scripts", "scripts", "source_ord, pos", "name || ': ' || command", 15, "'; '"),
        ("api_endpoints", "API endpoints", "endpoints", "path, pos", "method || ' ' || endpoint", 10, "', '"),
        ("ci_workflows", "CI/CD workflows", "workflows", "platform_ord, path", "name || ' (' || platform || ')'", 200, "', '"),
        ("directories", "Key directories", "directories", "dir_key", "'  ' || dir_key || ': ' || description", 10, "chr(10)"),
    ]
    return f"""
short AS (SELECT repo, concat('Repository: ', repo, chr(10), 'Total files: ', files, chr(10), 'Languages: ', languages, chr(10), 'Tools: ', tools, chr(10), 'Frameworks: ', frameworks,
    {", ".join(short_sql(title, table, order, item, limits.get(name, limit), separator) for name, title, table, order, item, limit, separator in lists)}) AS context FROM head)"""


SHORT = short_cte()
SHORT_CTES = [*ALL, HEAD, SHORT]
add("condensed_context", lambda s, d: G.condensed_context(tables(s, d)), feature_sql("SELECT * FROM short", *SHORT_CTES))
FEW = {"dependencies": 2, "env_variables": 1, "scripts": 1, "api_endpoints": 1, "ci_workflows": 1, "directories": 2}
add("condensed_context_few", lambda s, d: G.condensed_context(tables(s, d), FEW), feature_sql("SELECT * FROM short", *ALL, HEAD, short_cte(FEW)))

PLAN = "plan_rows AS (SELECT repo, doc_type, unnest(l) AS section_name, generate_subscripts(l, 1) AS section_ord, len(l) AS section_total FROM (SELECT repo, doc_type, CASE doc_type " + " ".join(
    f"WHEN '{k}' THEN {text_list(v)}" for k, v in G.SECTIONS.items()) + f" ELSE {text_list(G.DEFAULT_SECTIONS)} END AS l FROM needs))"
PLAN_COLUMNS = "repo, doc_type, section_ord, section_total, section_name"
add("section_plan", lambda s, d: big()(G.section_plan(doc_needs(repo_facts(tree(s, d))))),
    feature_sql(f"SELECT {PLAN_COLUMNS} FROM plan_rows", *ALL, PLAN))
ALL_TYPES = [*D.DOCUMENT_TYPES, "getting-started", "release-notes"]
add("section_plan_all_types",
    lambda s, d: big()(G.section_plan(view(s, d, "responses").select("repo").distinct().select("repo", F.explode(F.array(*[F.lit(t) for t in ALL_TYPES])).alias("doc_type")))),
    f"WITH needs AS (SELECT DISTINCT repo, unnest({text_list(ALL_TYPES)}) AS doc_type FROM ({sample_sql('responses')})), {PLAN} SELECT {PLAN_COLUMNS} FROM plan_rows")

RESPONSES = f"responses AS ({sample_sql('responses')})"
TITLE_SQL = "repo || ' ' || CASE doc_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DOCUMENT_TITLES.items()) + " END"
REQUESTS = f"""
headers AS (SELECT repo, doc_type, section_ord, (SELECT replace(line, '## ', '') FROM (SELECT unnest(string_split(r.body, chr(10))) AS line,
    generate_subscripts(string_split(r.body, chr(10)), 1) AS ln) WHERE starts_with(line, '## ') ORDER BY ln LIMIT 1) AS header FROM responses r),
requests AS (SELECT {PLAN_COLUMNS}, context AS evidence, {TITLE_SQL} AS title,
    coalesce((SELECT string_agg(header, ', ' ORDER BY h.section_ord) FROM headers h WHERE h.repo = p.repo AND h.doc_type = p.doc_type AND h.section_ord < p.section_ord), '') AS earlier
  FROM plan_rows p JOIN short USING (repo))"""
add("section_requests",
    lambda s, d: big()(G.section_requests(doc_needs(repo_facts(tree(s, d))), G.condensed_context(tables(s, d)), view(s, d, "responses")).withColumn("evidence", F.md5("evidence"))),
    feature_sql(f"SELECT {PLAN_COLUMNS}, md5(evidence) AS evidence, title, earlier FROM requests", *SHORT_CTES, PLAN, RESPONSES, REQUESTS))
MERGED = """
merged AS (SELECT p.repo, p.doc_type, p.section_ord, section_name, coalesce(body, '## ' || section_name || chr(10) || chr(10) || '*No text was produced for this section; it has to be written by hand.*') AS body,
    body IS NOT NULL AS answered FROM plan_rows p LEFT JOIN responses r ON r.repo = p.repo AND r.doc_type = p.doc_type AND r.section_ord = p.section_ord)"""


def merged(s, d):
    needs = doc_needs(repo_facts(tree(s, d)))
    return G.merge_responses(G.section_plan(needs), view(s, d, "responses"))


add("merge_responses", lambda s, d: big()(merged(s, d)), feature_sql("SELECT * FROM merged", *ALL, PLAN, RESPONSES, MERGED))


def whole_answers(s, d):
    """One answer for each document: its parts in order, of which there are four at most."""
    parts = F.array_sort(F.collect_list(F.struct("section_ord", "body")))
    return view(s, d, "responses").groupBy("repo", "doc_type").agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n").alias("body"))


def refined(s, d):
    drafts = doc_needs(repo_facts(tree(s, d))).select("repo", "doc_type", F.concat(F.lit("Draft of "), "doc_type", F.lit(" for "), "repo").alias("body"))
    return G.refine_documents(drafts, whole_answers(s, d)).withColumn("body", F.md5("body"))


WHOLE_ANSWERS = "whole_answers AS (SELECT repo, doc_type, string_agg(body, chr(10) ORDER BY section_ord) AS body FROM responses GROUP BY repo, doc_type)"
add("refine_documents", refined, feature_sql("""SELECT repo, doc_type, md5(coalesce(nullif(a.body, ''), 'Draft of ' || doc_type || ' for ' || repo)) AS body, coalesce(a.body, '') <> '' AS generated
  FROM needs LEFT JOIN whole_answers a USING (repo, doc_type)""", *ALL, RESPONSES, WHOLE_ANSWERS))


def clean_chain(source: str) -> tuple[list[str], str]:
    """The clean-up rules over a table ``drafts`` made from (doc_id, body)."""
    chain, previous = [f"drafts AS (SELECT repo || ' ' || doc_type AS doc_id, body FROM {source})"], "drafts"
    for number, rule in enumerate(RULES):
        chain += rule_ctes(rule, previous, f"step{number}")
        previous = f"step{number}"
    return chain, previous


CHAIN, LAST = clean_chain("put")
PUT = f"put AS (SELECT repo, doc_type, '# ' || any_value({TITLE_SQL}) || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY section_ord) AS body FROM merged GROUP BY repo, doc_type)"
add("combine_sections",
    lambda s, d: G.combine_sections(merged(s, d)),
    feature_sql(f"SELECT split_part(doc_id, ' ', 1) AS repo, split_part(doc_id, ' ', 2) AS doc_type, body FROM {LAST}",
                *ALL, PLAN, RESPONSES, MERGED, PUT, *CHAIN))
