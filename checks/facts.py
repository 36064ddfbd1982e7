"""Facts from manifests, workflows, hosting settings and source code."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    KEPT, MANIFEST_LINES, Registry, docs, in_list, joined, strip, tree, tree_sql, view,
)
from checks.scan import quoted
from codestrata.functions import extract as X
from codestrata.functions import naming as N
from codestrata.functions.words import CLASS_WORDS, FUNCTION_WORDS, PLAIN_BASES
from codestrata.operators import facts as FA
from codestrata.operators.ordering import first_wins, head_per_group

registry = Registry()
add = registry.add


def big(*columns: str):
    """Integer columns as BIGINT, as the SQL counts them."""
    return lambda df: df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def query(function, *columns: str):
    return lambda s, d: big()(function(tree(s, d)).select(*columns))


# --- dependencies ---------------------------------------------------------------------------------------------------

PYPROJECT_DEPS = f"""
pp AS (SELECT repo, ln, line, {strip('line')} AS st FROM ml WHERE path = 'pyproject.toml'),
pp_marks AS (SELECT *, CASE
    WHEN st IN ('[project.dependencies]', '[tool.poetry.dependencies]') THEN 'run'
    WHEN starts_with(st, 'dependencies = [') THEN CASE WHEN contains(st, ']') THEN 'run closed' ELSE 'run' END
    WHEN contains(st, '[tool.poetry.group.dev') THEN 'dev'
    WHEN contains(lower(st), 'dev') AND contains(lower(st), 'dependencies') THEN CASE WHEN NOT starts_with(st, '[') AND contains(st, ']') THEN 'dev closed' ELSE 'dev' END
    WHEN starts_with(st, '[') OR starts_with(st, ']') THEN 'none' END AS mark FROM pp),
pp_state AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY repo ORDER BY ln) AS state FROM pp_marks),
pp_names AS (SELECT repo, ln, 0 AS i, state, regexp_extract(st, '^["'']?([A-Za-z0-9][A-Za-z0-9._-]*)', 1) AS name FROM pp_state
  WHERE mark IS NULL AND state IN ('run', 'dev') AND NOT starts_with(st, '#') AND (contains(st, '=') OR starts_with(st, '"'))
  UNION ALL SELECT repo, ln, generate_subscripts(ns, 1), split_part(mark, ' ', 1), unnest(ns) FROM (SELECT repo, ln, mark, regexp_extract_all(st, '["'']([A-Za-z0-9][A-Za-z0-9._-]*)[^"'']*["'']', 1) AS ns FROM pp_marks WHERE mark LIKE '% closed')),
deps_py AS (SELECT repo, name, NULL::VARCHAR AS version, state = 'dev' AS dev_only, 'pyproject.toml' AS source,
    row_number() OVER (PARTITION BY repo ORDER BY ln, i) - 1 AS pos, 1 AS source_ord FROM pp_names WHERE name NOT IN ('', 'python'))"""

REQUIREMENTS_DEPS = f"""
rq AS (SELECT repo, path, ln, {strip("regexp_extract(st, '^([^>=<\\[!]*)', 1)")} AS name FROM (
    SELECT repo, path, ln, {strip('line')} AS st FROM ml WHERE path IN ('requirements.txt', 'requirements-dev.txt'))
  WHERE st <> '' AND NOT starts_with(st, '#') AND NOT starts_with(st, '-')),
deps_rq AS (SELECT repo, name, NULL::VARCHAR AS version, contains(path, 'dev') AS dev_only, path AS source,
    row_number() OVER (PARTITION BY repo, path ORDER BY ln) - 1 AS pos, CASE path WHEN 'requirements.txt' THEN 2 ELSE 3 END AS source_ord
  FROM rq WHERE name <> '')"""


def json_entries(name: str, key: str) -> str:
    """Entries of one object of package.json, numbered from 0."""
    return f"""
{name} AS (SELECT repo, e.key AS k, e.value AS v, i - 1 AS pos FROM (
    SELECT repo, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM (
      SELECT repo, map_entries(from_json(json_extract(content, '$.{key}'), '"MAP(VARCHAR,VARCHAR)"')) AS es
      FROM kept WHERE path = 'package.json' AND json_valid(content) AND json_type(content, '$.{key}') = 'OBJECT')))"""


PACKAGE_DEPS = json_entries("pj_run", "dependencies") + "," + json_entries("pj_dev", "devDependencies") + """,
deps_pj AS (SELECT repo, k AS name, v AS version, false AS dev_only, 'package.json' AS source, pos, 4 AS source_ord FROM pj_run
  UNION ALL SELECT repo, k, v, true, 'package.json', pos + (SELECT count(*) FROM pj_run WHERE pj_run.repo = pj_dev.repo), 4 FROM pj_dev)"""
DEPS = "deps AS (SELECT * FROM deps_py UNION ALL SELECT * FROM deps_rq UNION ALL SELECT * FROM deps_pj)"
DEPS_CTES = [MANIFEST_LINES, PYPROJECT_DEPS, REQUIREMENTS_DEPS, PACKAGE_DEPS, DEPS]
DEP_COLUMNS = ["repo", "name", "version", "dev_only", "source", "pos"]

for name, source, table in (
    ("deps_pyproject", ["pyproject.toml"], "deps_py"),
    ("deps_requirements", FA.REQUIREMENTS, "deps_rq"),
    ("deps_package_json", ["package.json"], "deps_pj"),
    ("dependencies", ["pyproject.toml", *FA.REQUIREMENTS, "package.json"], "deps"),
):
    add(name,
        lambda s, d, source=source: big()(FA.dependencies(tree(s, d)).filter(F.col("source").isin(source)).select(*DEP_COLUMNS)),
        tree_sql(f"SELECT {', '.join(DEP_COLUMNS)} FROM {table}", KEPT, *DEPS_CTES))


def runtime_vs_dev(rows):
    """Both kinds counted per repository, each as the library tells it apart."""
    kinds = FA.runtime_dependencies(rows).withColumn("kind", F.lit("runtime")).unionByName(FA.dev_dependencies(rows).withColumn("kind", F.lit("dev")))
    return kinds.groupBy("repo").agg(F.count(F.when(F.col("kind") == "runtime", 1)).alias("runtime"), F.count(F.when(F.col("kind") == "dev", 1)).alias("dev"))


add("runtime_vs_dev",
    lambda s, d: runtime_vs_dev(FA.dependencies(tree(s, d))),
    tree_sql("SELECT repo, count(*) FILTER (NOT dev_only) AS runtime, count(*) FILTER (dev_only) AS dev FROM deps GROUP BY repo", KEPT, *DEPS_CTES))
add("dependency_inventory", query(FA.dependency_inventory, "name", "repos", "runtime_repos", "dev_repos", "versions"),
    tree_sql("""SELECT name, count(DISTINCT repo) AS repos, count(DISTINCT repo) FILTER (NOT dev_only) AS runtime_repos,
      count(DISTINCT repo) FILTER (dev_only) AS dev_repos, count(DISTINCT version) AS versions FROM deps GROUP BY name""", KEPT, *DEPS_CTES))

FORMS = "forms AS (SELECT doc_id, doc_id % {n} AS k, CAST(CAST(floor(doc_id / {n}) AS BIGINT) AS VARCHAR) AS r FROM documents)"
add("deps_pyproject_forms",
    lambda s, d: view(s, d, "project_forms").select("doc_id", F.inline(X.deps_pyproject(F.col("content")))).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "name", "dev_only"),
    "WITH " + FORMS.format(n=4) + """, listed AS (SELECT doc_id, k = 2 AS dev_only,
      CASE k WHEN 0 THEN ['uvicorn', 'click' || r, 'rich', 'x'] WHEN 1 THEN ['a', 'c' || r] WHEN 2 THEN ['pytest', 'dev-dependencies-' || r] ELSE ['Django', 'boto' || r] END AS names FROM forms)
    SELECT doc_id, unnest(range(0, len(names))) AS pos, unnest(names) AS name, dev_only FROM listed""")

# --- environment ----------------------------------------------------------------------------------------------------

ENV_FILE = f"""
ef AS (SELECT repo, path, ln, {strip('line')} AS st FROM ml WHERE path IN ('.env.example', '.env.sample', '.env.template')),
env_declared AS (SELECT repo, {strip("split_part(st, '=', 1)")} AS name, path AS source_file,
    nullif({strip("substring(st, strpos(st, '=') + 1)")}, '') AS default_value,
    row_number() OVER (PARTITION BY repo, path ORDER BY ln) - 1 AS pos, 1 AS source_ord
  FROM ef WHERE NOT starts_with(st, '#') AND contains(st, '='))"""
ENV_CODE = f"""
env_hits AS (
  SELECT repo, path, ln, 1 AS kind, unnest(regexp_extract_all(line, {quoted(X.ENV_CALLS[0])}, 1)) AS name, generate_subscripts(regexp_extract_all(line, {quoted(X.ENV_CALLS[0])}, 1), 1) AS m FROM ml_py
  UNION ALL SELECT repo, path, ln, 2, unnest(regexp_extract_all(line, {quoted(X.ENV_CALLS[1])}, 1)), generate_subscripts(regexp_extract_all(line, {quoted(X.ENV_CALLS[1])}, 1), 1) FROM ml_py
  UNION ALL SELECT repo, path, ln, 3, unnest(regexp_extract_all(line, {quoted(X.ENV_CALLS[2])}, 1)), generate_subscripts(regexp_extract_all(line, {quoted(X.ENV_CALLS[2])}, 1), 1) FROM ml_py),
env_once AS (SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY ln, kind, m) AS nth FROM env_hits),
env_read AS (SELECT repo, name, path AS source_file, row_number() OVER (PARTITION BY repo, path ORDER BY ln, kind, m) - 1 AS pos FROM env_once WHERE nth = 1),
env_first AS (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY source_file, pos) AS nth FROM env_read),
env_new AS (SELECT repo, name, source_file, pos FROM env_first f WHERE nth = 1
  AND NOT EXISTS (SELECT 1 FROM env_declared e WHERE e.repo = f.repo AND e.name = f.name)),
envs AS (SELECT * FROM env_declared UNION ALL SELECT repo, name, source_file, NULL, pos, 2 FROM env_new)"""
PY_LINES = f"ml_py AS (SELECT * FROM ml WHERE lower(name) LIKE '%.py' AND name <> '.py' AND NOT starts_with({strip('line')}, '#'))"
ENV_CTES = [MANIFEST_LINES, PY_LINES, ENV_FILE, ENV_CODE]
add("env_files", query(FA.env_file_rows, "repo", "name", "source_file", "default_value", "pos"),
    tree_sql("SELECT repo, name, source_file, default_value, pos FROM env_declared", KEPT, *ENV_CTES))
add("env_refs_python", query(FA.env_code_refs, "repo", "name", "source_file", "pos"),
    tree_sql("SELECT repo, name, source_file, pos FROM env_read", KEPT, *ENV_CTES))
add("env_refs_new", query(FA.env_refs_new, "repo", "name", "source_file", "pos"),
    tree_sql("SELECT repo, name, source_file, pos FROM env_new", KEPT, *ENV_CTES))
add("env_variables", query(FA.env_variables, "repo", "name", "source_file", "default_value", "pos", "source_ord", "required"),
    tree_sql("SELECT *, true AS required FROM envs", KEPT, *ENV_CTES))
add("first_wins",
    lambda s, d: first_wins(FA.env_code_refs(tree(s, d)), ["name"], ["repo", "source_file", "pos"]).select("name", "repo", "source_file"),
    tree_sql("SELECT name, repo, source_file FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY repo, source_file, pos) AS nth FROM env_read) WHERE nth = 1",
             KEPT, *ENV_CTES))

# --- entry points, scripts, endpoints -------------------------------------------------------------------------------

ENTRIES = f"""
ps AS (SELECT repo, ln, line, {strip('line')} AS st, contains(line, '[project.scripts]') OR contains(line, '[tool.poetry.scripts]') AS opens
  FROM ml WHERE path = 'pyproject.toml'),
ps_open AS (SELECT repo, min(ln) AS opened FROM ps WHERE opens GROUP BY repo),
ps_close AS (SELECT ps.repo, min(ln) AS closed FROM ps JOIN ps_open USING (repo) WHERE ln > opened AND NOT opens AND starts_with(st, '[') GROUP BY ps.repo),
entries_py AS (SELECT repo, name, 'pyproject.toml' AS target, 'cli' AS entry_type, name AS command, 'CLI entry: ' || goal AS description,
    row_number() OVER (PARTITION BY repo ORDER BY ln) - 1 AS pos, 1 AS source_ord FROM (
    SELECT ps.repo, ln, trim({strip("split_part(line, '=', 1)")}, '"''') AS name, trim({strip("substring(line, strpos(line, '=') + 1)")}, '"''') AS goal
    FROM ps JOIN ps_open USING (repo) LEFT JOIN ps_close USING (repo)
    WHERE ln > opened AND ln < coalesce(closed, 1000000000) AND NOT opens AND contains(line, '=') AND NOT starts_with(st, '#')) WHERE name <> ''),
{json_entries('pj_bin', 'bin')},
entries_pj AS (SELECT repo, 'main' AS name, json_extract_string(content, '$.main') AS target, 'module' AS entry_type, NULL::VARCHAR AS command,
    'Main entry: ' || json_extract_string(content, '$.main') AS description, 0 AS pos, 2 AS source_ord
  FROM kept WHERE path = 'package.json' AND json_valid(content) AND json_extract_string(content, '$.main') IS NOT NULL
  UNION ALL SELECT repo, k, v, 'cli', k, '', pos + 1, 2 FROM pj_bin),
entries_main AS (SELECT repo, coalesce(CASE WHEN depth > 1 THEN seg[depth - 1] END, '') AS name, path AS target, 'module' AS entry_type,
    'python -m ' || coalesce(CASE WHEN depth > 1 THEN seg[depth - 1] END, '') AS command, '' AS description, 0 AS pos, 3 AS source_ord FROM kept WHERE name = '__main__.py'),
entries AS (SELECT * FROM entries_py UNION ALL SELECT * FROM entries_pj UNION ALL SELECT * FROM entries_main)"""
ENTRY_COLUMNS = ["repo", "name", "target", "entry_type", "command", "description", "pos"]
ENTRY_CTES = [MANIFEST_LINES, ENTRIES]
for name, ord_, table in (("entry_points_pyproject", [1], "entries_py"), ("entry_points_package_json", [2], "entries_pj"),
                          ("entry_points_dunder_main", [3], "entries_main"), ("entry_points", [1, 2, 3], "entries")):
    add(name, lambda s, d, ord_=ord_: big()(FA.entry_points(tree(s, d)).filter(F.col("source_ord").isin(ord_)).select(*ENTRY_COLUMNS)),
        tree_sql(f"SELECT {', '.join(ENTRY_COLUMNS)} FROM {table}", KEPT, *ENTRY_CTES))

SCRIPTS = json_entries("pj_scripts", "scripts") + """,
mk AS (SELECT repo, ln, regexp_extract(line, '^([a-zA-Z_][a-zA-Z0-9_-]*):', 1) AS name FROM ml WHERE path = 'Makefile'),
scripts AS (SELECT repo, k AS name, v AS command, 'package.json' AS source, pos, 1 AS source_ord FROM pj_scripts
  UNION ALL SELECT repo, name, 'make ' || name, 'Makefile', row_number() OVER (PARTITION BY repo ORDER BY ln) - 1, 2 FROM mk WHERE name <> '')"""
SCRIPT_COLUMNS = ["repo", "name", "command", "source", "pos"]
SCRIPT_CTES = [MANIFEST_LINES, SCRIPTS]
for name, ord_ in (("scripts_npm", [1]), ("scripts_make", [2]), ("scripts", [1, 2])):
    add(name, lambda s, d, ord_=ord_: big()(FA.scripts(tree(s, d)).filter(F.col("source_ord").isin(ord_)).select(*SCRIPT_COLUMNS)),
        tree_sql(f"SELECT {', '.join(SCRIPT_COLUMNS)} FROM scripts WHERE source_ord IN ({', '.join(map(str, ord_))})", KEPT, *SCRIPT_CTES))
add("quality_commands",
    lambda s, d: FA.quality_commands(FA.scripts(tree(s, d))).select("repo", "name", "command"),
    tree_sql("SELECT repo, name, command FROM scripts WHERE regexp_matches(lower(name), 'test|lint|check|validate')", KEPT, *SCRIPT_CTES))
add("install_commands",
    lambda s, d: big()(head_per_group(FA.install_commands(FA.scripts(tree(s, d))), ["repo"], ["source_ord", "pos"], 3)
    .select("repo", "name", "command", "rank")),
    tree_sql("""SELECT repo, name, command, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY source_ord, pos) AS rank
      FROM scripts WHERE regexp_matches(lower(name), 'install|setup|prepare')) WHERE rank <= 3""", KEPT, *SCRIPT_CTES))

ENDPOINTS = f"""
py AS (SELECT repo, path, content FROM kept WHERE lower(name) LIKE '%.py' AND name <> '.py'),
ep_hits AS (
  SELECT repo, path, 1 AS kind, unnest(regexp_extract_all(content, {quoted(X.ROUTE_CALLS[0])}, 0)) AS m, generate_subscripts(regexp_extract_all(content, {quoted(X.ROUTE_CALLS[0])}, 0), 1) AS i FROM py
  UNION ALL SELECT repo, path, 2, unnest(regexp_extract_all(content, {quoted(X.ROUTE_CALLS[1])}, 0)), generate_subscripts(regexp_extract_all(content, {quoted(X.ROUTE_CALLS[1])}, 0), 1) FROM py),
ep_lists AS (SELECT repo, path, unnest(regexp_extract_all(content, {quoted(X.ROUTE_LIST)}, 0)) AS m, generate_subscripts(regexp_extract_all(content, {quoted(X.ROUTE_LIST)}, 0), 1) AS i FROM py),
ep_methods AS (SELECT repo, path, i, regexp_extract(m, {quoted(X.ROUTE_LIST)}, 1) AS endpoint,
    unnest(regexp_extract_all(regexp_extract(m, {quoted(X.ROUTE_LIST)}, 2), '["''](\\w+)["'']', 1)) AS method,
    generate_subscripts(regexp_extract_all(regexp_extract(m, {quoted(X.ROUTE_LIST)}, 2), '["''](\\w+)["'']', 1), 1) AS j FROM ep_lists),
ep_all AS (SELECT repo, path, kind, i, 0 AS j, upper(regexp_extract(m, {quoted(X.ROUTE_CALLS[0].replace('@app', '@(?:app|router)'))}, 1)) AS method,
    regexp_extract(m, {quoted(X.ROUTE_CALLS[0].replace('@app', '@(?:app|router)'))}, 2) AS endpoint FROM ep_hits
  UNION ALL SELECT repo, path, 3, i, j, upper(method), endpoint FROM ep_methods),
endpoints AS (SELECT repo, path, method, endpoint, row_number() OVER (PARTITION BY repo, path ORDER BY kind, i, j) - 1 AS pos FROM ep_all)"""
add("api_endpoints", query(FA.api_endpoints, "repo", "path", "method", "endpoint", "pos"),
    tree_sql("SELECT repo, path, method, endpoint, pos FROM endpoints", KEPT, ENDPOINTS))

START = f"""
starts AS (SELECT repo, command, row_number() OVER (PARTITION BY repo ORDER BY source_ord, pos) AS nth FROM scripts WHERE name IN ('start', 'serve', 'run', 'dev')),
first_entry AS (SELECT repo, command, row_number() OVER (PARTITION BY repo ORDER BY source_ord, target, pos) AS nth FROM entries)"""

# --- continuous integration -----------------------------------------------------------------------------------------


def all_sql(text: str, regex: str) -> str:
    return f"regexp_extract_all({text}, {quoted(regex)}, 1)"


CI = f"""
wf AS (SELECT repo, path, stem, content FROM kept WHERE content <> '' AND regexp_matches(path, {quoted(FA.CI_PATH)})),
wf_lines AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM wf),
wf_keys AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^[a-z]') THEN regexp_extract(line, '^([a-zA-Z_][a-zA-Z0-9_-]*):', 1) END IGNORE NULLS)
    OVER (PARTITION BY repo, path ORDER BY ln) AS parent FROM wf_lines),
gh_jobs AS (SELECT repo, path, string_agg(regexp_extract(line, '^  ([a-zA-Z_][a-zA-Z0-9_-]*):', 1), '|' ORDER BY ln) AS jobs FROM wf_keys
  WHERE parent = 'jobs' AND regexp_matches(line, '^  ([a-zA-Z_][a-zA-Z0-9_-]*):') GROUP BY repo, path),
gh_triggers AS (SELECT repo, path, string_agg(regexp_extract(line, '^  ([a-z_]+):', 1), '|' ORDER BY ln) AS triggers FROM wf_keys
  WHERE parent = 'on' AND regexp_matches(line, '^  ([a-z_]+):') GROUP BY repo, path),
gl_stages AS (SELECT repo, path, string_agg(regexp_extract(line, '-\\s*(\\w+)', 1), '|' ORDER BY ln) AS triggers FROM wf_keys
  WHERE parent = 'stages' AND regexp_matches(line, '^\\s+-\\s*\\w') GROUP BY repo, path),
cc_jobs AS (SELECT repo, path, string_agg(regexp_extract(line, '^  ([a-zA-Z_][a-zA-Z0-9_-]*):', 1), '|' ORDER BY ln) AS jobs FROM wf_keys
  WHERE path = '.circleci/config.yml' AND parent = 'jobs' AND regexp_matches(line, '^  ([a-zA-Z_][a-zA-Z0-9_-]*):') GROUP BY repo, path),
workflows AS (
  SELECT wf.repo, wf.path, coalesce(nullif(trim(regexp_extract(content, '(?m)^name:\\s*["'']?([^"''\\n]+)', 1)), ''), stem) AS name, 'github-actions' AS platform,
    CASE WHEN regexp_matches(content, '(?m)^on:[ ]*\\w+\\s*$') THEN regexp_extract(content, '(?m)^on:[ ]*(\\w+)\\s*$', 1)
      WHEN regexp_matches(content, '(?m)^on:\\s*\\[') THEN array_to_string(list_transform(string_split(regexp_extract(content, '(?m)^on:\\s*\\[([^\\]]+)\\]', 1), ','), lambda t: trim(t)), '|')
      ELSE coalesce(triggers, '') END AS triggers,
    coalesce(jobs, '') AS jobs,
    array_to_string(list_sort(list_distinct({all_sql('content', r"""environment:\s*["']?([a-zA-Z][a-zA-Z0-9_-]*)""")})), '|') AS environments,
    array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\\$\\{{\\{{\\s*secrets\\.([A-Z_][A-Z0-9_]*)\\s*\\}}\\}}', 1))), '|') AS secrets_used, 1 AS platform_ord
  FROM wf LEFT JOIN gh_jobs USING (repo, path) LEFT JOIN gh_triggers USING (repo, path) WHERE starts_with(path, '.github/')
  UNION ALL SELECT wf.repo, wf.path, 'GitLab CI', 'gitlab-ci', coalesce(triggers, ''),
    array_to_string(list_filter({all_sql('content', X.TOP_KEY)}, lambda k: k NOT IN {in_list(X.GITLAB_RESERVED)}), '|'),
    array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'environment:\\s*(?:name:\\s*)?["'']?(\\w+)', 1))), '|'),
    array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\\$([A-Z_]{{3,}})', 1))), '|'), 2
  FROM wf LEFT JOIN gl_stages USING (repo, path) WHERE path = '.gitlab-ci.yml'
  UNION ALL SELECT repo, path, 'Jenkins Pipeline', 'jenkins', '',
    array_to_string(regexp_extract_all(content, 'stage\\s*\\(\\s*[''"]([^''"]+)[''"]', 1), '|'),
    array_to_string(list_sort(list_distinct(regexp_extract_all(content, '(?s)environment\\s*\\{{\\s*\\n.*?(\\w+)\\s*=', 1))), '|'),
    array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'credentials\\s*\\(\\s*[''"]([^''"]+)[''"]', 1))), '|'), 3
  FROM wf WHERE path = 'Jenkinsfile'
  UNION ALL SELECT wf.repo, wf.path, 'CircleCI', 'circleci', array_to_string({all_sql('content', X.INDENTED_KEY)}, '|'), coalesce(jobs, ''), '', '', 4
  FROM wf LEFT JOIN cc_jobs USING (repo, path) WHERE path = '.circleci/config.yml'
)"""


def workflow_forms(s, d):
    w = X.github_workflow(F.col("content"), F.lit(".github/workflows/flow.yml"))
    rows = view(s, d, "workflow_forms").filter(F.col("doc_id") % 6 != 5).select("doc_id", w.alias("w")).select("doc_id", "w.*")
    return rows.select("doc_id", "name", *[joined(c).alias(c) for c in ("triggers", "jobs", "environments")])


add("github_workflow_forms", workflow_forms, "WITH " + FORMS.format(n=6) + """
    SELECT doc_id, CASE k WHEN 0 THEN 'CI ' || r WHEN 1 THEN 'A: b' || r ELSE 'flow' END AS name,
      CASE k WHEN 0 THEN 'push|pull_request' WHEN 1 THEN 'push|workflow_dispatch' WHEN 2 THEN 'push|schedule' ELSE 'push|release' END AS triggers,
      CASE k WHEN 0 THEN 'build|ship' || r WHEN 1 THEN 'deploy' WHEN 2 THEN 'lint|build' || r || '|none' WHEN 3 THEN 'a|b c' ELSE 'only' END AS jobs,
      CASE k WHEN 0 THEN 'prod-' || CAST(CAST(r AS BIGINT) % 3 AS VARCHAR) || '|staging' WHEN 1 THEN 'live' || r WHEN 2 THEN 'live|test' WHEN 3 THEN 'qa' || r ELSE 'e ' || r END AS environments
    FROM forms WHERE k <> 5""")


def workflow_rows(s, d):
    lists = ["triggers", "jobs", "environments", "secrets_used"]
    return FA.ci_workflows(tree(s, d)).select("repo", "path", "name", "platform", *[joined(c).alias(c) for c in lists])


WORKFLOW_COLUMNS = "repo, path, name, platform, triggers, jobs, environments, secrets_used"
for name, platform in (("github_workflows", "github-actions"), ("gitlab_ci", "gitlab-ci"), ("jenkins", "jenkins"), ("circleci", "circleci")):
    add(name, lambda s, d, platform=platform: workflow_rows(s, d).filter(F.col("platform") == platform),
        tree_sql(f"SELECT {WORKFLOW_COLUMNS} FROM workflows WHERE platform = '{platform}'", KEPT, CI))
add("ci_workflows", workflow_rows, tree_sql(f"SELECT {WORKFLOW_COLUMNS} FROM workflows", KEPT, CI))

# --- hosting --------------------------------------------------------------------------------------------------------

HOSTING = f"""
owners AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ln) - 1 AS pos, st AS rule, string_split_regex(st, '\\s+') AS words FROM (
    SELECT repo, ln, {strip('line')} AS st FROM ml WHERE path = '.github/CODEOWNERS') WHERE st <> '' AND NOT starts_with(st, '#')),
pick AS (SELECT repo, regexp_extract(path, '^.github/([^/]+)[.]ya?ml$', 1) AS what, max_by(content, path) AS content FROM kept
  WHERE regexp_matches(path, '^[.]github/(dependabot|FUNDING|labels)[.]ya?ml$') GROUP BY ALL),
wfs AS (SELECT repo, path, stem, content FROM kept WHERE regexp_matches(path, '^[.]github/workflows/[^/]+[.]ya?ml$')),
branch_lists AS (SELECT repo, unnest(regexp_extract_all(content, 'branches:\\s*\\[([^\\]]+)\\]', 1)) AS l FROM wfs),
branches AS (SELECT repo, unnest(string_split(l, ',')) AS b FROM branch_lists),
templates AS (SELECT repo, path, CASE WHEN path = '.github/ISSUE_TEMPLATE.md' THEN 'default' ELSE stem END AS template FROM kept
  WHERE path = '.github/ISSUE_TEMPLATE.md' OR regexp_matches(path, '^[.]github/ISSUE_TEMPLATE/[^/]+[.](md|yml|yaml)$')),
actions AS (SELECT DISTINCT repo, regexp_extract(path, '^[.]github/actions/([^/]+)/', 1) AS action FROM kept WHERE regexp_matches(path, '^[.]github/actions/[^/]+/action[.]ya?ml$')
  UNION SELECT repo, 'workflow:' || stem FROM wfs WHERE contains(content, 'workflow_call:')),
flags AS (SELECT repo, bool_or(path IN ('.github/PULL_REQUEST_TEMPLATE.md', '.github/pull_request_template.md')) AS pr_template,
    bool_or(path IN ('.github/dependabot.yml', '.github/dependabot.yaml')) AS dependabot_enabled,
    bool_or(path IN ('.github/release-drafter.yml', '.github/release-drafter.yaml')) AS release_drafter,
    bool_or(regexp_matches(path, '^[.]github/workflows/[^/]+[.]ya?ml$') AND (contains(lower(stem), 'release') OR contains(content, 'semantic-release') OR contains(content, 'release-please'))) AS auto_release,
    coalesce((SELECT string_agg(DISTINCT n, '|' ORDER BY n) FROM (SELECT repo AS r, trim({strip('b')}, '"''') AS n FROM branches) WHERE r = k.repo AND n IN {in_list(X.PROTECTED_BRANCHES)}), '') AS protected_branches
  FROM kept k WHERE starts_with(path, '.github/') GROUP BY repo)"""
HOSTING_CTES = [MANIFEST_LINES, HOSTING]
add("codeowners", query(FA.codeowners, "repo", "pos", "rule", "pattern", "owners"),
    tree_sql("SELECT repo, pos, rule, words[1] AS pattern, array_to_string(words[2:], ' ') AS owners FROM owners", KEPT, *HOSTING_CTES))
add("dependabot", lambda s, d: FA.dependabot(tree(s, d)).select("repo", joined("ecosystems").alias("ecosystems")),
    tree_sql("SELECT repo, array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'package-ecosystem:\\s*[\"'']?([a-z-]+)', 1))), '|') AS ecosystems FROM pick WHERE what = 'dependabot'",
             KEPT, *HOSTING_CTES))
add("funding", query(FA.funding, "repo", "pos", "platform"),
    tree_sql("""SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY i) - 1 AS pos, platform FROM (
      SELECT repo, unnest(regexp_extract_all(content, '(?m)^([a-z_]+):', 1)) AS platform, generate_subscripts(regexp_extract_all(content, '(?m)^([a-z_]+):', 1), 1) AS i
      FROM pick WHERE what = 'FUNDING') WHERE platform <> 'custom'""", KEPT, *HOSTING_CTES))
add("labels", query(FA.labels, "repo", "pos", "label"),
    tree_sql("""SELECT repo, i - 1 AS pos, label FROM (SELECT repo, unnest(regexp_extract_all(content, 'name:\\s*["'']?([^"''\\n]+)', 1)) AS label,
      generate_subscripts(regexp_extract_all(content, 'name:\\s*["'']?([^"''\\n]+)', 1), 1) AS i FROM pick WHERE what = 'labels')""".replace("\\\\", "\\"), KEPT, *HOSTING_CTES))
add("issue_templates", query(FA.issue_templates, "repo", "path", "template"), tree_sql("SELECT * FROM templates", KEPT, *HOSTING_CTES))
add("custom_actions", query(FA.custom_actions, "repo", "action"), tree_sql("SELECT * FROM actions", KEPT, *HOSTING_CTES))
for name, columns in (("pull_request_template", ["pr_template"]), ("release_flags", ["release_drafter", "auto_release"]),
                      ("protected_branches", ["protected_branches"])):
    add(name,
        lambda s, d, columns=columns: FA.hosting_flags(tree(s, d)).withColumn("protected_branches", joined("protected_branches")).select("repo", *columns),
        tree_sql(f"SELECT repo, {', '.join(columns)} FROM flags", KEPT, *HOSTING_CTES))

# --- markers --------------------------------------------------------------------------------------------------------

MARKERS = f"""
marks AS (SELECT repo, path, unnest(list_filter([
    CASE WHEN lname = 'pyproject.toml' THEN 'tool setuptools/pyproject' END, CASE WHEN lname = 'package.json' THEN 'tool npm' END,
    CASE WHEN lname = 'cargo.toml' THEN 'tool cargo' END, CASE WHEN lname = 'dockerfile' THEN 'tool docker' END, CASE WHEN lname = 'makefile' THEN 'tool make' END,
    CASE WHEN lsuf = '.tf' THEN 'tool terraform' END, CASE WHEN lname IN ('playbook.yml', 'playbook.yaml', 'site.yml', 'ansible.cfg') THEN 'tool ansible' END,
    CASE WHEN lname IN ('chart.yaml', 'chart.yml') THEN 'tool helm' END, CASE WHEN lname IN ('kustomization.yaml', 'kustomization.yml') THEN 'tool kustomize' END,
    CASE WHEN lname IN ('pulumi.yaml', 'pulumi.yml') THEN 'tool pulumi' END, CASE WHEN contains(lpath, 'cloudformation') OR lname LIKE '%.template' THEN 'tool cloudformation' END,
    CASE WHEN starts_with(path, '.github/') THEN 'tool github' END, CASE WHEN regexp_matches(path, '^[.]github/workflows/[^/]+[.]ya?ml$') AND size_bytes > 0 THEN 'tool github-actions' END,
    CASE WHEN path = '.gitlab-ci.yml' AND size_bytes > 0 THEN 'tool gitlab-ci' END, CASE WHEN path = 'Jenkinsfile' AND size_bytes > 0 THEN 'tool jenkins' END,
    CASE WHEN path = '.circleci/config.yml' AND size_bytes > 0 THEN 'tool circleci' END,
    CASE WHEN contains(lpath, 'fastapi') THEN 'framework FastAPI' END, CASE WHEN contains(lpath, 'django') THEN 'framework Django' END,
    CASE WHEN contains(lpath, 'react') OR lsuf IN ('.tsx', '.jsx') THEN 'framework React' END], lambda x: x IS NOT NULL)) AS m FROM kept),
markers AS (SELECT repo, split_part(m, ' ', 1) AS kind, split_part(m, ' ', 2) AS marker, count(*) AS files FROM marks GROUP BY ALL)"""
add("repo_markers", query(FA.repo_markers, "repo", "kind", "marker", "files"), tree_sql("SELECT * FROM markers", KEPT, MARKERS))

# --- symbols --------------------------------------------------------------------------------------------------------


def phrase_map(table: str, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def humanize_sql(source: str, out: str) -> str:
    """Adds ``inferred`` to a relation with name, kind and bases."""
    return f"""
{out} AS (SELECT * EXCLUDE (w, base), CASE kind
    WHEN 'function' THEN coalesce({strip(phrase_map(FUNCTION_WORDS, 'w[1]') + " || ' ' || array_to_string(w[2:], ' ')")}, upper(substring(array_to_string(w, ' '), 1, 1)) || lower(substring(array_to_string(w, ' '), 2)))
    WHEN 'interface' THEN 'Interface defining ' || array_to_string(w, ' ')
    ELSE CASE WHEN w[1] IN ('base', 'abstract') THEN 'Abstract base class for ' || CASE WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') ELSE 'functionality' END
      ELSE coalesce({strip(phrase_map(CLASS_WORDS, 'w[len(w)]') + " || ' ' || array_to_string(w[:len(w) - 1], ' ')")}, upper(substring(array_to_string(w, ' '), 1, 1)) || lower(substring(array_to_string(w, ' '), 2)))
        || CASE WHEN base IN {in_list(["", *PLAIN_BASES])} THEN '' ELSE ' (extends ' || base || ')' END END END AS inferred
  FROM (SELECT *, list_filter(string_split_regex(lower(replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '\\s+'), lambda x: x <> '') AS w,
      {strip("split_part(bases, ',', 1)")} AS base FROM {source}))"""


PY_DOC_SQL = X._PY_DOC


def found_sql(source: str, regex: str, text: str = "content") -> str:
    return (f"SELECT repo, path, unnest(regexp_extract_all({text}, {quoted(regex)}, 0)) AS m, "
            f"generate_subscripts(regexp_extract_all({text}, {quoted(regex)}, 0), 1) AS i FROM {source}")


def group_sql(regex: str, *groups: int) -> str:
    return " || ".join(f"coalesce(regexp_extract(m, {quoted(regex)}, {g}), '')" for g in groups)


PY_SYMBOLS = f"""
py_src AS (SELECT repo, path, content FROM kept WHERE lsuf = '.py' AND content <> ''),
py_c AS ({found_sql('py_src', X.PYTHON_CLASS)}), py_f AS ({found_sql('py_src', X.PYTHON_FUNCTION)}),
py_raw AS (SELECT repo, path, 1 AS ord, i, 'class' AS kind, {group_sql(X.PYTHON_CLASS, 1)} AS name, {group_sql(X.PYTHON_CLASS, 2)} AS bases, '' AS params,
    {strip("split_part(" + strip(group_sql(X.PYTHON_CLASS, 3, 4)) + ", chr(10), 1)")} AS doc FROM py_c
  UNION ALL SELECT repo, path, 2, i, 'function', {group_sql(X.PYTHON_FUNCTION, 1)}, '', {group_sql(X.PYTHON_FUNCTION, 2)},
    {strip("split_part(" + strip(group_sql(X.PYTHON_FUNCTION, 3, 4)) + ", chr(10), 1)")} FROM py_f),
{humanize_sql('py_raw', 'py_inferred')},
py_sym AS (SELECT repo, path, ord, i, name, kind AS symbol_type, CASE WHEN doc <> '' THEN doc ELSE inferred END AS docstring,
    CASE kind WHEN 'class' THEN bases ELSE '(' || array_to_string(list_filter(
      list_transform(string_split(params, ','), lambda p: {strip("split_part(split_part(p, ':', 1), '=', 1)")}), lambda n: n NOT IN ('', 'self', 'cls')), ', ') || ')' END AS signature
  FROM py_inferred)"""


def js_found(name: str, definition: str) -> str:
    regex = X._JS_DOC + definition
    return f"""
{name}_outer AS ({found_sql('js_src', regex, 'marked')}),
{name}_in AS (SELECT repo, path, i, unnest(regexp_extract_all({group_sql(regex, 1)}, {quoted(definition)}, 0)) AS m,
    generate_subscripts(regexp_extract_all({group_sql(regex, 1)}, {quoted(definition)}, 0), 1) AS j FROM {name}_outer),
{name}_all AS (SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY i, j) AS i, m FROM (
    SELECT repo, path, i, j, m FROM {name}_in UNION ALL SELECT repo, path, i, 1000000, m FROM {name}_outer))"""


def js_doc_sql(definition: str) -> str:
    text = group_sql(X._JS_DOC + definition, 1)
    return (f"coalesce(list_filter(list_transform(string_split({strip(text)}, chr(10)), lambda x: {strip('ltrim(' + strip('x') + ', ' + quoted('*') + ')')}), "
            f"lambda y: y <> '' AND NOT starts_with(y, '@'))[1], '')")


JS_C, JS_F, JS_I = (X._JS_DOC + d for d in (X.JS_CLASS, X.JS_FUNCTION, X.JS_INTERFACE))
JS_SYMBOLS = f"""
js_src AS (SELECT repo, path, replace(content, '*/', chr(1)) AS marked FROM kept WHERE lsuf IN ('.js', '.jsx', '.ts', '.tsx') AND content <> ''),
{js_found('js_c', X.JS_CLASS)}, {js_found('js_f', X.JS_FUNCTION)}, {js_found('js_i', X.JS_INTERFACE)},
js_classes AS (SELECT repo, path, 1 AS ord, i, 'class' AS kind, {group_sql(JS_C, 2)} AS name, {group_sql(JS_C, 3)} AS bases, {js_doc_sql(X.JS_CLASS)} AS doc FROM js_c_all),
js_functions AS (SELECT repo, path, 2 AS ord, i, 'function' AS kind, {group_sql(JS_F, 2, 3)} AS name, '' AS bases, {js_doc_sql(X.JS_FUNCTION)} AS doc FROM js_f_all),
js_interfaces AS (SELECT repo, path, 3 AS ord, i, 'interface' AS kind, {group_sql(JS_I, 2)} AS name, '' AS bases, {js_doc_sql(X.JS_INTERFACE)} AS doc FROM js_i_all),
js_raw AS (SELECT * FROM js_classes
  UNION ALL SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY i) AS nth FROM js_functions) WHERE nth = 1
  UNION ALL SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY i) AS nth FROM js_interfaces) x WHERE nth = 1
    AND NOT EXISTS (SELECT 1 FROM js_classes c WHERE c.repo = x.repo AND c.path = x.path AND c.name = x.name)),
{humanize_sql('js_raw', 'js_inferred')},
js_sym AS (SELECT repo, path, ord, i, name, kind AS symbol_type, CASE WHEN doc <> '' THEN doc ELSE inferred END AS docstring,
    CASE WHEN kind = 'class' AND bases <> '' THEN 'extends ' || bases ELSE '' END AS signature FROM js_inferred)"""
SYMBOLS = """
symbols AS (SELECT repo, path, name, symbol_type, docstring, signature, row_number() OVER (PARTITION BY repo, path ORDER BY ord, i) - 1 AS pos,
    CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2)
      WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS dir_key
  FROM (SELECT * FROM py_sym UNION ALL SELECT * FROM js_sym))"""
SYMBOL_CTES = [PY_SYMBOLS, JS_SYMBOLS, SYMBOLS]
SYMBOL_COLUMNS = ["repo", "path", "pos", "name", "symbol_type", "docstring", "signature"]
for name, condition in (
    ("python_classes", "lower(path) LIKE '%.py' AND symbol_type = 'class'"),
    ("python_functions", "lower(path) LIKE '%.py' AND symbol_type = 'function'"),
    ("js_symbols", "lower(path) NOT LIKE '%.py'"),
    ("symbols", "true"),
):
    add(name, lambda s, d, condition=condition: big()(FA.symbols(tree(s, d)).filter(condition).select(*SYMBOL_COLUMNS)),
        tree_sql(f"SELECT {', '.join(SYMBOL_COLUMNS)} FROM symbols WHERE {condition}", KEPT, *SYMBOL_CTES))

IMPORTS = f"""
imp_py AS (SELECT repo, path, i, split_part({group_sql(X.PYTHON_IMPORT, 1, 2)}, '.', 1) AS module FROM ({found_sql("(SELECT * FROM kept WHERE lsuf = '.py' AND content <> '')", X.PYTHON_IMPORT)})
  WHERE NOT starts_with({group_sql(X.PYTHON_IMPORT, 1, 2)}, '_')),
imp_js AS (SELECT repo, path, i, ltrim(split_part({group_sql(X.JS_IMPORT, 1)}, '/', 1), '@') AS module
  FROM ({found_sql("(SELECT * FROM kept WHERE lsuf IN ('.js', '.jsx', '.ts', '.tsx') AND content <> '')", X.JS_IMPORT)})),
imp AS (SELECT repo, path, module, min(i) AS i FROM (SELECT * FROM imp_py UNION ALL SELECT * FROM imp_js WHERE module <> '') GROUP BY ALL),
imports AS (SELECT repo, path, module, row_number() OVER (PARTITION BY repo, path ORDER BY i) - 1 AS pos FROM imp)"""


def import_rows(s, d):
    return FA.imports(tree(s, d)).withColumn("pos", F.col("pos").cast("bigint"))


for name, condition in (("python_imports", "lower(path) LIKE '%.py'"), ("js_imports", "lower(path) NOT LIKE '%.py'")):
    add(name, lambda s, d, condition=condition: import_rows(s, d).filter(condition),
        tree_sql(f"SELECT repo, path, pos, module FROM imports WHERE {condition}", KEPT, IMPORTS))

# Names with every known word in first and last place, so that the whole vocabulary is compared.
VOCABULARY = " ".join([*FUNCTION_WORDS, *CLASS_WORDS, "xylo", "base", "abstract"])
NAMES = f"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(w, '_', 'user_', CAST(doc_id % 7 AS STRING)) WHEN 1 THEN concat('HTTPUser', upper(substring(w, 1, 1)), substring(w, 2, 100))
    WHEN 2 THEN concat(w, 'Http_', w) ELSE w END AS name,
  CASE doc_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'interface' END AS kind,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'BaseModel, X' WHEN 2 THEN ' RealBase, ABC' WHEN 3 THEN 'Enum' ELSE 'other' END AS bases
FROM (SELECT doc_id, split_part('{VOCABULARY}', ' ', CAST(doc_id % {len(VOCABULARY.split())} + 1 AS INT)) AS w FROM documents)"""


def names(s, d):
    docs(s, d).createOrReplaceTempView("_naming_documents")
    return s.sql(NAMES.replace("FROM documents", "FROM _naming_documents"))


add("humanize_symbol",
    lambda s, d: names(s, d).select("doc_id", N.humanize_symbol(F.col("name"), F.col("kind"), F.col("bases")).alias("inferred")),
    f"WITH named AS ({NAMES}), {humanize_sql('named', 'told')} SELECT doc_id, inferred FROM told")
add("simplify_params",
    lambda s, d: names(s, d).select("doc_id", N.simplify_params(F.concat(F.lit("self, "), "name", F.lit(": int = 3, ,"), "bases")).alias("params")),
    f"""WITH named AS ({NAMES}) SELECT doc_id, '(' || array_to_string(list_filter(list_transform(string_split('self, ' || name || ': int = 3, ,' || bases, ','),
      lambda p: {strip("split_part(split_part(p, ':', 1), '=', 1)")}), lambda n: n NOT IN ('', 'self', 'cls')), ', ') || ')' AS params FROM named""")
