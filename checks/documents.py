"""Documents: blocks of each type, start commands and assembled bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, feature_sql, hit_case, in_list, tree
from checks.context import ALL, RESPONSES, WHOLE_ANSWERS, whole_answers
from checks.facts import START, big
from checks.scan import quoted
from checks.summaries import counted_sql
from codestrata.functions import markdown as M
from codestrata.functions.doc_types import DocumentType, document_types
from codestrata.functions.naming import DOCUMENT_TITLES
from codestrata.functions.paths import CONFIG_FORMATS, CONFIG_PURPOSES
from codestrata.plans import documents as DO
from codestrata.plans.profile import profile_tables

registry = Registry()
add = registry.add


def lit(text: str) -> str:
    """A text with line breaks as SQL."""
    return "concat(" + ", chr(10), ".join(quoted(line) for line in text.split("\n")) + ")"


TITLE = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DOCUMENT_TITLES.items()) + " END"
RP = f"""
rp AS (SELECT f.repo, f.files, l.language AS languages, ca.category AS categories,
    (SELECT language FROM feat x WHERE x.repo = f.repo GROUP BY language ORDER BY count(*) DESC, language LIMIT 1) AS main_language,
    (SELECT string_agg(marker, ', ' ORDER BY marker) FROM markers m WHERE m.repo = f.repo AND kind = 'tool') AS tools,
    (SELECT string_agg(marker, ', ' ORDER BY marker) FROM markers m WHERE m.repo = f.repo AND kind = 'framework') AS frameworks
  FROM (SELECT repo, count(*) AS files FROM feat GROUP BY repo) f JOIN {counted_sql('language', 5)} l USING (repo) JOIN {counted_sql('category', 5)} ca USING (repo)),
cfg AS (SELECT repo, path, CASE lname {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONFIG_FORMATS.items())} END AS config_type,
    coalesce({hit_case('lname', CONFIG_PURPOSES)}, 'Configuration') AS purpose FROM feat WHERE lname IN {in_list(list(CONFIG_FORMATS))})"""


def head(table: str, order: str, n: int, condition: str = "true", keys: str = "repo") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rk FROM {table} WHERE {condition}) WHERE rk <= {n})"


def joined(table: str, order: str, item: str, n: int, separator: str, condition: str = "true", keys: str = "repo") -> str:
    return f"(SELECT {keys}, string_agg({item}, {separator} ORDER BY rk) AS items FROM {head(table, order, n, condition, keys)} GROUP BY {keys})"


def having(table: str, condition: str = "true") -> str:
    return f"(SELECT DISTINCT repo FROM {table} WHERE {condition})"


def lacking(table: str, condition: str = "true") -> str:
    return f"(SELECT repo FROM rp WHERE repo NOT IN (SELECT repo FROM {table} WHERE {condition}))"


Row = tuple[int, str, str, str, str]


def row(section: int, source: str, text: str, k1: str = "''", k2: str = "0") -> Row:
    return section, source, text, k1, k2


TITLED = "array_to_string(list_transform(regexp_extract_all(replace(replace(name, '-', ' '), '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2))), '')"


def script_rows(section: int, limit: int, title: str, condition: str = "true") -> list[Row]:
    return [
        row(section, having("scripts", condition), lit(f"\n## {title}\n\n| Command | Purpose |\n|---|---|")),
        row(section + 1, head("scripts", "source_ord, pos", limit, condition), f"concat('| `', command, '` | ', {TITLED}, ' |')", "''", "rk"),
    ]


def flow_part(title: str, column: str) -> str:
    return f"CASE WHEN {column} <> '' THEN chr(10) || '- **{title}**: ' || replace({column}, '|', ', ') ELSE '' END"


def symbol_part(kind: str, signature: str) -> str:
    return f"""(SELECT string_agg('- `' || name || {signature} || '`' || CASE WHEN docstring <> '' THEN ' - ' || docstring ELSE '' END, chr(10) ORDER BY rk) FROM (
      SELECT *, row_number() OVER (ORDER BY rank) AS rk FROM top_sym s WHERE s.repo = x.repo AND s.dir_key = x.dir_key AND symbol_type = '{kind}') WHERE rk <= 8)"""


ENTRY_KEY = ("source_ord || ' ' || target", "pos")
RUN, DEV = "NOT dev_only", "dev_only"
QUALITY = f"regexp_matches(lower(name), '{DO.facts.QUALITY_WORDS}')"
INSTALL = f"regexp_matches(lower(name), '{DO.facts.INSTALL_WORDS}')"
OPS_FILES = "doc_signal IN ('workflow', 'operational')"
ARCH = ("(SELECT repo, path, name, CASE WHEN depth > 1 THEN array_to_string(seg[:depth - 1], '/') ELSE '.' END AS folder FROM "
        + head("feat", "path", 15, "doc_signal = 'architecture'") + ")")
FOLDERS = joined(ARCH, "path", "'│   ├── ' || name", 5, "chr(10)", "true", "repo, folder")

DOCUMENTS: dict[str, list[Row]] = {
    "repository-overview": [
        row(30, "rp", "concat('## At a Glance', chr(10), chr(10), '| Metric | Value |', chr(10), '|---|---|', chr(10), '| Total files | ', files, ' |', chr(10), '| Main language | ', main_language, ' |', chr(10), "
            "'| Build tools | ', coalesce(tools, 'None detected'), ' |', chr(10), '| Frameworks | ', coalesce(frameworks, 'None detected'), ' |', chr(10))"),
        row(40, "rp", "concat('## Languages', chr(10), chr(10), languages, chr(10), chr(10), '## Categories', chr(10), chr(10), categories, chr(10))"),
        row(50, having("deps"), lit("## Dependencies\n")),
        row(51, joined("deps", "source_ord, pos", "'`' || name || '`'", 15, "', '", RUN), "'**Runtime**: ' || items"),
        row(52, joined("deps", "source_ord, pos", "'`' || name || '`'", 10, "', '", DEV), "chr(10) || '**Development**: ' || items"),
        row(60, having("entries"), lit("\n## Entry Points\n\n| Name | Type | Command |\n|---|---|---|")),
        row(61, "entries", "concat('| ', name, ' | ', entry_type, ' | ', coalesce('`' || command || '`', '-'), ' |')", *ENTRY_KEY),
        row(90, "rp", lit("\n## Documentation Set\n")),
        row(91, "needs", f"'- ' || {TITLE}", "''", "ord"),
    ],
    "architecture-guide": [
        row(20, "rp", "concat('## Directory Structure', chr(10), chr(10), '```', chr(10), repo, '/')"),
        row(21, head(FOLDERS, "folder", 10), "concat('├── ', folder, '/', chr(10), items)", "''", "rk"),
        row(22, "rp", lit("```\n")),
        row(30, having("feat", "is_entry_point"), lit("## Entry Points\n")),
        row(31, "(SELECT * FROM feat WHERE is_entry_point)", "concat('- `', path, '` - ', language, ' entry point')", "path"),
        row(40, "rp", lit("\n## Key Classes and Functions\n")),
        row(41, f"(SELECT *, {symbol_part('class', quoted(''))} AS cl, {symbol_part('function', 'signature')} AS fu FROM {head('directories', 'dir_key', 10)} x WHERE symbols > 0)",
            "concat('### ', dir_key, '/', chr(10), coalesce(chr(10) || '**Classes:**' || chr(10) || cl || chr(10), ''), coalesce(chr(10) || '**Functions:**' || chr(10) || fu || chr(10), ''))", "dir_key"),
        row(50, "rp", lit(DO.EXTENDING)),
    ],
    "developer-workflows": [
        row(20, "rp", lit("## Purpose\n\nHow contributors build, test, run and maintain this repository.\n\n## Workflow Files\n")),
        row(21, head("feat", "path", 12, OPS_FILES), "concat('- `', path, '` (', category, ')')", "''", "rk"),
        row(21, lacking("feat", OPS_FILES), lit("- No workflow files were found.")),
        *script_rows(30, 15, "Development Commands"),
        row(40, "flags", lit("\n## Hosting Configuration")),
        row(41, having("owners"), lit("\n### Code Ownership\n\n| Path Pattern | Owner |\n|---|---|")),
        row(42, f"(SELECT * FROM {head('owners', 'pos', 10)} WHERE len(words) > 1)", "concat('| `', words[1], '` | ', array_to_string(words[2:], ' '), ' |')", "''", "rk"),
        row(43, "(SELECT * FROM pick WHERE what = 'dependabot')",
            "concat(chr(10), '### Dependency Updates', chr(10), chr(10), 'Enabled for: ', array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'package-ecosystem:\\s*[\"'']?([a-z-]+)', 1))), ', '))"),
        row(44, having("templates"), lit("\n### Issue Templates\n")),
        row(45, "templates", "'- ' || template", "path"),
        row(46, "(SELECT * FROM flags WHERE pr_template)", lit("\n### Pull Requests\n\nA template is configured.")),
        row(47, having("actions"), lit("\n### Custom Actions\n")),
        row(48, "actions", "'- `' || action || '`'", "action"),
    ],
    "quality-and-validation": [
        row(20, "rp", lit("## Purpose\n\nHow changes are checked before they are merged or released.\n\n## Tests\n")),
        row(21, head("feat", "path", 12, "category = 'tests'"), "concat('- `', path, '` (', language, ')')", "''", "rk"),
        row(21, lacking("feat", "category = 'tests'"), lit("- No test files were found.")),
        row(30, having("workflows"), lit("\n## CI/CD Pipeline\n")),
        row(31, "workflows", "concat('### ', name, chr(10), chr(10), '- **Platform**: ', platform, chr(10), '- **File**: `', path, '`', "
            + ", ".join([flow_part("Triggers", "triggers"), flow_part("Jobs", "jobs"), flow_part("Environments", "environments"), flow_part("Required Secrets", "secrets_used")]) + ")",
            "platform_ord || ' ' || path"),
        *script_rows(40, 10, "Quality Commands", QUALITY),
    ],
    "getting-started": [
        row(20, "rp", """concat('## Goal', chr(10), chr(10), 'What a new contributor needs to start safely.', chr(10), chr(10), '## Prerequisites', chr(10), chr(10),
          array_to_string(list_filter([CASE WHEN main_language = 'Python' THEN '- Python 3.10 or newer' END, CASE WHEN main_language IN ('JavaScript', 'TypeScript') THEN '- Node.js 18 or newer' END,
            CASE WHEN main_language = 'TypeScript' THEN '- TypeScript' END, CASE WHEN list_contains(string_split(tools, ', '), 'docker') THEN '- Docker (optional, for containers)' END,
            CASE WHEN list_contains(string_split(tools, ', '), 'make') THEN '- Make (for build commands)' END], lambda z: z IS NOT NULL), chr(10)), chr(10), chr(10), '## Installation', chr(10))"""),
        row(30, f"""(SELECT rp.repo, coalesce(items, CASE WHEN main_language = 'Python' THEN 'pip install -e .' WHEN main_language IN ('JavaScript', 'TypeScript') THEN 'npm install' END) AS cmd
          FROM rp LEFT JOIN {joined('scripts', 'source_ord, pos', 'command', 3, 'chr(10)', INSTALL)} i ON i.repo = rp.repo)""",
            "CASE WHEN cmd IS NOT NULL THEN concat('```bash', chr(10), cmd, chr(10), '```') END"),
        row(40, "rp", lit("\n## Quick Start\n")),
        row(41, "(SELECT * FROM first_entry WHERE nth = 1 AND command IS NOT NULL)", "concat('```bash', chr(10), command, chr(10), '```')"),
        row(50, "rp", lit(DO.NEXT_STEPS)),
    ],
    "usage-patterns": [
        row(20, "rp", lit("## Goal\n\nThe most important ways to use this repository.\n")),
        row(30, having("feat", "category = 'examples'"), lit("## Example Files\n")),
        row(31, head("feat", "path", 12, "category = 'examples'"), "concat('- `', path, '` - ', language)", "''", "rk"),
        row(40, having("endpoints"), lit("\n## API Usage\n\n| Method | Path | Description |\n|---|---|---|")),
        row(41, head("endpoints", "path, pos", 10), "concat('| `', method, '` | `', endpoint, '` | Endpoint at ', endpoint, ' |')", "''", "rk"),
        row(50, having("entries"), lit("\n## Command Line Usage")),
        row(51, head("entries", "source_ord, target, pos", 5), "concat(chr(10), '### ', name, coalesce(chr(10) || chr(10) || '```bash' || chr(10) || command || chr(10) || '```', ''))", "''", "rk"),
    ],
    "configuration-guide": [
        row(20, "rp", lit("## Environment Variables\n")),
        row(21, having("envs"), lit("| Variable | Required | Default | Source |\n|---|---|---|---|")),
        row(22, "envs", "concat('| `', name, '` | Yes | ', coalesce(default_value, '-'), ' | ', regexp_extract(source_file, '[^/]*$'), ' |')", "source_ord || ' ' || source_file", "pos"),
        row(22, lacking("envs"), lit("No environment variables were found.")),
        row(30, "rp", lit("\n## Configuration Files\n")),
        row(31, "cfg", "concat('### `', path, '`', chr(10), '- **Type**: ', config_type, chr(10), '- **Purpose**: ', purpose, chr(10))", "path"),
        row(31, lacking("cfg"), lit("No configuration files were found.")),
    ],
    "deployment-runbook": [
        row(20, "rp", lit("## Prerequisites")),
        row(21, having("deps", RUN), lit("\n### Runtime Dependencies\n")),
        row(22, head("deps", "source_ord, pos", 20, RUN), "concat('- `', name, '`', coalesce(' (' || version || ')', ''))", "''", "rk"),
        row(23, having("envs"), lit("\n### Required Environment Variables\n")),
        row(24, head("envs", "source_ord, source_file, pos", 15), "'- `' || name || '`'", "''", "rk"),
        row(30, "rp", lit("\n## Deployment Steps")),
        row(31, having("entries"), lit("\n### Entry Points\n")),
        row(32, "entries", "concat('- **', name, '** (', entry_type, ')', coalesce(' - `' || command || '`', ''))", *ENTRY_KEY),
        row(40, "(SELECT * FROM rp WHERE list_contains(string_split(tools, ', '), 'docker'))",
            "concat(chr(10), '### Containers', chr(10), chr(10), '```bash', chr(10), 'docker build -t ', lower(repo), ' .', chr(10), 'docker run -d ', lower(repo), chr(10), '```')"),
        row(50, "rp", lit(DO.ROLLBACK)),
    ],
    "api-reference": [
        row(20, having("endpoints"), lit("## Endpoints\n\n| Method | Path | Source |\n|---|---|---|")),
        row(21, "endpoints", "concat('| `', method, '` | `', endpoint, '` | ', path, ' |')", "path", "pos"),
        row(21, lacking("endpoints"), lit("No API endpoints were found. Endpoints that exist can be described here.")),
    ],
    "operations-runbook": [
        row(20, "rp", lit("## Available Commands\n")),
        row(21, having("scripts"), lit("| Command | Description | Source |\n|---|---|---|")),
        row(22, "scripts", "concat('| `', command, '` | - | ', source, ' |')", "CAST(source_ord AS VARCHAR)", "pos"),
        row(22, lacking("scripts"), lit("No scripts were found.")),
        row(30, "rp", lit("\n## Common Operations\n\n### Starting\n")),
        row(31, "(SELECT * FROM start_cmd WHERE command IS NOT NULL)", "concat('```bash', chr(10), command, chr(10), '```')"),
        row(31, "(SELECT * FROM start_cmd WHERE NOT known)", lit("See the project documentation.")),
        row(40, "rp", lit(DO.OPERATING)),
    ],
}
START_CMD = f"""{START},
start_cmd AS (SELECT rp.repo, coalesce(s.command, e.command) AS command, s.repo IS NOT NULL OR e.repo IS NOT NULL AS known
  FROM rp LEFT JOIN (SELECT * FROM starts WHERE nth = 1) s ON s.repo = rp.repo LEFT JOIN (SELECT * FROM first_entry WHERE nth = 1) e ON e.repo = rp.repo)"""


def blocks_sql(doc_types: list[str]) -> str:
    parts = []
    for doc_type in doc_types:
        title = row(10, "rp", f"concat('# ', repo, ' {DOCUMENT_TITLES[doc_type]}', chr(10))")
        for section, source, text, k1, k2 in [title, *DOCUMENTS[doc_type]]:
            parts.append(f"SELECT repo, '{doc_type}' AS doc_type, {section} AS section, {k1} AS k1, CAST({k2} AS BIGINT) AS k2, {text} AS text FROM {source}")
    return "blocks AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE text IS NOT NULL)"


CTES = [*ALL, RP, START_CMD]


def tables(s, d):
    return profile_tables(tree(s, d)).kept()


for doc_type in DO.SECTION_BUILDERS:
    add("sections_" + doc_type.replace("-", "_"),
        lambda s, d, doc_type=doc_type: big()(DO.document_blocks(tables(s, d), [doc_type])),
        feature_sql("SELECT repo, doc_type, section, k1, k2, text FROM blocks", *CTES, blocks_sql([doc_type])))

add("start_command", lambda s, d: DO.start_command(DO.with_repos(tables(s, d))), feature_sql("SELECT repo, command, known FROM start_cmd", *CTES))

BODIES = "bodies AS (SELECT repo, doc_type, 1::BIGINT AS part, string_agg(text, chr(10) ORDER BY section, k1, k2) AS body FROM blocks SEMI JOIN needs USING (repo, doc_type) GROUP BY repo, doc_type)"
add("repo_documents", lambda s, d: DO.repo_documents(tables(s, d)).withColumn("body", F.md5("body")),
    feature_sql(f"""SELECT repo, doc_type, part, replace(upper(doc_type), '-', '_') || '.md' AS filename, repo || ' ' || {TITLE} AS title,
      'DOC-' || substring(upper(repo), 1, 10) || '-' || substring(upper(doc_type), 1, 15) AS control_id, md5(body) AS body FROM bodies""", *CTES, blocks_sql(list(DOCUMENTS)), BODIES))


RELEASE = DocumentType(
    "release-notes", "Release Notes", when=lambda: F.col("scripts") | F.col("docker"), sections=("Changes", "Upgrading"), before="usage-patterns",
    rules=lambda t: [
        DO.Rule("repos", 20, "## Commands\n", DO.has("scripts")),
        DO.Rule("scripts", 21, F.concat(F.lit("- `"), F.col("command"), F.lit("`")), None, F.col("source_ord"), F.col("pos")),
        DO.Rule("repos", 30, F.concat(F.lit("\n## Size\n\n"), F.col("files").cast("string"), F.lit(" files"))),
    ])


def added_documents(s, d):
    """Documents of a type that the library does not have."""
    with document_types(RELEASE):
        return big()(DO.repo_documents(tables(s, d), doc_types=["release-notes"]).select("repo", "doc_type", "filename", "title", "body"))


add("repo_documents_added_type", added_documents, feature_sql("""SELECT repo, 'release-notes' AS doc_type, 'RELEASE_NOTES.md' AS filename, repo || ' Release Notes' AS title,
      string_agg(text, chr(10) ORDER BY section, k1, k2) AS body FROM release SEMI JOIN (SELECT repo FROM needs_b WHERE script OR docker) USING (repo) GROUP BY repo""", *CTES, f"""
release AS (SELECT repo, 10 AS section, '' AS k1, 0 AS k2, concat('# ', repo, ' Release Notes', chr(10)) AS text FROM rp
  UNION ALL SELECT repo, 20, '', 0, concat('## Commands', chr(10)) FROM {having("scripts")}
  UNION ALL SELECT repo, 21, CAST(source_ord AS VARCHAR), pos, '- `' || command || '`' FROM scripts
  UNION ALL SELECT repo, 30, '', 0, concat(chr(10), '## Size', chr(10), chr(10), files, ' files') FROM rp)"""))


def semantic_overview(s, d):
    """The overview with purpose, concepts and architecture from all answers about the repository."""
    fields = M.parse_labelled_fields(whole_answers(s, d).filter(F.col("doc_type") == "repository-overview"), ["repo"], "body")
    return big()(DO.document_blocks(tables(s, d).extended(semantics=fields), ["repository-overview"]))


SEMANTICS = [
    RESPONSES, WHOLE_ANSWERS,
    "al AS (SELECT repo, trim(unnest(string_split(body, chr(10)))) AS st, generate_subscripts(string_split(body, chr(10)), 1) AS ln FROM whole_answers WHERE doc_type = 'repository-overview')",
    """f AS (SELECT repo, max_by(trim(replace(st, 'PURPOSE:', '')), ln) FILTER (starts_with(st, 'PURPOSE:')) AS purpose, max_by(trim(replace(st, 'ARCHITECTURE:', '')), ln) FILTER (starts_with(st, 'ARCHITECTURE:')) AS architecture,
    list_filter(list_transform(string_split(max_by(trim(replace(st, 'CONCEPTS:', '')), ln) FILTER (starts_with(st, 'CONCEPTS:')), ','), lambda x: trim(x)), lambda x: x <> '') AS concepts FROM al GROUP BY repo)""",
]
add("sections_overview_with_semantics", semantic_overview, feature_sql(f"""SELECT repo, doc_type, section, k1, k2, text FROM blocks
UNION ALL SELECT repo, 'repository-overview', 20, '', 0, concat('## What This Repository Does', chr(10), chr(10), purpose, chr(10)) FROM f WHERE purpose <> ''
UNION ALL SELECT repo, 'repository-overview', 70, '', 0, {lit(chr(10) + '## Key Concepts' + chr(10))} FROM f WHERE len(concepts) > 0
UNION ALL SELECT repo, 'repository-overview', 71, '', generate_subscripts(concepts, 1) - 1, '- **' || unnest(concepts) || '**' FROM f
UNION ALL SELECT repo, 'repository-overview', 80, '', 0, concat(chr(10), '## Architecture Overview', chr(10), chr(10), architecture) FROM f WHERE architecture <> ''""",
    *CTES, blocks_sql(["repository-overview"]), *SEMANTICS))
