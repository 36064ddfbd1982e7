"""Documents per repository, written as ordered blocks and joined into bodies.

A document type is a list of rules. A rule says which rows of a source give a block, where it stands and what it says; all rules
of a source are applied to its rows in one pass. What depends on whether a repository has a list at all is a rule of the
one row that a repository has, whose flags come from one grouping over all lists. Lists without a limit give a block for
each item, so a repository with very many items never has to fit into one row before the final, size-bounded assembly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.doc_types import with_added
from codestrata.functions.naming import control_id, document_filename, document_title, document_titles
from codestrata.functions.paths import CATEGORY_NAMES, LANGUAGE_NAMES, file_name, lookup, parent_folder
from codestrata.operators import facts
from codestrata.operators.ordering import assemble, head_per_group
from codestrata.operators.summaries import by_count, counted_map, format_counts
from codestrata.plans.context import text, union_all
from codestrata.plans.profile import BUILDERS, ProfileTables
from codestrata.sources.tables import settle

ORDER = ["section", "k1", "k2"]
Tables = ProfileTables

START_NAMES = ["start", "serve", "run", "dev"]

EXTENDING = "\n".join([
    "", "## Where to extend", "",
    "- Features: follow the patterns of the application folders",
    "- Integrations: follow the existing connections and providers",
    "- Tests: mirror the layout of the test folder",
])
ROLLBACK = "\n".join([
    "", "## Rollback", "",
    "1. Find the last good version", "2. Deploy it again", "3. Check that the service is healthy", "4. Look for the cause",
    "", "## Health checks", "",
    "- [ ] The health endpoint answers", "- [ ] The logs are free of errors", "- [ ] Metrics are in their usual range",
])
OPERATING = "\n".join([
    "", "### Stopping", "",
    "- Gracefully: SIGTERM", "- By force: SIGKILL",
    "", "## Troubleshooting", "",
    "| Symptom | Cause | Remedy |", "|---|---|---|",
    "| Does not start | A variable is missing | See the configuration guide |",
    "| Connection refused | Not running | Look at the processes |",
    "| Slow answers | Resources exhausted | Look at the system load |",
    "", "### Logs", "",
    "- Application: standard output, or as configured", "- Errors: the error handlers of the application",
])
NEXT_STEPS = "\n".join([
    "", "## Next steps", "",
    "1. [Repository Overview](REPOSITORY_OVERVIEW.md)", "2. [Configuration Guide](CONFIGURATION_GUIDE.md)",
    "3. [Developer Workflows](DEVELOPER_WORKFLOWS.md)",
])

c = F.col


class Rule(NamedTuple):
    """Rows of ``source`` for which ``when`` holds give a block of ``section``; ``k1`` and ``k2`` order blocks within it."""

    source: str
    section: int
    text: Column | str
    when: Column | None = None
    k1: Column | None = None
    k2: Column | None = None

    def block(self, doc_type: str) -> Column:
        body = F.lit(self.text) if isinstance(self.text, str) else self.text
        block = F.struct(
            F.lit(doc_type).alias("doc_type"), F.lit(self.section).alias("section"),
            (F.lit("") if self.k1 is None else self.k1.cast("string")).alias("k1"),
            (F.lit(0) if self.k2 is None else self.k2).cast("int").alias("k2"), body.alias("text"),
        )
        return block if self.when is None else F.when(self.when, block)


def title_case(name: Column) -> Column:
    """Every run of letters capitalized, dashes and underscores as spaces."""
    runs = F.regexp_extract_all(F.translate(name, "-_", "  "), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), ""
    )


# --- sources ----------------------------------------------------------------------------------------------------------


LISTED = ["codeowners", "issue_templates", "custom_actions", "ci_workflows", "api_endpoints", "config_files"]


def _presence(t: Tables) -> DataFrame:
    """Per repository the lists it has, its first start script and its first entry point, from one grouping over all lists.

    Every task reduces its rows to a few flags and two places before the shuffle.
    """

    def flagged(name: str, always: str, flags: dict[str, Column] | None = None, **more: Column) -> DataFrame:
        marks = F.array_compact(F.array(F.lit(always), *[F.when(holds, F.lit(flag)) for flag, holds in (flags or {}).items()]))
        return t[name].select("repo", marks.alias("flags"), *[column.alias(alias) for alias, column in more.items()])

    low = F.lower("name")
    begins = c("name").isin(START_NAMES)
    kinds = {"quality": low.rlike(facts.QUALITY_WORDS), "install": low.rlike(facts.INSTALL_WORDS)}
    parts = [
        flagged("dependencies", "dependencies", {"runtime": ~c("dev_only")}),
        flagged("entry_points", "entries", entry=F.struct("source_ord", "target", "pos", "command")),
        flagged("scripts", "scripts", kinds, start=F.when(begins, F.struct("source_ord", "pos", "command"))),
        flagged("env_variables", "envs", {"required": c("required")}),
        *[flagged(name, name) for name in LISTED],
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy("repo").agg(
        F.array_distinct(F.flatten(F.collect_set("flags"))).alias("has"), F.min("start").alias("start"), F.min("entry").alias("entry")
    )


def with_repos(tables: Tables) -> Tables:
    """Adds one row per repository with its totals, main language and tools, and which lists it has."""
    tables.together("features", "markers", "dependencies", "entry_points", "scripts", "env_variables", *LISTED)
    base = tables["features"].groupBy("repo").agg(
        F.count("*").alias("files"),
        counted_map("language", LANGUAGE_NAMES).alias("languages"),
        counted_map("category", CATEGORY_NAMES).alias("categories"),
        *[F.max(F.coalesce(holds, F.lit(False))).alias(f"has_{kind}") for kind, (holds, _) in _file_kinds().items()],
        F.max(c("is_entry_point")).alias("has_entry_files"),
    )

    def names(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(c("kind") == kind, c("marker"))))

    found = tables["markers"].groupBy("repo").agg(names("tool").alias("tools"), names("framework").alias("frameworks"))
    none = F.array().cast("array<string>")
    repos = base.join(found, "repo", "left").join(_presence(tables), "repo", "left").select(
        "repo", "files",
        format_counts(c("languages"), 5).alias("languages"),
        format_counts(c("categories"), 5).alias("categories"),
        F.get(by_count(c("languages")), F.lit(0))["name"].alias("main_language"),
        *[F.coalesce(name, none).alias(name) for name in ("tools", "frameworks", "has")],
        *[f"has_{kind}" for kind in (*_file_kinds(), "entry_files")], "start", "entry",
    )
    return tables.extended(repos=settle(repos))


def has(flag: str) -> Column:
    return F.array_contains("has", flag)


def _file_kinds() -> dict[str, tuple[Column, int]]:
    """Kinds of files that documents list the first of, and how many."""
    return {
        "architecture": (c("doc_signal") == "architecture", 15),
        "workflow": (c("doc_signal").isin("workflow", "operational"), 12),
        "tests": (c("category") == "tests", 12),
        "examples": (c("category") == "examples", 12),
    }


def _heads(rows: DataFrame, kinds: dict[str, tuple[Column, int]], order: list[str]) -> DataFrame:
    """The first rows of each kind with their rank: one ranking for all kinds, a row once for each kind that it is of."""
    own = F.array_compact(F.array(*[F.when(holds, F.lit(kind)) for kind, (holds, _) in kinds.items()]))
    head = head_per_group(rows.withColumn("kind", F.explode(own)), ["repo", "kind"], order, max(n for _, n in kinds.values()))
    return head.filter(reduce(lambda a, b: a | b, [(c("kind") == kind) & (c("rank") <= n) for kind, (_, n) in kinds.items()]))


def _with_line(head: DataFrame, item: Column) -> DataFrame:
    """``line``: the items of the row's group in order. The groups are bounded and lie together already."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))).over(Window.partitionBy("repo", "kind")))
    return head.withColumn("line", F.transform(ordered, lambda x: x["item"]))


def _dependency_heads(t: Tables) -> DataFrame:
    head = _heads(t["dependencies"], {"runtime": (~c("dev_only"), 20), "dev": (c("dev_only"), 10)}, ["source_ord", "pos"])
    return _with_line(head, _ticked("name"))


def _script_heads(t: Tables) -> DataFrame:
    low = F.lower("name")
    kinds = {"scripts": (F.lit(True), 15), "quality": (low.rlike(facts.QUALITY_WORDS), 10), "install": (low.rlike(facts.INSTALL_WORDS), 3)}
    return _with_line(_heads(t["scripts"], kinds, ["source_ord", "pos"]), c("command"))


def _folders(t: Tables) -> DataFrame:
    """The folders of the first application files, each with its first files; at most fifteen files a repository."""
    app = t["file_heads"].filter(c("kind") == "architecture")
    placed = app.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(parent_folder("path").alias("folder"), c("path"), file_name("path").alias("file")))).alias("placed"))
    bound = F.array(F.struct("placed", F.slice(F.array_sort(F.array_distinct(c("placed.folder"))), 1, 10).alias("names")))

    def tree(b: Column) -> Column:
        def files(folder: Column) -> Column:
            own = F.slice(F.filter(b["placed"], lambda x: x["folder"] == folder), 1, 5)
            return F.array_join(F.transform(own, lambda x: F.concat(F.lit("│   ├── "), x["file"])), "\n")

        return F.transform(b["names"], lambda folder, i: F.struct((i + 1).alias("rank"), folder.alias("folder"), files(folder).alias("names")))

    return placed.select("repo", F.inline(F.flatten(F.transform(bound, tree))))


def _symbol_groups(t: Tables) -> DataFrame:
    """The first ten directories with their first classes and functions, of the fifty symbols that a directory keeps at most."""
    keys = ["repo", "dir_key"]
    first = head_per_group(t["directories"].select(*keys, "symbols"), ["repo"], ["dir_key"], 10).filter("symbols > 0").select(*keys)
    about = F.when(c("docstring") != "", text(" - ", c("docstring"))).otherwise("")

    def listed(kind: str, signature: str | Column, alias: str) -> Column:
        item = F.struct("rank", text("- `", c("name"), signature, "`", about).alias("item"))
        ordered = F.slice(F.array_sort(F.collect_list(F.when(c("symbol_type") == kind, item))), 1, 8)
        return F.array_join(F.transform(ordered, lambda x: x["item"]), "\n").alias(alias)

    grouped = t["top_symbols"].join(first, keys, "left_semi").groupBy(*keys).agg(listed("class", "", "classes"), listed("function", c("signature"), "functions"))
    return first.join(grouped, keys, "left")


def _first(name: str, order: list[str], n: int, only: Callable[[], Column] | None = None) -> Callable[[Tables], DataFrame]:
    return lambda t: head_per_group(t[name] if only is None else t[name].filter(only()), ["repo"], order, n)


SOURCES: dict[str, Callable[[Tables], DataFrame]] = {
    "file_heads": lambda t: _heads(t["features"].select("repo", "path", "language", "category", "doc_signal"), _file_kinds(), ["path"]),
    "entry_files": lambda t: t["features"].filter("is_entry_point"),
    "folders": _folders,
    "symbol_groups": _symbol_groups,
    "dependency_heads": _dependency_heads,
    "script_heads": _script_heads,
    "owner_heads": _first("codeowners", ["pos"], 10),
    "env_heads": _first("env_variables", ["source_ord", "source_file", "pos"], 15, lambda: c("required")),
    "endpoint_heads": _first("api_endpoints", ["path", "pos"], 10),
    "entry_heads": _first("entry_points", ["source_ord", "target", "pos"], 5),
    "concepts": lambda t: t["semantics"].select("repo", F.posexplode("concepts").alias("pos", "concept")),
}


# Tables that sources with a name of their own are made of, where there is more than one step to them.
TABLES_OF = {"symbol_groups": ["symbols", "directories", "top_symbols", "features"]}


# --- rules ------------------------------------------------------------------------------------------------------------


def _names_or_none(column: str) -> Column:
    return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise("None detected")


def _entry_key() -> Column:
    return text(c("source_ord"), " ", c("target"))


def _ticked(column: Column | str) -> Column:
    return text("`", c(column) if isinstance(column, str) else column, "`")


def _line(n: int, separator: str = ", ") -> Column:
    return F.array_join(F.slice("line", 1, n), separator)


def rules_overview(t: Tables) -> list[Rule]:
    command = F.coalesce(_ticked("command"), F.lit("-"))
    head = c("rank") == 1
    rules = [
        Rule("repos", 30, text(
            "## At a Glance\n\n| Metric | Value |\n|---|---|\n| Total files | ", c("files"), " |\n| Main language | ", c("main_language"),
            " |\n| Build tools | ", _names_or_none("tools"), " |\n| Frameworks | ", _names_or_none("frameworks"), " |\n")),
        Rule("repos", 40, text("## Languages\n\n", c("languages"), "\n\n## Categories\n\n", c("categories"), "\n")),
        Rule("repos", 50, "## Dependencies\n", has("dependencies")),
        Rule("dependency_heads", 51, text("**Runtime**: ", _line(15)), head & (c("kind") == "runtime")),
        Rule("dependency_heads", 52, text("\n**Development**: ", _line(10)), head & (c("kind") == "dev")),
        Rule("repos", 60, "\n## Entry Points\n\n| Name | Type | Command |\n|---|---|---|", has("entries")),
        Rule("entry_points", 61, text("| ", c("name"), " | ", c("entry_type"), " | ", command, " |"), None, _entry_key(), c("pos")),
        Rule("repos", 90, "\n## Documentation Set\n"),
        Rule("doc_needs", 91, text("- ", lookup(document_titles(), c("doc_type"))), None, None, c("ord")),
    ]
    if "semantics" in t:
        rules += [
            Rule("semantics", 20, text("## What This Repository Does\n\n", c("purpose"), "\n"), c("purpose") != ""),
            Rule("semantics", 70, "\n## Key Concepts\n", F.size("concepts") > 0),
            Rule("concepts", 71, text("- **", c("concept"), "**"), None, None, c("pos")),
            Rule("semantics", 80, text("\n## Architecture Overview\n\n", c("architecture")), c("architecture") != ""),
        ]
    return rules


def rules_architecture(t: Tables) -> list[Rule]:
    listed = lambda title, column: F.when(c(column) != "", text(f"\n**{title}:**\n", c(column), "\n")).otherwise("")
    rules = [
        Rule("repos", 20, text("## Directory Structure\n\n```\n", c("repo"), "/")),
        Rule("folders", 21, text("├── ", c("folder"), "/\n", c("names")), None, None, c("rank")),
        Rule("repos", 22, "```\n"),
        Rule("repos", 30, "## Entry Points\n", c("has_entry_files")),
        Rule("entry_files", 31, text("- `", c("path"), "` - ", c("language"), " entry point"), None, c("path")),
        Rule("repos", 40, "\n## Key Classes and Functions\n"),
        Rule("symbol_groups", 41, text("### ", c("dir_key"), "/\n", listed("Classes", "classes"), listed("Functions", "functions")), None, c("dir_key")),
        Rule("repos", 50, EXTENDING),
    ]
    if "semantics" in t:
        rules.append(Rule("semantics", 15, text("## Overview\n\n", c("architecture"), "\n"), c("architecture") != ""))
    return rules


def _script_rules(section: int, kind: str, title: str) -> list[Rule]:
    return [
        Rule("repos", section, f"\n## {title}\n\n| Command | Purpose |\n|---|---|", has(kind)),
        Rule("script_heads", section + 1, text("| `", c("command"), "` | ", title_case(c("name")), " |"), c("kind") == kind, None, c("rank")),
    ]


def _file_rules(section: int, kind: str, line: Column, none: str) -> list[Rule]:
    return [Rule("file_heads", section, line, c("kind") == kind, None, c("rank")), Rule("repos", section, none, ~c(f"has_{kind}"))]


def rules_developer_workflows(t: Tables) -> list[Rule]:
    return [
        Rule("repos", 20, "## Purpose\n\nHow contributors build, test, run and maintain this repository.\n\n## Workflow Files\n"),
        *_file_rules(21, "workflow", text("- `", c("path"), "` (", c("category"), ")"), "- No workflow files were found."),
        *_script_rules(30, "scripts", "Development Commands"),
        Rule("hosting_flags", 40, "\n## Hosting Configuration"),
        Rule("repos", 41, "\n### Code Ownership\n\n| Path Pattern | Owner |\n|---|---|", has("codeowners")),
        Rule("owner_heads", 42, text("| `", c("pattern"), "` | ", c("owners"), " |"), c("owners") != "", None, c("rank")),
        Rule("dependabot", 43, text("\n### Dependency Updates\n\nEnabled for: ", F.array_join("ecosystems", ", "))),
        Rule("repos", 44, "\n### Issue Templates\n", has("issue_templates")),
        Rule("issue_templates", 45, text("- ", c("template")), None, c("path")),
        Rule("hosting_flags", 46, "\n### Pull Requests\n\nA template is configured.", c("pr_template")),
        Rule("repos", 47, "\n### Custom Actions\n", has("custom_actions")),
        Rule("custom_actions", 48, text("- `", c("action"), "`"), None, c("action")),
    ]


def rules_quality(t: Tables) -> list[Rule]:
    def listed(title: str, column: str) -> Column:
        return F.when(F.size(column) > 0, text("\n- **", title, "**: ", F.array_join(column, ", "))).otherwise("")

    flow = text(
        "### ", c("name"), "\n\n- **Platform**: ", c("platform"), "\n- **File**: `", c("path"), "`",
        listed("Triggers", "triggers"), listed("Jobs", "jobs"), listed("Environments", "environments"), listed("Required Secrets", "secrets_used"),
    )
    return [
        Rule("repos", 20, "## Purpose\n\nHow changes are checked before they are merged or released.\n\n## Tests\n"),
        *_file_rules(21, "tests", text("- `", c("path"), "` (", c("language"), ")"), "- No test files were found."),
        Rule("repos", 30, "\n## CI/CD Pipeline\n", has("ci_workflows")),
        Rule("ci_workflows", 31, flow, None, text(c("platform_ord"), " ", c("path"))),
        *_script_rules(40, "quality", "Quality Commands"),
    ]


def rules_getting_started(t: Tables) -> list[Rule]:
    language = c("main_language")
    needs = F.array_compact(F.array(
        F.when(language == "Python", F.lit("- Python 3.10 or newer")),
        F.when(language.isin("JavaScript", "TypeScript"), F.lit("- Node.js 18 or newer")),
        F.when(language == "TypeScript", F.lit("- TypeScript")),
        F.when(F.array_contains("tools", "docker"), F.lit("- Docker (optional, for containers)")),
        F.when(F.array_contains("tools", "make"), F.lit("- Make (for build commands)")),
    ))
    default = F.when(language == "Python", "pip install -e .").when(language.isin("JavaScript", "TypeScript"), "npm install")
    return [
        Rule("repos", 20, text(
            "## Goal\n\nWhat a new contributor needs to start safely.\n\n## Prerequisites\n\n", F.array_join(needs, "\n"), "\n\n## Installation\n")),
        Rule("script_heads", 30, text("```bash\n", _line(3, "\n"), "\n```"), (c("kind") == "install") & (c("rank") == 1)),
        Rule("repos", 30, text("```bash\n", default, "\n```"), ~has("install") & default.isNotNull()),
        Rule("repos", 40, "\n## Quick Start\n"),
        Rule("repos", 41, text("```bash\n", c("entry.command"), "\n```"), c("entry.command").isNotNull()),
        Rule("repos", 50, NEXT_STEPS),
    ]


def rules_usage(t: Tables) -> list[Rule]:
    return [
        Rule("repos", 20, "## Goal\n\nThe most important ways to use this repository.\n"),
        Rule("repos", 30, "## Example Files\n", c("has_examples")),
        Rule("file_heads", 31, text("- `", c("path"), "` - ", c("language")), c("kind") == "examples", None, c("rank")),
        Rule("repos", 40, "\n## API Usage\n\n| Method | Path | Description |\n|---|---|---|", has("api_endpoints")),
        Rule("endpoint_heads", 41, text("| `", c("method"), "` | `", c("endpoint"), "` | Endpoint at ", c("endpoint"), " |"), None, None, c("rank")),
        Rule("repos", 50, "\n## Command Line Usage", has("entries")),
        Rule("entry_heads", 51, text("\n### ", c("name"), F.coalesce(text("\n\n```bash\n", c("command"), "\n```"), F.lit(""))), None, None, c("rank")),
    ]


def rules_configuration(t: Tables) -> list[Rule]:
    row = text(
        "| `", c("name"), "` | ", F.when(c("required"), "Yes").otherwise("No"), " | ", F.coalesce("default_value", F.lit("-")), " | ",
        file_name("source_file"), " |")
    return [
        Rule("repos", 20, "## Environment Variables\n"),
        Rule("repos", 21, "| Variable | Required | Default | Source |\n|---|---|---|---|", has("envs")),
        Rule("env_variables", 22, row, None, text(c("source_ord"), " ", c("source_file")), c("pos")),
        Rule("repos", 22, "No environment variables were found.", ~has("envs")),
        Rule("repos", 30, "\n## Configuration Files\n"),
        Rule("config_files", 31, text("### `", c("path"), "`\n- **Type**: ", c("config_type"), "\n- **Purpose**: ", c("purpose"), "\n"), None, c("path")),
        Rule("repos", 31, "No configuration files were found.", ~has("config_files")),
    ]


def rules_deployment(t: Tables) -> list[Rule]:
    version, command = (F.coalesce(text(*parts), F.lit("")) for parts in ((" (", c("version"), ")"), (" - `", c("command"), "`")))
    build = text("\n### Containers\n\n```bash\ndocker build -t ", F.lower("repo"), " .\ndocker run -d ", F.lower("repo"), "\n```")
    return [
        Rule("repos", 20, "## Prerequisites"),
        Rule("repos", 21, "\n### Runtime Dependencies\n", has("runtime")),
        Rule("dependency_heads", 22, text("- `", c("name"), "`", version), c("kind") == "runtime", None, c("rank")),
        Rule("repos", 23, "\n### Required Environment Variables\n", has("required")),
        Rule("env_heads", 24, text("- `", c("name"), "`"), None, None, c("rank")),
        Rule("repos", 30, "\n## Deployment Steps"),
        Rule("repos", 31, "\n### Entry Points\n", has("entries")),
        Rule("entry_points", 32, text("- **", c("name"), "** (", c("entry_type"), ")", command), None, _entry_key(), c("pos")),
        Rule("repos", 40, build, F.array_contains("tools", "docker")),
        Rule("repos", 50, ROLLBACK),
    ]


def rules_api(t: Tables) -> list[Rule]:
    return [
        Rule("repos", 20, "## Endpoints\n\n| Method | Path | Source |\n|---|---|---|", has("api_endpoints")),
        Rule("api_endpoints", 21, text("| `", c("method"), "` | `", c("endpoint"), "` | ", c("path"), " |"), None, c("path"), c("pos")),
        Rule("repos", 21, "No API endpoints were found. Endpoints that exist can be described here.", ~has("api_endpoints")),
    ]


def _start() -> tuple[Column, Column]:
    """The command that starts a repository, and whether it has a start script or an entry point."""
    return F.coalesce("start.command", "entry.command"), c("start").isNotNull() | c("entry").isNotNull()


def start_command(t: Tables) -> DataFrame:
    """How a repository is started: its start script, else its first entry point. Null when that has no command."""
    command, known = _start()
    return t["repos"].select("repo", command.alias("command"), known.alias("known"))


def rules_operations(t: Tables) -> list[Rule]:
    command, known = _start()
    return [
        Rule("repos", 20, "## Available Commands\n"),
        Rule("repos", 21, "| Command | Description | Source |\n|---|---|---|", has("scripts")),
        Rule("scripts", 22, text("| `", c("command"), "` | - | ", c("source"), " |"), None, c("source_ord"), c("pos")),
        Rule("repos", 22, "No scripts were found.", ~has("scripts")),
        Rule("repos", 30, "\n## Common Operations\n\n### Starting\n"),
        Rule("repos", 31, text("```bash\n", command, "\n```"), command.isNotNull()),
        Rule("repos", 31, "See the project documentation.", ~known),
        Rule("repos", 40, OPERATING),
    ]


# The built-in types; ``codestrata.functions.doc_types`` registers further ones.
SECTION_BUILDERS: dict[str, Callable[[Tables], list[Rule]]] = {
    "repository-overview": rules_overview,
    "architecture-guide": rules_architecture,
    "developer-workflows": rules_developer_workflows,
    "quality-and-validation": rules_quality,
    "getting-started": rules_getting_started,
    "usage-patterns": rules_usage,
    "configuration-guide": rules_configuration,
    "deployment-runbook": rules_deployment,
    "api-reference": rules_api,
    "operations-runbook": rules_operations,
}


def document_blocks(tables: Tables, doc_types: list[str] | None = None) -> DataFrame:
    """Blocks of the chosen document types for every repository, title first: one pass over each source."""
    builders = with_added(SECTION_BUILDERS, "rules")
    chosen = doc_types or list(builders)
    if "repos" in tables:
        t = tables
    else:
        kept = tables.kept()
        used = {name for doc_type in chosen for rule in builders[doc_type](kept) for name in TABLES_OF.get(rule.source, [rule.source])}
        t = with_repos(kept.together(*(used & set(BUILDERS))))
    blocks: dict[str, list[Column]] = {}
    for doc_type in chosen:
        title = Rule("repos", 10, text("# ", document_title(c("repo"), F.lit(doc_type)), "\n"))
        for rule in [title, *builders[doc_type](t)]:
            blocks.setdefault(rule.source, []).append(rule.block(doc_type))
    if "folders" in blocks:
        t = t.extended(file_heads=settle(SOURCES["file_heads"](t)))  # two sources come from these few rows

    def of(source: str) -> DataFrame:
        rows = SOURCES[source](t) if source in SOURCES and source not in t else t[source]
        return rows.select("repo", F.inline(F.array_compact(F.array(*blocks[source]))))

    return union_all([of(source) for source in blocks]).filter(c("text").isNotNull())


def repo_documents(tables: Tables, needs: DataFrame | None = None, doc_types: list[str] | None = None) -> DataFrame:
    """One row per needed document of each repository; a very long document continues in further parts."""
    tables = tables.kept() if "repos" not in tables else tables
    blocks = document_blocks(tables, doc_types)
    wanted = tables["doc_needs"] if needs is None else settle(needs)
    blocks = blocks.join(wanted.select("repo", "doc_type"), ["repo", "doc_type"], "left_semi")
    bodies = assemble(blocks, ["repo", "doc_type"], ORDER, "text")
    return bodies.select(
        "repo", "doc_type", "part", document_filename(c("doc_type")).alias("filename"), document_title(c("repo"), c("doc_type")).alias("title"),
        control_id(c("repo"), c("doc_type")).alias("control_id"), "body",
    )
