"""Text for a writing service: evidence per repository, requests per section, answers put together again.

Evidence is built as blocks with an order key. Only lists with a fixed limit
are joined into one block; a list without a limit gives one block per item, so
no group is collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.cleanup import clean_text
from codestrata.functions.markdown import first_header
from codestrata.functions.doc_types import with_added
from codestrata.functions.naming import document_title
from codestrata.functions.paths import CATEGORY_NAMES, LANGUAGE_NAMES, file_suffix
from codestrata.operators.ordering import assemble, head_per_group, joined_head
from codestrata.operators.summaries import counted_map, files_by_extension, format_counts
from codestrata.plans.profile import ProfileTables

CHUNK_TOKENS = 50_000
ORDER = ["section", "k1", "k2"]

# The sections of each document type, in order.
SECTIONS = {
    "repository-overview": [
        "What This Repository Does", "At a Glance", "Key Dependencies", "Entry Points and Commands", "Directory Structure",
        "Getting Started",
    ],
    "architecture-guide": [
        "Overview", "Component Architecture", "Key Classes and Functions", "Directory Structure Details", "Data Flow",
        "Design Patterns", "Integration Points",
    ],
    "configuration-guide": ["Environment Variables", "Configuration Files", "Provider Configuration", "Quick Setup"],
    "deployment-runbook": [
        "Prerequisites", "Local Deployment", "Docker Deployment", "Production Deployment", "CI/CD Integration",
        "Rollback Procedures", "Health Checks",
    ],
    "operations-runbook": [
        "Available Commands", "Service Operations", "Troubleshooting", "Log Management", "Performance Monitoring",
        "Maintenance Tasks",
    ],
    "api-reference": ["Endpoints Overview", "Authentication", "Endpoint Details", "Error Handling", "Code Examples"],
    "quality-and-validation": [
        "Test Structure", "Running Tests", "CI/CD Pipeline", "Code Quality Tools", "Coverage Requirements", "Branch Protection",
    ],
    "usage-patterns": ["Basic Usage", "Common Workflows", "Integration Patterns", "Advanced Usage", "Best Practices"],
    "developer-workflows": ["Setup", "Development Workflow", "Code Style", "GitHub Configuration", "Common Tasks"],
    "getting-started": ["Prerequisites", "Installation", "Quick Start", "Next Steps"],
}
DEFAULT_SECTIONS = ["Overview", "Details", "Examples"]

# Lists of the short evidence: title, most items, separator.
SHORT_LISTS = {
    "dependencies": ("Dependencies", 30, ", "),
    "env_variables": ("Environment variables", 40, ", "),
    "scripts": ("Scripts", 15, "; "),
    "api_endpoints": ("API endpoints", 10, ", "),
    "ci_workflows": ("CI/CD workflows", 200, ", "),
    "directories": ("Key directories", 10, "\n"),
}


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def block(df: DataFrame, section: int, body: Column, k1: Column | None = None, k2: Column | None = None) -> DataFrame:
    """Rows of one section of the evidence; ``k1`` and ``k2`` order them within it."""
    return df.select(
        "repo",
        F.lit(section).alias("section"),
        (F.lit("") if k1 is None else k1.cast("string")).alias("k1"),
        (F.lit(0) if k2 is None else k2).cast("int").alias("k2"),
        body.alias("text"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union of tables with the same columns in the same order, paired up so that the plan stays shallow."""
    while len(parts) > 1:
        parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def counted_list(
    df: DataFrame, order: list[str], item: Column, limit: int, title: str, separator: str
) -> DataFrame:
    """``title (n total):`` and the first items, one row per repository that has any."""
    totals = df.groupBy("repo").agg(F.count("*").alias("n"))
    head = joined_head(df, ["repo"], order, item, limit, "items", separator)
    return totals.join(head, "repo").select("repo", text(title, " (", F.col("n"), " total):", separator[-1:] if separator == "\n" else " ", F.col("items")).alias("text"))


def symbol_line(signature: Column) -> Column:
    about = F.when(F.col("docstring") != "", text(" - ", F.col("docstring"))).otherwise("")
    return text("     - ", F.col("name"), signature, about)


def directory_blocks(directories: DataFrame, top_symbols: DataFrame) -> DataFrame:
    """Every directory with its purpose, languages, first described symbols and key files, one block each."""
    keys = ["repo", "dir_key"]

    def listed(kind: str, limit: int, signature: Column, alias: str) -> DataFrame:
        rows = top_symbols.filter(F.col("symbol_type") == kind)
        return joined_head(rows, keys, ["rank"], symbol_line(signature), limit, alias, "\n")

    sig = F.col("signature")
    classes = listed("class", 15, F.when(sig != "", text("(", sig, ")")).otherwise(""), "_classes")
    interfaces = listed("interface", 10, F.lit(""), "_interfaces")
    functions = listed("function", 15, F.when(sig != "", sig).otherwise("()"), "_functions")
    joined = directories.select(*keys, "file_count", "description", "languages", "key_files")
    for part in (classes, interfaces, functions):
        joined = joined.join(part, keys, "left")

    def optional(title: str, column: str) -> Column:
        return F.coalesce(text("\n   ", title, ":\n", F.col(column)), F.lit(""))

    first_keys = F.array_join(F.slice(F.split("key_files", ", "), 1, 5), ", ")
    body = text(
        "## ", F.col("dir_key"), "/ (", F.col("file_count"), " files)\n   Purpose: ", F.col("description"),
        "\n   Languages: ", format_counts(F.col("languages")),
        optional("Classes", "_classes"), optional("Interfaces/Types", "_interfaces"), optional("Functions", "_functions"),
        F.when(F.col("key_files") != "", text("\n   Key files: ", first_keys)).otherwise(""),
    )
    return joined.select("repo", "dir_key", body.alias("text"))


def head_block(features: DataFrame, markers: DataFrame) -> DataFrame:
    """Counts, tools and frameworks of each repository."""
    counts = features.groupBy("repo").agg(
        F.count("*").alias("files"),
        format_counts(counted_map("language", LANGUAGE_NAMES)).alias("languages"),
        format_counts(counted_map("category", CATEGORY_NAMES)).alias("categories"),
    )

    def names(kind: str) -> Column:
        # Sixteen tools and three frameworks exist.
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("marker")))), ", ")

    found = markers.groupBy("repo").agg(names("tool").alias("tools"), names("framework").alias("frameworks"))
    return counts.join(found, "repo", "left").na.fill("", ["tools", "frameworks"])


def workflow_text() -> Column:
    def listed(title: str, column: str) -> Column:
        return F.when(F.size(column) > 0, text("\n   ", title, ": ", F.array_join(column, ", "))).otherwise("")

    return text(
        "## ", F.col("name"), " (", F.col("platform"), ")\n   File: ", F.col("path"),
        listed("Triggers", "triggers"), listed("Jobs", "jobs"), listed("Environments", "environments"), listed("Secrets", "secrets_used"),
    )


USED = [
    "features", "markers", "dependencies", "env_variables", "api_endpoints", "scripts", "codeowners", "hosting_flags", "entry_points",
    "ci_workflows", "dependabot", "issue_templates", "custom_actions", "funding", "symbols", "directories", "top_symbols",
]


def file_text(max_chars: int | None) -> Column:
    """A file with its path: the whole text, or with ``max_chars`` its beginning and how many characters follow."""
    if max_chars is None:
        return text("## ", F.col("path"), "\n```\n", F.col("content"), "\n```")
    rest = F.length("content") - max_chars
    more = F.when(rest > 0, text("\n... and ", rest, " more characters")).otherwise("")
    return text("## ", F.col("path"), "\n```\n", F.substring("content", 1, max_chars), more, "\n```")


def repo_context_blocks(profile: dict[str, DataFrame], max_files: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Blocks of the evidence text of every repository, from the tables of ``plans.profile.profile_tables``.

    All important files come whole, unless ``max_files`` or ``max_chars`` (of each) says otherwise.
    """
    c, profile = F.col, profile.kept().together(*USED) if isinstance(profile, ProfileTables) else profile
    important = profile["important_files"] if max_files is None else profile["important_files"].filter(F.col("rank") <= max_files)
    head = head_block(profile["features"], profile["markers"])
    deps = counted_list(
        profile["dependencies"], ["source_ord", "pos"],
        text(c("name"), F.coalesce(text("==", c("version")), F.lit(""))), 40, "Dependencies", ", ")
    envs = counted_list(
        profile["env_variables"], ["source_ord", "source_file", "pos"],
        text("  ", c("name"), "=", F.coalesce("default_value", F.lit("..."))), 50, "Environment variables", "\n")
    endpoints = counted_list(
        profile["api_endpoints"], ["path", "pos"],
        text("  - ", c("method"), " ", c("endpoint"), " (", c("path"), ")"), 20, "API endpoints", "\n")
    scripts = counted_list(
        profile["scripts"], ["source_ord", "pos"], text("  - ", c("name"), ": ", c("command")), 25, "Scripts/Commands", "\n")
    owners = profile["codeowners"]
    owner_head = joined_head(owners, ["repo"], ["pos"], text("  ", c("rule")), 5, "rules", "\n").join(
        owners.groupBy("repo").agg(F.count("*").alias("n")), "repo")
    more = F.when(c("n") > 5, text("\n  ... and ", c("n") - 5, " more")).otherwise("")
    flags = profile["hosting_flags"]
    flag_lines = F.array_join(F.array_compact(F.array(
        F.when(c("pr_template"), F.lit("PR Template: yes")),
        F.when(F.size("protected_branches") > 0, text("Protected Branches (inferred): ", F.array_join("protected_branches", ", "))),
        F.when(c("release_drafter"), F.lit("Release Drafter: enabled")),
        F.when(c("auto_release"), F.lit("Automated Releases: detected")),
    )), "\n")
    extensions = files_by_extension(profile["features"], file_suffix("path"))
    return union_all([
        block(head, 10, text(
            "# Repository: ", c("repo"), "\n\nTotal files: ", c("files"), "\n\nLanguages: ", c("languages"), "\n\nCategories: ",
            c("categories"), "\n\nTools: ", c("tools"), "\n\nFrameworks: ", c("frameworks"))),
        block(deps, 20, c("text")),
        block(envs, 30, c("text")),
        block(profile["entry_points"], 40, text("  - ", c("name"), ": ", F.coalesce("command", "entry_type")),
              text(c("source_ord"), " ", c("target")), c("pos")),
        block(endpoints, 50, c("text")),
        block(scripts, 60, c("text")),
        block(profile["ci_workflows"], 70, workflow_text(), text(c("platform_ord"), " ", c("path"))),
        block(owner_head, 80, text("CODEOWNERS: ", c("n"), " rules defined\n", c("rules"), more)),
        block(profile["dependabot"], 81, text("Dependabot: enabled for ", F.array_join("ecosystems", ", "))),
        block(profile["issue_templates"], 82, text("Issue Template: ", c("template")), c("path")),
        block(profile["custom_actions"], 83, text("Custom Action: ", c("action")), c("action")),
        block(flags.filter(flag_lines != ""), 84, flag_lines),
        block(profile["funding"], 85, text("Funding: ", c("platform")), None, c("pos")),
        block(directory_blocks(profile["directories"], profile["top_symbols"]), 90, c("text"), c("dir_key")),
        block(extensions, 95, text(c("suffix"), " files (", c("files"), "): ", c("sample")),
              F.lpad((F.lit(10**15) - c("files")).cast("string"), 16, "0"), None).withColumn("k1", F.concat("k1", F.lit(" "), "text")),
        block(important, 99, file_text(max_chars), None, c("rank")),
    ])


def repo_context(profile: dict[str, DataFrame], max_files: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Evidence text per repository, blocks separated by an empty line."""
    return assemble(repo_context_blocks(profile, max_files, max_chars), ["repo"], ORDER, "text", "\n\n")


def condensed_items(profile: dict[str, DataFrame], limits: dict[str, int] | None = None) -> DataFrame:
    """(repo, list, rank, item, left): the first items of each list of the short evidence and how many of the list follow.

    All lists are ranked together and counted together, whatever their number. ``limits`` replaces those of ``SHORT_LISTS``.
    """
    c, none, zero = F.col, F.lit(""), F.lit(0)
    sources = {
        "dependencies": (c("source_ord"), none, c("pos"), c("name")),
        "env_variables": (c("source_ord"), c("source_file"), c("pos"), c("name")),
        "scripts": (c("source_ord"), none, c("pos"), text(c("name"), ": ", c("command"))),
        "api_endpoints": (zero, c("path"), c("pos"), text(c("method"), " ", c("endpoint"))),
        "ci_workflows": (c("platform_ord"), c("path"), zero, text(c("name"), " (", c("platform"), ")")),
        "directories": (zero, c("dir_key"), zero, text("  ", c("dir_key"), ": ", c("description"))),
    }
    items = union_all([
        profile[name].select(
            "repo", F.lit(name).alias("list"), major.cast("int").alias("k1"), middle.alias("k2"), minor.cast("int").alias("k3"), item.alias("item"))
        for name, (major, middle, minor, item) in sources.items()
    ])
    limits = {**{name: limit for name, (_, limit, _) in SHORT_LISTS.items()}, **(limits or {})}
    limit = F.coalesce(*[F.when(c("list") == name, F.lit(n)) for name, n in limits.items()])
    keys = ["repo", "list"]
    totals = items.groupBy(*keys).agg(F.count("*").alias("_all"))
    head = head_per_group(items, keys, ["k1", "k2", "k3", "item"], max(limits.values())).filter(c("rank") <= limit)
    return head.join(totals, keys).select(*keys, "rank", "item", F.greatest(c("_all") - limit, F.lit(0)).alias("left"))


def condensed_context(profile: dict[str, DataFrame], limits: dict[str, int] | None = None) -> DataFrame:
    """Short evidence: every list has a limit and says how many items it leaves out, so a repository is one row of bounded size."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"])
    lists = condensed_items(profile, limits).groupBy("repo", "list").agg(F.struct(ordered.alias("items"), F.first("left").alias("left")).alias("_l"))
    beside = lists.groupBy("repo").agg(*[F.max(F.when(F.col("list") == name, F.col("_l"))).alias(f"_{name}") for name in SHORT_LISTS])

    def optional(name: str) -> Column:
        title, _, separator = SHORT_LISTS[name]
        found = F.col(f"_{name}")
        more = F.when(found["left"] > 0, text(separator, "... and ", found["left"], " more")).otherwise("")
        return F.coalesce(text("\n", title, ":", separator[-1:], F.array_join(found["items"], separator), more), F.lit(""))

    c = F.col
    return head_block(profile["features"], profile["markers"]).join(beside, "repo", "left").select("repo", text(
        "Repository: ", c("repo"), "\nTotal files: ", c("files"), "\nLanguages: ", c("languages"), "\nTools: ", c("tools"),
        "\nFrameworks: ", c("frameworks"), *[optional(name) for name in SHORT_LISTS],
    ).alias("context"))


def route_by_size(sizes: DataFrame, chars: str, limit: int = CHUNK_TOKENS) -> DataFrame:
    """Whether a request goes out whole or section by section, from its number of characters."""
    tokens = F.floor(F.col(chars) / 4).cast("bigint")
    return sizes.withColumn("tokens", tokens).withColumn("route", F.when(tokens > limit, "chunked").otherwise("whole"))


def section_plan(documents: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per section of each (repo, doc_type); types without a plan get three default sections.

    The plan is a constant of the query. ``extra`` adds or replaces types.
    """
    plan = {**with_added(SECTIONS, "sections"), **(extra or {})}
    sections = F.coalesce(
        *[F.when(F.col("doc_type") == name, F.array(*[F.lit(s) for s in names])) for name, names in plan.items()],
        F.array(*[F.lit(s) for s in DEFAULT_SECTIONS]),
    )
    rows = documents.select("repo", "doc_type", F.size(sections).alias("section_total"), F.posexplode(sections).alias("at", "section_name"))
    return rows.select("repo", "doc_type", (F.col("at") + 1).alias("section_ord"), "section_total", "section_name")


def section_requests(documents: DataFrame, contexts: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One request per section with its place, the short evidence and the headings answered so far."""
    plan = section_plan(documents)
    requests = plan.join(contexts, "repo").withColumn("title", document_title(F.col("repo"), F.col("doc_type")))
    if answers is None:
        return requests.withColumn("earlier", F.lit("")).withColumnRenamed("context", "evidence")
    headed = answers.select("repo", "doc_type", F.col("section_ord").alias("_ord"), first_header(F.col("body")).alias("_header"))
    keys = ["repo", "doc_type", "section_ord"]
    # A plan has at most seven sections, so a document is at most seven rows of the window.
    before = Window.partitionBy("repo", "doc_type").orderBy("section_ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = plan.select(*keys).join(headed.withColumnRenamed("_ord", "section_ord"), keys, "left").select(
        *keys, F.array_join(F.collect_list("_header").over(before), ", ").alias("earlier"))
    return requests.join(earlier, keys, "left").na.fill("", ["earlier"]).withColumnRenamed("context", "evidence")


def merge_responses(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """The answer of each planned section, or a note where none came back."""
    keys = ["repo", "doc_type", "section_ord"]
    note = text("## ", F.col("section_name"), "\n\n*No text was produced for this section; it has to be written by hand.*")
    return plan.join(answers.select(*keys, "body"), keys, "left").select(
        *keys, "section_name", F.coalesce("body", note).alias("body"), F.col("body").isNotNull().alias("answered")
    )


def refine_documents(drafts: DataFrame, answers: DataFrame) -> DataFrame:
    """The refined body of each document, or its draft where none came back."""
    keys = ["repo", "doc_type"]
    refined = answers.select(*keys, F.col("body").alias("_refined"))
    return drafts.join(refined, keys, "left").select(
        *keys, F.coalesce(F.when(F.col("_refined") != "", F.col("_refined")), "body").alias("body"),
        (F.coalesce("_refined", F.lit("")) != "").alias("generated"),
    )


def combine_sections(merged: DataFrame) -> DataFrame:
    """Title and sections of each document in order, cleaned. A plan has at most seven sections."""
    keys = ["repo", "doc_type"]
    ordered = F.array_sort(F.collect_list(F.struct("section_ord", "body")))
    joined = merged.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["body"]), "\n\n").alias("_sections"))
    body = text("# ", document_title(F.col("repo"), F.col("doc_type")), "\n\n", F.col("_sections"))
    return joined.select(*keys, clean_text(body).alias("body"))

