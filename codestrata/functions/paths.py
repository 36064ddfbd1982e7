"""What a repository-relative path tells about a file: column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix to language.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript React",
    ".jsx": "JavaScript React", ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".rb": "Ruby",
    ".php": "PHP", ".sh": "Shell", ".md": "Markdown", ".yml": "YAML", ".yaml": "YAML", ".json": "JSON",
    ".toml": "TOML",
}

# All languages and categories a file can get.
LANGUAGE_NAMES = sorted({*LANGUAGES.values(), "Other"})
CATEGORY_NAMES = ["application", "automation", "documentation", "examples", "infrastructure", "misc", "tests"]

# Suffixes of prose.
DOC_SUFFIXES = [".md", ".mdx", ".rst", ".adoc"]

# File names where a program starts.
ENTRY_NAMES = [
    "main.py", "app.py", "__main__.py", "cli.py", "server.py", "index.js", "index.ts", "main.js", "main.ts",
    "app.js", "app.ts", "main.go", "main.rs", "main.java",
]

# File names that explain a repository.
IMPORTANT_NAMES = [
    "readme.md", "readme.rst", "readme.txt", "readme", "pyproject.toml", "setup.py", "setup.cfg", "package.json",
    "cargo.toml", "go.mod", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "makefile", ".env.example",
    ".env.sample", "requirements.txt", "requirements-dev.txt", "main.py", "app.py", "index.js", "index.ts",
    "main.go", "main.rs",
]

# Folders of application code.
APPLICATION_FOLDERS = [
    "src", "app", "lib", "pages", "components", "hooks", "utils", "services", "server", "client",
]

# Configuration file name to its format.
CONFIG_FORMATS = {
    ".env.example": "env", ".env.sample": "env", "config.yaml": "yaml", "config.yml": "yaml", "config.json": "json",
    "settings.json": "json", "tsconfig.json": "json", ".eslintrc.json": "json", "pyproject.toml": "toml",
    "setup.cfg": "ini",
}

# The first text found in a configuration file name gives its purpose.
CONFIG_PURPOSES = [
    (".env", "Environment variables"), ("config", "Application configuration"),
    ("tsconfig", "TypeScript compiler options"), (".eslintrc", "ESLint rules"),
    ("pyproject", "Python project metadata and dependencies"), ("setup.cfg", "Python package configuration"),
]

# The first text found in a directory key gives its purpose.
DIRECTORY_PURPOSES = [
    ("test", "Test files"), ("spec", "Test specifications"), ("src", "Source code"), ("lib", "Library code"),
    ("app", "Application code"), ("api", "API endpoints"), ("models", "Data models"), ("views", "View components"),
    ("components", "UI components"), ("hooks", "React hooks"), ("utils", "Utility functions"),
    ("helpers", "Helper functions"), ("services", "Service layer"), ("controllers", "Controllers"),
    ("routes", "Route definitions"), ("middleware", "Middleware"), ("config", "Configuration"),
    ("scripts", "Build/automation scripts"), ("docs", "Documentation"), ("examples", "Example code"),
    ("tools", "Tool implementations"), ("nodes", "Node components"), ("agents", "Agent implementations"),
    ("connections", "Connection handlers"), ("prompts", "Prompt templates"), ("memory", "Memory/storage"),
    ("retrievers", "RAG retrievers"),
]


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def segments(path: str | Column) -> Column:
    return F.split(_col(path), "/")


def file_name(path: str | Column) -> Column:
    return F.substring_index(_col(path), "/", -1)


def file_suffix(path: str | Column) -> Column:
    """Last ``.x`` of the name, or empty; a leading dot alone starts no suffix."""
    return F.regexp_extract(file_name(path), r"^.+([.][^.]+)$", 1)


def file_stem(path: str | Column) -> Column:
    return F.regexp_extract(file_name(path), r"^(.+?)(?:[.][^.]+)?$", 1)


def depth(path: str | Column) -> Column:
    return F.size(segments(path))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value for ``key`` in a small fixed table, or null. Spark folds the table into a constant of the plan."""
    text = "\n".join(f"{k}\t{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit("\n"), F.lit("\t")), key)


def first_hit(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Result of the first rule whose key occurs in ``text``, or null."""
    hits = [F.when(text.contains(key), F.lit(result)) for key, result in rules]
    return F.coalesce(*hits)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def language(path: str | Column) -> Column:
    return F.coalesce(lookup(LANGUAGES, F.lower(file_suffix(path))), F.lit("Other"))


def is_doc(path: str | Column) -> Column:
    return F.lower(file_suffix(path)).isin(DOC_SUFFIXES)


def under(path: str | Column, names: list[str]) -> Column:
    """Whether a segment of the path, the file name included, is one of ``names``."""
    words = "|".join(name.replace(".", "[.]") for name in names)
    return _col(path).rlike(f"(?:^|/)(?:{words})(?:/|$)")


def category(path: str | Column) -> Column:
    """First matching group of the seven; the file name counts as a segment."""
    low = F.lower(_col(path))
    doc_suffix = "|".join(suffix[1:] for suffix in DOC_SUFFIXES)
    return (
        F.when(under(low, ["docs"]) | low.rlike(f"[^/][.](?:{doc_suffix})$"), "documentation")
        .when(under(low, ["test", "tests"]) | low.rlike("(?:^|/)test_[^/]*$"), "tests")
        .when(under(low, ["scripts"]) | low.endswith(".sh"), "automation")
        .when(under(low, ["infra", ".github"]) | low.rlike("docker[^/]*$"), "infrastructure")
        .when(under(low, APPLICATION_FOLDERS), "application")
        .when(under(low, ["examples"]), "examples")
        .otherwise("misc")
    )


def doc_signal(path: str | Column, group: Column) -> Column:
    name = F.lower(file_name(path))
    return (
        F.when(group == "infrastructure", "operational")
        .when(group == "application", "architecture")
        .when(group == "tests", "quality")
        .when(name.contains("api") | name.contains("schema"), "interface")
        .when(group == "automation", "workflow")
        .otherwise("overview")
    )


def is_entry_point(path: str | Column) -> Column:
    return F.lower(file_name(path)).isin(ENTRY_NAMES)


def importance_tenths(path: str | Column, group: Column, entry: Column) -> Column:
    """Importance in whole tenths, so that comparisons never meet a rounded fraction."""

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    return F.least(
        F.lit(10),
        points(entry, 4)
        + points(F.lower(file_name(path)).isin(IMPORTANT_NAMES), 3)
        + points(group == "application", 2)
        + points(group.isin("infrastructure", "automation"), 1)
        + points(depth(path) <= 2, 1),
    )


def directory_key(path: str | Column) -> Column:
    """First two folders of a deep path, the folder of a shallow one, else ``root``."""
    parts = segments(path)
    return (
        F.when(F.size(parts) > 2, F.concat_ws("/", F.slice(parts, 1, 2)))
        .when(F.size(parts) == 2, F.get(parts, F.lit(0)))
        .otherwise("root")
    )


def parent_folder(path: str | Column) -> Column:
    """Folder part of a path, ``.`` at the top."""
    parts = segments(path)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(".")


def config_format(path: str | Column) -> Column:
    return lookup(CONFIG_FORMATS, F.lower(file_name(path)))


def config_purpose(path: str | Column) -> Column:
    return F.coalesce(first_hit(F.lower(file_name(path)), CONFIG_PURPOSES), F.lit("Configuration"))


def directory_purpose(key: Column, majority_category: Column) -> Column:
    from_files = F.concat(
        F.upper(F.substring(majority_category, 1, 1)), F.substring(majority_category, 2, 1000), F.lit(" files")
    )
    return F.coalesce(first_hit(F.lower(key), DIRECTORY_PURPOSES), from_files, F.lit("General files"))


def tools(path: str | Column) -> Column:
    """Build and infrastructure tools a file gives away, at most one entry per tool."""
    name, whole, suffix = F.lower(file_name(path)), F.lower(_col(path)), F.lower(file_suffix(path))
    rules = [
        (name == "pyproject.toml", "setuptools/pyproject"),
        (name == "package.json", "npm"),
        (name == "cargo.toml", "cargo"),
        (name == "dockerfile", "docker"),
        (name == "makefile", "make"),
        (suffix == ".tf", "terraform"),
        (name.isin("playbook.yml", "playbook.yaml", "site.yml", "ansible.cfg"), "ansible"),
        (name.isin("chart.yaml", "chart.yml"), "helm"),
        (name.isin("kustomization.yaml", "kustomization.yml"), "kustomize"),
        (name.isin("pulumi.yaml", "pulumi.yml"), "pulumi"),
        (whole.contains("cloudformation") | name.endswith(".template"), "cloudformation"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(tool)) for rule, tool in rules]))


def frameworks(path: str | Column) -> Column:
    whole, suffix = F.lower(_col(path)), F.lower(file_suffix(path))
    rules = [
        (whole.contains("fastapi"), "FastAPI"),
        (whole.contains("django"), "Django"),
        (whole.contains("react") | suffix.isin(".tsx", ".jsx"), "React"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


# Tools, file names and texts that mark infrastructure code.
INFRA_TOOLS = ["terraform", "ansible", "pulumi", "cloudformation", "helm", "kustomize"]
INFRA_SUFFIXES = [".tf", ".tfvars", ".hcl", ".yaml", ".yml", ".j2", ".jinja2"]
TERRAFORM_NAMES = ["main.tf", "variables.tf", "outputs.tf", "providers.tf", "backend.tf"]
ANSIBLE_NAMES = ["playbook.yml", "playbook.yaml", "site.yml", "site.yaml"]
HELM_NAMES = ["chart.yaml", "values.yaml"]
KUSTOMIZE_NAMES = ["kustomization.yaml", "kustomization.yml"]
INFRA_WORDS = ["terraform", "infra", "infrastructure", "iac", "modules"]
DEPLOY_WORDS = ["deploy", "dockerfile", "kubernetes", "k8s", "helm"]


def infra_halves(path: str | Column) -> Column:
    """Infrastructure evidence of one file, in half points."""
    name, whole, suffix = F.lower(file_name(path)), F.lower(_col(path)), F.lower(file_suffix(path))

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    marked = F.array_intersect(tools(path), F.array(*[F.lit(tool) for tool in INFRA_TOOLS]))
    return (
        F.size(marked) * 4
        + points(suffix.isin(INFRA_SUFFIXES), 1)
        + points(name.endswith(".tf"), 4)
        + points(name.isin(TERRAFORM_NAMES), 6)
        + points(name.isin(ANSIBLE_NAMES), 6)
        + points(name.isin(HELM_NAMES), 6)
        + points(name.isin(KUSTOMIZE_NAMES), 6)
        + points(whole.contains("cloudformation"), 4)
        + points(any_of([whole.contains(word) for word in INFRA_WORDS]), 2)
    )


def has_deploy_word(path: str | Column) -> Column:
    whole = F.lower(_col(path))
    return any_of([whole.contains(word) for word in DEPLOY_WORDS])
