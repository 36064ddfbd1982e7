"""Facts as rows: the arrays of ``functions.extract`` exploded, combined and de-duplicated.

Every function takes either a file table with its content or the table of
``file_facts``, which holds the arrays of all extractors. A caller who needs one
list reads only the files that can hold it; a caller who needs many lists runs
``file_facts`` once, writes it, and never reads the text again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import extract as X
from codestrata.functions import paths as P
from codestrata.operators.ordering import first_wins
from codestrata.sources.trees import ignore_dirs, readable_text

JS_LANGUAGES = ["JavaScript", "TypeScript", "TypeScript React", "JavaScript React"]
REQUIREMENTS = ["requirements.txt", "requirements-dev.txt"]
DEPENDENCY_FILES = ["pyproject.toml", *REQUIREMENTS, "package.json"]
ENV_FILES = [".env.example", ".env.sample", ".env.template"]
CI_PATH = r"^(?:\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.yml|Jenkinsfile|\.circleci/config\.yml)$"
WORKFLOW_PATH = r"^\.github/workflows/[^/]+\.ya?ml$"
PLATFORMS = ["github-actions", "gitlab-ci", "jenkins", "circleci"]


def _content() -> Column:
    return F.col("content")


def _path() -> Column:
    return F.col("path")


def _is_python() -> Column:
    return P.language("path") == "Python"


def _is_code() -> Column:
    return P.language("path").isin("Python", *JS_LANGUAGES) & (_content() != "")


def _either(name: str) -> list[str]:
    return [f".github/{name}.yml", f".github/{name}.yaml"]


def _dependencies() -> Column:
    return (
        F.when(_path() == "pyproject.toml", X.deps_pyproject(_content()))
        .when(_path().isin(REQUIREMENTS), X.deps_requirements(_content(), _path()))
        .when(_path() == "package.json", X.deps_package_json(_content()))
    )


def _is_entry_source() -> Column:
    return _path().isin("pyproject.toml", "package.json") | (P.file_name("path") == "__main__.py")


def _entry_points() -> Column:
    return (
        F.when(_path() == "pyproject.toml", X.entry_points_pyproject(_content()))
        .when(_path() == "package.json", X.entry_points_package_json(_content()))
        .when(_is_entry_source(), X.entry_points_dunder_main(_path()))
    )


def _scripts() -> Column:
    return F.when(_path() == "package.json", X.scripts_npm(_content())).when(_path() == "Makefile", X.scripts_make(_content()))


# Each fact: which files can hold it, and its array (or value) for such a file.
FACTS: dict[str, tuple[Callable[[], Column], Callable[[], Column]]] = {
    "dependencies": (lambda: _path().isin(DEPENDENCY_FILES), _dependencies),
    "env_declared": (lambda: _path().isin(ENV_FILES), lambda: X.env_defaults(_content())),
    "env_read": (lambda: _is_python() & _content().contains("os."), lambda: F.array_distinct(X.env_refs_python(_content()))),
    "entry_points": (_is_entry_source, _entry_points),
    "scripts": (lambda: _path().isin("package.json", "Makefile"), _scripts),
    "api_endpoints": (lambda: _is_python() & _content().contains("@"), lambda: X.api_endpoints(_content())),
    "workflow": (lambda: _path().rlike(CI_PATH) & (_content() != ""), lambda: X.ci_workflow(_content(), _path())),
    "owner_rules": (lambda: _path() == ".github/CODEOWNERS", lambda: X.codeowner_rules(_content())),
    "ecosystems": (lambda: _path().isin(_either("dependabot")), lambda: X.dependabot_ecosystems(_content())),
    "platforms": (lambda: _path().isin(_either("FUNDING")), lambda: X.funding_platforms(_content())),
    "label_names": (lambda: _path().isin(_either("labels")), lambda: X.label_names(_content())),
    "branches": (lambda: _path().rlike(WORKFLOW_PATH), lambda: X.protected_branches(_content())),
    "callable": (lambda: _path().rlike(WORKFLOW_PATH), lambda: _content().contains("workflow_call:")),
    "releases": (lambda: _path().rlike(WORKFLOW_PATH), lambda: X.releases_itself(_content(), _path())),
    "classes": (_is_code, lambda: F.when(_is_python(), X.python_classes(_content())).otherwise(X.js_classes(_content()))),
    "functions": (_is_code, lambda: F.when(_is_python(), X.python_functions(_content())).otherwise(X.js_functions(_content()))),
    "interfaces": (lambda: _is_code() & ~_is_python(), lambda: X.js_interfaces(_content())),
    "imports": (_is_code, lambda: F.when(_is_python(), X.python_imports(_content())).otherwise(X.js_imports(_content()))),
}


def file_facts(files: DataFrame) -> DataFrame:
    """All facts of every file that is not ignored, from one pass over the text. Far smaller than the text."""
    read = ignore_dirs(files).select("repo", "path", "size_bytes", readable_text(_content()).alias("content"))
    facts = [F.when(holds(), value()).alias(name) for name, (holds, value) in FACTS.items()]
    return read.select("repo", "path", "size_bytes", F.length("content").alias("chars"), *facts)


def with_facts(files: DataFrame, *names: str) -> DataFrame:
    """The named facts per file, taken from a facts table or from the content of the files that can hold them."""
    if names[0] in files.columns:
        return files.select("repo", "path", *names)
    read = ignore_dirs(files).select("repo", "path", readable_text(_content()).alias("content"))
    wanted = read.filter(P.any_of([FACTS[name][0]() for name in names]))
    return wanted.select("repo", "path", *[F.when(FACTS[n][0](), FACTS[n][1]()).alias(n) for n in names])


def explode_facts(files: DataFrame, name: str) -> DataFrame:
    """One row per struct of a fact."""
    return with_facts(files, name).select("repo", "path", F.inline(name))


# --- lists of a repository ------------------------------------------------------------------------------------------


def dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of the root manifests; ``source_ord`` and ``pos`` give their order."""
    order = F.array_position(F.array(*[F.lit(s) for s in DEPENDENCY_FILES]), F.col("source")).cast("int")
    return explode_facts(files, "dependencies").drop("path").withColumn("source_ord", order)


def env_file_rows(files: DataFrame) -> DataFrame:
    rows = explode_facts(files, "env_declared")
    return rows.select("repo", "name", F.col("path").alias("source_file"), "default_value", "pos")


def env_code_refs(files: DataFrame) -> DataFrame:
    """Every variable name Python files read, once per file."""
    return with_facts(files, "env_read").select(
        "repo", F.col("path").alias("source_file"), F.posexplode("env_read").alias("pos", "name")
    )


def env_refs_new(files: DataFrame) -> DataFrame:
    """Names read in code that no example file declares, first place of use each."""
    known = env_file_rows(files).select("repo", "name").distinct()
    first = first_wins(env_code_refs(files), ["repo", "name"], ["source_file", "pos"])
    return first.join(known, ["repo", "name"], "left_anti")


def env_variables(files: DataFrame) -> DataFrame:
    """Declared variables, then those only read in code at their first place of use, from one read of the facts."""
    none = F.lit(None).cast("string")
    declared = F.transform("env_declared", lambda d: F.struct(
        d["name"].alias("name"), d["default_value"].alias("default_value"), d["pos"].alias("pos"), F.lit(1).alias("source_ord")))
    read = F.transform("env_read", lambda n, i: F.struct(
        n.alias("name"), none.alias("default_value"), i.alias("pos"), F.lit(2).alias("source_ord")))
    both = F.concat(F.coalesce(declared, F.array()), F.coalesce(read, F.array()))
    rows = with_facts(files, "env_declared", "env_read").select("repo", F.col("path").alias("source_file"), F.inline(both))
    place = F.struct("source_file", "default_value", "pos", "source_ord")
    # A name has as many declarations as the three example files of a repository have lines with it.
    named = rows.groupBy("repo", "name").agg(
        F.collect_list(F.when(F.col("source_ord") == 1, place)).alias("declared"), F.min(F.when(F.col("source_ord") == 2, place)).alias("read"),
    )
    kept = F.when(F.size("declared") > 0, F.col("declared")).otherwise(F.array("read"))
    return named.select("repo", "name", F.inline(kept)).withColumn("required", F.lit(True))


def entry_points(files: DataFrame) -> DataFrame:
    """Commands and modules of the manifests and of runnable packages."""
    order = F.when(_path() == "pyproject.toml", 1).when(_path() == "package.json", 2).otherwise(3)
    return explode_facts(files, "entry_points").withColumn("source_ord", order)


def scripts(files: DataFrame) -> DataFrame:
    order = F.when(_path() == "package.json", 1).otherwise(2)
    return explode_facts(files, "scripts").withColumn("source_ord", order).drop("path")


# Words in the name of a script that checks the code, and of one that prepares it.
QUALITY_WORDS = "test|lint|check|validate"
INSTALL_WORDS = "install|setup|prepare"


def quality_commands(rows: DataFrame) -> DataFrame:
    """The scripts that check the code."""
    return rows.filter(F.lower("name").rlike(QUALITY_WORDS))


def install_commands(rows: DataFrame) -> DataFrame:
    """The scripts that prepare the code for use."""
    return rows.filter(F.lower("name").rlike(INSTALL_WORDS))


def runtime_dependencies(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("dev_only"))


def dev_dependencies(rows: DataFrame) -> DataFrame:
    return rows.filter("dev_only")


def api_endpoints(files: DataFrame) -> DataFrame:
    return explode_facts(files, "api_endpoints")


def ci_workflows(files: DataFrame) -> DataFrame:
    """One row per workflow file; ``platform_ord`` and ``path`` give their order."""
    rows = with_facts(files, "workflow").filter(F.col("workflow").isNotNull()).select("repo", "path", "workflow.*")
    order = F.array_position(F.array(*[F.lit(p) for p in PLATFORMS]), F.col("platform")).cast("int")
    return rows.withColumn("platform_ord", order)


# --- hosting settings -----------------------------------------------------------------------------------------------

WORKFLOW_PATH = r"^\.github/workflows/[^/]+\.ya?ml$"


def codeowners(files: DataFrame) -> DataFrame:
    """Ownership rules in file order: the pattern and its owners."""
    rows = with_facts(files, "owner_rules").select("repo", F.posexplode("owner_rules").alias("pos", "rule"))
    words = F.split("rule", r"\s+")
    return rows.select(
        "repo", "pos", "rule", F.get(words, F.lit(0)).alias("pattern"),
        F.array_join(F.slice(words, 2, 1_000_000_000), " ").alias("owners"),
    )


def _preferred(files: DataFrame, name: str) -> DataFrame:
    """A fact from the ``.yml`` file of a name, or from the ``.yaml`` one when a repository has only that."""
    rows = with_facts(files, name).filter(F.col(name).isNotNull())
    return rows.groupBy("repo").agg(F.max_by(name, "path").alias(name))


def dependabot(files: DataFrame) -> DataFrame:
    return _preferred(files, "ecosystems")


def funding(files: DataFrame) -> DataFrame:
    return _preferred(files, "platforms").select("repo", F.posexplode("platforms").alias("pos", "platform"))


def labels(files: DataFrame) -> DataFrame:
    return _preferred(files, "label_names").select("repo", F.posexplode("label_names").alias("pos", "label"))


def issue_templates(files: DataFrame) -> DataFrame:
    inside = _path().rlike(r"^\.github/ISSUE_TEMPLATE/[^/]+\.(?:md|yml|yaml)$")
    chosen = ignore_dirs(files).filter(inside | (_path() == ".github/ISSUE_TEMPLATE.md"))
    return chosen.select("repo", "path", F.when(inside, P.file_stem("path")).otherwise("default").alias("template"))


def custom_actions(files: DataFrame) -> DataFrame:
    """Composite actions by folder and workflows that others can call."""
    folder = F.regexp_extract(_path(), r"^\.github/actions/([^/]+)/action\.ya?ml$", 1)
    composite = ignore_dirs(files).select("repo", folder.alias("action")).filter(F.col("action") != "")
    reusable = with_facts(files, "callable").filter("callable").select(
        "repo", F.concat(F.lit("workflow:"), P.file_stem("path")).alias("action")
    )
    return composite.unionByName(reusable).distinct()


def hosting_flags(files: DataFrame) -> DataFrame:
    """One row per repository with a ``.github`` folder: its yes/no settings and inferred protected branches."""
    paths = ignore_dirs(files).filter(_path().startswith(".github/")).groupBy("repo").agg(
        F.max(_path().isin(".github/PULL_REQUEST_TEMPLATE.md", ".github/pull_request_template.md")).alias("pr_template"),
        F.max(_path().isin(_either("dependabot"))).alias("dependabot_enabled"),
        F.max(_path().isin(_either("release-drafter"))).alias("release_drafter"),
    )
    workflows = with_facts(files, "branches", "releases").filter(F.col("releases").isNotNull()).groupBy("repo").agg(
        F.max("releases").alias("auto_release"),
        # At most 32 different sorted subsets of five fixed names.
        X.distinct_sorted(F.flatten(F.collect_set("branches"))).alias("protected_branches"),
    )
    return paths.join(workflows, "repo", "left").withColumns({
        "auto_release": F.coalesce("auto_release", F.lit(False)),
        "protected_branches": F.coalesce("protected_branches", F.array().cast("array<string>")),
    })


# --- markers --------------------------------------------------------------------------------------------------------


def file_markers(files: DataFrame) -> DataFrame:
    """Tools and frameworks each file gives away, one row per file and marker."""
    path = _path()
    platform = F.when(
        path.rlike(CI_PATH) & (F.col("size_bytes") > 0),
        F.when(path.startswith(".github/"), "github-actions")
        .when(path == ".gitlab-ci.yml", "gitlab-ci")
        .when(path == "Jenkinsfile", "jenkins")
        .otherwise("circleci"),
    )
    hosted = F.when(path.startswith(".github/"), "github")
    tools = F.concat(P.tools("path"), F.array_compact(F.array(hosted, platform)))

    def marked(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("marker")))

    return ignore_dirs(files).select(
        "repo", "path", F.inline(F.concat(marked("tool", tools), marked("framework", P.frameworks("path"))))
    )


def repo_markers(files: DataFrame) -> DataFrame:
    """Distinct tools and frameworks of each repository, with the number of files behind each."""
    return file_markers(files).groupBy("repo", "kind", "marker").agg(F.count("*").alias("files"))


# --- symbols --------------------------------------------------------------------------------------------------------


def code_structure(files: DataFrame) -> DataFrame:
    """Per code file its class, function and interface structs and its imports."""
    return with_facts(files, "classes", "functions", "interfaces", "imports").filter(F.col("classes").isNotNull())


def symbols(files: DataFrame) -> DataFrame:
    """One row per symbol, in file order: classes, functions, interfaces."""
    everything = F.concat("classes", "functions", F.coalesce("interfaces", F.slice("classes", 1, 0)))
    rows = code_structure(files).select("repo", "path", F.posexplode(everything).alias("pos", "s"))
    return rows.select(
        "repo", "path", "pos", "s.name", "s.symbol_type", X.symbol_docstring(F.col("s")).alias("docstring"), "s.signature",
        P.directory_key("path").alias("dir_key"),
    )


def imports(files: DataFrame) -> DataFrame:
    return with_facts(files, "imports").select("repo", "path", F.posexplode("imports").alias("pos", "module"))


def dependency_inventory(files: DataFrame) -> DataFrame:
    """Across repositories: where each dependency is used and in how many versions.

    One row per repository, name and version first, so a name used everywhere
    meets the final step already counted by each task.
    """
    used = dependencies(files).groupBy("name", "repo", "version").agg(
        F.max(~F.col("dev_only")).alias("runtime"), F.max("dev_only").alias("dev")
    )
    return used.groupBy("name").agg(
        F.count_distinct("repo").alias("repos"), F.count_distinct(F.when(F.col("runtime"), F.col("repo"))).alias("runtime_repos"),
        F.count_distinct(F.when(F.col("dev"), F.col("repo"))).alias("dev_repos"), F.count_distinct("version").alias("versions"),
    )
