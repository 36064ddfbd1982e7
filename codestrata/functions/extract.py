"""Facts in manifests, workflow files and source code: one array of structs per file.

Each function takes the content (and the path where it matters) and returns an
array column. Nothing is exploded or shuffled here; ``operators.facts`` turns
the arrays into rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions import yaml as Y
from codestrata.functions.naming import humanize_symbol, simplify_params, strip, strip_quotes
from codestrata.functions.paths import file_stem, segments

COMMENT_END = "\u0001"


# --- shared helpers -------------------------------------------------------------------------------------------------


def matches(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def blocks(text: Column, line_start: str) -> Column:
    """Cuts a manifest in front of every line that begins with ``line_start``.

    Each block carries its own header line, so the key a line belongs to is
    known without a running state over lines.
    """
    return F.split(text, rf"\n(?={line_start})", -1)


def block_lines(block: Column) -> Column:
    """Lines of a block after its header."""
    return F.slice(lines_of(block), 2, 1_000_000_000)


def nothing() -> Column:
    return F.array().cast("array<string>")


# --- dependencies ---------------------------------------------------------------------------------------------------


def _dependency(name: Column, version: Column, dev: Column, source: str, pos: Column) -> Column:
    return F.struct(
        name.alias("name"), version.alias("version"), dev.alias("dev_only"), F.lit(source).alias("source"), pos.alias("pos")
    )


# A list as far as its closing bracket: brackets in quotes and in comments do not close it.
TOML_LIST = r"""=[ \t]*\[((?:[^\]"'#]|"[^"\n]*+"|'[^'\n]*+'|#[^\n]*+)*+)"""
TOML_ITEM = r"""#[^\n]*+|"([^"\n]*+)"|'([^'\n]*+)'"""


def toml_list(text: Column) -> Column:
    """The quoted items of the list that the first line of ``text`` opens, on whichever lines they stand."""
    inside = F.regexp_extract(text, TOML_LIST, 1)
    items = F.filter(matches(inside, TOML_ITEM), lambda x: ~x.startswith("#"))
    return F.transform(items, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def deps_pyproject(content: Column) -> Column:
    """Names under the dependency tables and lists of a pyproject file; a list ends at the bracket that closes it."""
    apart = r"""(?![ \t]*["'#])[^\n]*"""
    header = (
        rf"[ \t]*[\[\]]|[ \t]*dependencies = \[|{apart}\[tool\.poetry\.group\.dev"
        rf"|{apart}(?i:dev)[^\n]*(?i:dependencies)|{apart}(?i:dependencies)[^\n]*(?i:dev)"
    )

    def names(block: Column) -> Column:
        head = strip(first_line(block))
        low = F.lower(head)
        runtime = head.isin("[project.dependencies]", "[tool.poetry.dependencies]") | head.startswith("dependencies = [")
        dev = head.contains("[tool.poetry.group.dev") | (low.contains("dev") & low.contains("dependencies"))
        entries = F.filter(
            F.transform(block_lines(block), lambda x: strip(x)),
            lambda x: ~x.startswith("#") & (x.contains("=") | x.startswith('"')),
        )
        items = F.when(head.rlike(r"^[^\[]*=[ \t]*\["), toml_list(block)).otherwise(entries)
        found = F.transform(
            items,
            lambda x: F.struct(
                F.regexp_extract(x, r"""^\s*["']?([A-Za-z0-9][A-Za-z0-9._-]*)""", 1).alias("name"), (~runtime & dev).alias("dev")
            ),
        )
        kept = F.filter(found, lambda f: ~f["name"].isin("", "python"))
        return F.when(runtime | dev, kept).otherwise(F.slice(kept, 1, 0))

    flat = F.flatten(F.transform(blocks(content, header), names))
    return F.transform(
        flat, lambda f, i: _dependency(f["name"], F.lit(None).cast("string"), f["dev"], "pyproject.toml", i)
    )


def deps_requirements(content: Column, path: Column) -> Column:
    """Names in a requirements file: up to a version mark or an extras bracket."""
    kept = F.filter(
        F.transform(lines_of(content), lambda x: strip(x)),
        lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"),
    )
    names = F.filter(F.transform(kept, lambda x: strip(F.regexp_extract(x, r"^([^>=<\[!]*)", 1))), lambda n: n != "")
    return F.transform(
        names,
        lambda n, i: F.struct(
            n.alias("name"), F.lit(None).cast("string").alias("version"), path.contains("dev").alias("dev_only"),
            path.alias("source"), i.alias("pos"),
        ),
    )


def json_map(content: Column, key: str) -> Column:
    """Entries of a top-level object of a JSON file; none when the file or the value has another form."""
    parsed = F.from_json(content, f"`{key}` map<string,string>")
    return F.coalesce(F.map_entries(parsed[key]), F.array().cast("array<struct<key:string,value:string>>"))


def deps_package_json(content: Column) -> Column:
    """Runtime, then development dependencies with their versions."""

    def entries(key: str, dev: bool) -> Column:
        first = F.size(json_map(content, "dependencies")) if dev else F.lit(0)
        return F.transform(
            json_map(content, key), lambda e, i: _dependency(e["key"], e["value"], F.lit(dev), "package.json", i + first)
        )

    return F.concat(entries("dependencies", False), entries("devDependencies", True))


# --- environment variables ------------------------------------------------------------------------------------------


def env_defaults(content: Column) -> Column:
    """KEY=default lines of an example environment file; an empty default is null."""
    kept = F.filter(
        F.transform(lines_of(content), lambda x: strip(x)), lambda x: ~x.startswith("#") & x.contains("=")
    )

    def entry(x: Column, i: Column) -> Column:
        default = strip(F.regexp_extract(x, r"^[^=]*=(.*)$", 1))
        return F.struct(
            strip(F.substring_index(x, "=", 1)).alias("name"),
            F.when(default != "", default).alias("default_value"),
            i.alias("pos"),
        )

    return F.transform(kept, entry)


# How Python code asks for an environment variable.
ENV_CALLS = [
    r"""os\.getenv\(["']([A-Z][A-Z0-9_]{2,})["']""",
    r"""os\.environ\[["']([A-Z][A-Z0-9_]{2,})["']\]""",
    r"""os\.environ\.get\(["']([A-Z][A-Z0-9_]{2,})["']""",
]


def env_refs_python(content: Column) -> Column:
    """Names of environment variables read on lines that are not comments, in order."""
    code = F.filter(lines_of(content), lambda x: x.contains("os.") & ~strip(x).startswith("#"))
    return F.flatten(F.transform(code, lambda x: F.concat(*[matches(x, rx, 1) for rx in ENV_CALLS])))


# --- entry points and scripts ---------------------------------------------------------------------------------------


def _entry(name: Column, path: Column, kind: str, command: Column, description: Column, pos: Column) -> Column:
    return F.struct(
        name.alias("name"), path.alias("target"), F.lit(kind).alias("entry_type"), command.alias("command"),
        description.alias("description"), pos.alias("pos"),
    )


def entry_points_pyproject(content: Column) -> Column:
    """Commands under the first run of script tables of a pyproject file."""
    parts = blocks(content, r"[ \t]*\[|[^\n]*\[(?:project|tool\.poetry)\.scripts\]")
    opens = F.transform(
        parts,
        lambda b: first_line(b).contains("[project.scripts]") | first_line(b).contains("[tool.poetry.scripts]"),
    )
    bound = F.array(F.struct(parts.alias("parts"), opens.alias("opens")))

    def first_run(s: Column) -> Column:
        start = F.array_position(s["opens"], True).cast("int")
        tail = F.slice(s["opens"], F.greatest(start, F.lit(1)), F.lit(1_000_000_000))
        stop = F.array_position(tail, False).cast("int")
        length = F.when(start == 0, 0).when(stop == 0, 1_000_000_000).otherwise(stop - 1)
        return F.slice(s["parts"], F.greatest(start, F.lit(1)), length)

    entries = F.filter(
        F.flatten(F.transform(F.flatten(F.transform(bound, first_run)), block_lines)),
        lambda x: x.contains("=") & ~strip(x).startswith("#"),
    )

    def entry(x: Column, i: Column) -> Column:
        name = strip_quotes(strip(F.substring_index(x, "=", 1)))
        target = strip_quotes(strip(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)))
        return _entry(name, F.lit("pyproject.toml"), "cli", name, F.concat(F.lit("CLI entry: "), target), i)

    return F.filter(F.transform(entries, entry), lambda e: e["name"] != "")


def entry_points_package_json(content: Column) -> Column:
    """The main module, then the commands of the bin object."""
    main = F.from_json(content, "main string")["main"]
    module = F.array_compact(F.array(F.when(main.isNotNull(), _entry(
        F.lit("main"), main, "module", F.lit(None).cast("string"), F.concat(F.lit("Main entry: "), main), F.lit(0)
    ))))
    commands = F.transform(
        json_map(content, "bin"), lambda e, i: _entry(e["key"], e["value"], "cli", e["key"], F.lit(""), i + 1)
    )
    return F.concat(module, commands)


def entry_points_dunder_main(path: Column) -> Column:
    """A package that can be run: the folder of a ``__main__.py``."""
    parts = segments(path)
    module = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise("")
    return F.array(_entry(module, path, "module", F.concat(F.lit("python -m "), module), F.lit(""), F.lit(0)))


def scripts_npm(content: Column) -> Column:
    return F.transform(
        json_map(content, "scripts"),
        lambda e, i: F.struct(
            e["key"].alias("name"), e["value"].alias("command"), F.lit("package.json").alias("source"), i.alias("pos")
        ),
    )


def scripts_make(content: Column) -> Column:
    return F.transform(
        matches(content, r"(?m)^([a-zA-Z_][a-zA-Z0-9_-]*):", 1),
        lambda t, i: F.struct(
            t.alias("name"), F.concat(F.lit("make "), t).alias("command"), F.lit("Makefile").alias("source"), i.alias("pos")
        ),
    )


# --- endpoints ------------------------------------------------------------------------------------------------------

# Route decorators.
ROUTE_CALLS = [
    r"""(?i)@app\.(get|post|put|delete|patch)\(["']([^"']+)["']""",
    r"""(?i)@router\.(get|post|put|delete|patch)\(["']([^"']+)["']""",
]
ROUTE_LIST = r"""@app\.route\(["']([^"']+)["'][^\n]*methods=\[([^\]]+)\]"""


def api_endpoints(content: Column) -> Column:
    """Verb decorators first, then one entry per method of a route with a method list."""

    def decorated(rx: str) -> Column:
        return F.transform(
            matches(content, rx),
            lambda m: F.struct(
                F.upper(F.regexp_extract(m, rx, 1)).alias("method"), F.regexp_extract(m, rx, 2).alias("endpoint")
            ),
        )

    verbs = [decorated(rx) for rx in ROUTE_CALLS]
    routes = F.flatten(
        F.transform(
            matches(content, ROUTE_LIST),
            lambda m: F.transform(
                matches(F.regexp_extract(m, ROUTE_LIST, 2), r"""["'](\w+)["']""", 1),
                lambda method: F.struct(F.upper(method).alias("method"), F.regexp_extract(m, ROUTE_LIST, 1).alias("endpoint")),
            ),
        )
    )
    return F.transform(
        F.concat(*verbs, routes), lambda e, i: F.struct(e["method"].alias("method"), e["endpoint"].alias("endpoint"), i.alias("pos"))
    )


# --- continuous integration -----------------------------------------------------------------------------------------

TOP_KEY = r"(?m)^([a-zA-Z_][a-zA-Z0-9_-]*):"
INDENTED_KEY = r"(?m)^  ([a-zA-Z_][a-zA-Z0-9_-]*):"

# Top-level keys of a GitLab file that are not jobs.
GITLAB_RESERVED = [
    "stages", "variables", "include", "default", "workflow", "image", "services", "before_script", "after_script", "cache",
]


def _workflow(name: Column, platform: str, triggers: Column, jobs: Column, environments: Column, secrets: Column) -> Column:
    return F.struct(
        name.alias("name"), F.lit(platform).alias("platform"), triggers.alias("triggers"), jobs.alias("jobs"),
        distinct_sorted(environments).alias("environments"), distinct_sorted(secrets).alias("secrets_used"),
    )


def _job_environments(jobs: Column) -> Column:
    """The environment of each job that has one, given as a name or as a map with a name, in block or flow form."""

    def of_json(job: Column) -> Column:
        given = Y.json_map(job)["environment"]
        return F.when(given.startswith("{"), Y.json_map(given)["name"]).otherwise(given)

    def of_block(block: Column) -> Column:
        text = Y.value(block)
        inner = Y.value(Y.child(Y.entries(block), "name"))
        return F.when(text.startswith("{"), Y.flow_map(text)["name"]).when(block.contains("\n"), Y.scalar(inner)).otherwise(Y.scalar(text))

    def of_job(job: Column) -> Column:
        text = Y.value(job)
        return F.when(text.startswith("{"), of_json(Y.flow_json(text))).otherwise(of_block(Y.child(Y.entries(job), "environment")))

    text = Y.value(jobs)
    found = F.when(text.startswith("{"), F.transform(F.map_values(Y.flow_map(text)), of_json)).otherwise(F.transform(Y.entries(jobs), of_job))
    return F.filter(F.array_compact(found), lambda name: name != "")


def github_workflow(content: Column, path: Column) -> Column:
    """Name, triggers, jobs, environments and secrets of a GitHub workflow of any indent, in block and flow form."""
    bound = F.array(Y.top_entries(content))

    def read(blocks: Column) -> Column:
        named, on, jobs = (Y.child(blocks, name) for name in ("name", "on", "jobs"))
        title = Y.scalar(Y.value(named))
        return _workflow(
            F.when(title != "", title).otherwise(file_stem(path)),
            "github-actions",
            F.coalesce(F.filter(Y.names(on), lambda name: name != ""), nothing()),
            F.coalesce(F.filter(Y.names(jobs), lambda name: name != ""), nothing()),
            F.coalesce(_job_environments(jobs), nothing()),
            matches(content, r"\$\{\{\s*secrets\.([A-Z_][A-Z0-9_]*)\s*\}\}", 1),
        )

    return F.get(F.transform(bound, read), F.lit(0))


def gitlab_workflow(content: Column) -> Column:
    # Possessive repeats keep Java's matcher iterative on long blocks; nothing follows, so the match is the same.
    stages = F.regexp_extract(content, r"(?m)^stages:\s*\n((?:\s+-\s*.+\n)*+)", 1)
    return _workflow(
        F.lit("GitLab CI"),
        "gitlab-ci",
        matches(stages, r"-\s*(\w+)", 1),
        F.filter(matches(content, TOP_KEY, 1), lambda k: ~k.isin(GITLAB_RESERVED)),
        matches(content, r"""environment:\s*(?:name:\s*)?["']?(\w+)""", 1),
        matches(content, r"\$([A-Z_]{3,})", 1),
    )


def jenkins_workflow(content: Column) -> Column:
    return _workflow(
        F.lit("Jenkins Pipeline"),
        "jenkins",
        nothing(),
        matches(content, r"""stage\s*\(\s*['"]([^'"]+)['"]""", 1),
        matches(content, r"(?s)environment\s*\{\s*\n.*?(\w+)\s*=", 1),
        matches(content, r"""credentials\s*\(\s*['"]([^'"]+)['"]""", 1),
    )


def circleci_workflow(content: Column) -> Column:
    job_block = F.regexp_extract(content, r"(?m)^jobs:\s*\n((?:\s+.+\n)*+)", 1)
    return _workflow(
        F.lit("CircleCI"), "circleci", matches(content, INDENTED_KEY, 1), matches(job_block, INDENTED_KEY, 1), nothing(), nothing()
    )


def ci_workflow(content: Column, path: Column) -> Column:
    """The workflow a file defines, or null."""
    return F.when(
        content != "",
        F.when(path.rlike(r"^\.github/workflows/[^/]+\.ya?ml$"), github_workflow(content, path))
        .when(path == ".gitlab-ci.yml", gitlab_workflow(content))
        .when(path == "Jenkinsfile", jenkins_workflow(content))
        .when(path == ".circleci/config.yml", circleci_workflow(content)),
    )


# --- hosting settings -----------------------------------------------------------------------------------------------

# Branches that are usually protected.
PROTECTED_BRANCHES = ["main", "master", "develop", "release/*", "production"]


def codeowner_rules(content: Column) -> Column:
    return F.filter(
        F.transform(lines_of(content), lambda x: strip(x)), lambda x: (x != "") & ~x.startswith("#")
    )


def dependabot_ecosystems(content: Column) -> Column:
    return distinct_sorted(matches(content, r"""package-ecosystem:\s*["']?([a-z-]+)""", 1))


def funding_platforms(content: Column) -> Column:
    return F.filter(matches(content, r"(?m)^([a-z_]+):", 1), lambda k: k != "custom")


def label_names(content: Column) -> Column:
    return matches(content, r"""name:\s*["']?([^"'\n]+)""", 1)


def protected_branches(content: Column) -> Column:
    lists = matches(content, r"branches:\s*\[([^\]]+)\]", 1)
    names = F.flatten(
        F.transform(lists, lambda b: F.transform(F.split(b, ","), lambda n: strip_quotes(strip(n))))
    )
    return distinct_sorted(F.filter(names, lambda n: n.isin(PROTECTED_BRANCHES)))


def releases_itself(content: Column, path: Column) -> Column:
    return (
        F.lower(file_stem(path)).contains("release")
        | content.contains("semantic-release")
        | content.contains("release-please")
    )


# --- symbols --------------------------------------------------------------------------------------------------------

_PY_DOC = r"""(?:\s*\n\s*(?:\"\"\"([^"]*?)\"\"\"|'''([^']*?)'''))?"""
PYTHON_CLASS = r"(?m)^class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:\(([^)]*)\))?\s*:" + _PY_DOC
PYTHON_FUNCTION = r"(?m)^def\s+([a-z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)\s*(?:->.*?)?\s*:" + _PY_DOC
PYTHON_IMPORT = r"(?m)^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"

_EXPORT = r"(?:export\s+(?:default\s+)?)?"
JS_CLASS = _EXPORT + r"class\s+([A-Z][a-zA-Z0-9_]*)(?:\s+extends\s+([A-Z][a-zA-Z0-9_]*))?"
JS_FUNCTION = (
    _EXPORT + r"(?:async\s+)?(?:function\s+([a-z][a-zA-Z0-9_]*)"
    r"|(?:const|let|var)\s+([a-z][a-zA-Z0-9_]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>)"
)
JS_INTERFACE = r"(?:export\s+)?(?:interface|type)\s+([A-Z][a-zA-Z0-9_]*)"
JS_IMPORT = r"""import\s+.*?from\s+['"]([^"']+)['"]"""
# A doc comment with nothing but space and export words between it and the definition that follows.
_JS_DOC = rf"(?:/\*\*([^{COMMENT_END}]*){COMMENT_END}\s*(?:(?:export\s+default|export|async)\s+)?)?"


def _symbol(name: Column, kind: str, doc: Column, bases: Column, signature: Column) -> Column:
    return F.struct(
        name.alias("name"), F.lit(kind).alias("symbol_type"), doc.alias("doc"), bases.alias("bases"), signature.alias("signature")
    )


def symbol_docstring(symbol: Column) -> Column:
    """First line of the written description, else what the name tells."""
    inferred = humanize_symbol(symbol["name"], symbol["symbol_type"], symbol["bases"])
    return F.when(symbol["doc"] != "", symbol["doc"]).otherwise(inferred)


def _python_doc(match: Column, regex: str) -> Column:
    text = F.concat(F.regexp_extract(match, regex, 3), F.regexp_extract(match, regex, 4))
    return strip(first_line(strip(text)))


def python_classes(content: Column) -> Column:
    def one(m: Column) -> Column:
        name, bases = F.regexp_extract(m, PYTHON_CLASS, 1), F.regexp_extract(m, PYTHON_CLASS, 2)
        return _symbol(name, "class", _python_doc(m, PYTHON_CLASS), bases, bases)

    return F.transform(matches(content, PYTHON_CLASS), one)


def python_functions(content: Column) -> Column:
    def one(m: Column) -> Column:
        name, params = F.regexp_extract(m, PYTHON_FUNCTION, 1), F.regexp_extract(m, PYTHON_FUNCTION, 2)
        return _symbol(name, "function", _python_doc(m, PYTHON_FUNCTION), F.lit(""), simplify_params(params))

    return F.transform(matches(content, PYTHON_FUNCTION), one)


def python_imports(content: Column) -> Column:
    """Base modules in the order of their first use; a relative import has an empty base."""
    modules = F.transform(
        matches(content, PYTHON_IMPORT),
        lambda m: F.concat(F.regexp_extract(m, PYTHON_IMPORT, 1), F.regexp_extract(m, PYTHON_IMPORT, 2)),
    )
    return F.array_distinct(
        F.transform(F.filter(modules, lambda m: ~m.startswith("_")), lambda m: F.substring_index(m, ".", 1))
    )


def js_imports(content: Column) -> Column:
    modules = F.transform(
        matches(content, JS_IMPORT, 1), lambda m: F.ltrim(F.substring_index(m, "/", 1), F.lit("@"))
    )
    return F.array_distinct(F.filter(modules, lambda m: m != ""))


def js_doc(comment: Column) -> Column:
    """First line of a doc comment that says something: not empty and no tag."""
    lines = F.transform(
        lines_of(strip(comment)), lambda x: strip(F.ltrim(strip(x), F.lit("*")))
    )
    said = F.filter(lines, lambda x: (x != "") & ~x.startswith("@"))
    return F.coalesce(F.get(said, F.lit(0)), F.lit(""))


def _js_definitions(content: Column, definition: str) -> tuple[Column, str]:
    """Matches of a definition, each with the doc comment directly before it, and the regex with its groups.

    Comment ends become one character first, so a comment cannot run into the
    next one. Definitions quoted in a comment count as well and come before it.
    """
    regex = _JS_DOC + definition
    marked = F.replace(content, F.lit("*/"), F.lit(COMMENT_END))

    def with_quoted(m: Column) -> Column:
        return F.concat(matches(F.regexp_extract(m, regex, 1), definition), F.array(m))

    return F.flatten(F.transform(matches(marked, regex), with_quoted)), regex


def _first_of_name(symbols: Column) -> Column:
    """Keeps the first symbol of each name: sorted by name and place, a name's first place stands after another name."""
    places = F.array_sort(F.transform(symbols, lambda s, i: F.struct(s["name"].alias("name"), i.alias("at"))))
    bound = F.array(F.struct(symbols.alias("all"), places.alias("places")))

    def firsts(b: Column) -> Column:
        new = F.filter(b["places"], lambda p, i: ~F.get(b["places"], i - 1)["name"].eqNullSafe(p["name"]))
        return F.transform(F.array_sort(F.transform(new, lambda p: p["at"])), lambda at: F.get(b["all"], at))

    return F.flatten(F.transform(bound, firsts))


def js_classes(content: Column) -> Column:
    found, regex = _js_definitions(content, JS_CLASS)

    def one(m: Column) -> Column:
        name, base = F.regexp_extract(m, regex, 2), F.regexp_extract(m, regex, 3)
        extends = F.when(base != "", F.concat(F.lit("extends "), base)).otherwise("")
        return _symbol(name, "class", js_doc(F.regexp_extract(m, regex, 1)), base, extends)

    return F.transform(found, one)


def js_functions(content: Column) -> Column:
    found, regex = _js_definitions(content, JS_FUNCTION)

    def one(m: Column) -> Column:
        name = F.concat(F.regexp_extract(m, regex, 2), F.regexp_extract(m, regex, 3))
        return _symbol(name, "function", js_doc(F.regexp_extract(m, regex, 1)), F.lit(""), F.lit(""))

    return _first_of_name(F.transform(found, one))


def js_interfaces(content: Column) -> Column:
    found, regex = _js_definitions(content, JS_INTERFACE)

    def one(m: Column) -> Column:
        name = F.regexp_extract(m, regex, 2)
        return _symbol(name, "interface", js_doc(F.regexp_extract(m, regex, 1)), F.lit(""), F.lit(""))

    class_matches, class_regex = _js_definitions(content, JS_CLASS)
    class_names = F.transform(class_matches, lambda m: F.regexp_extract(m, class_regex, 2))
    bound = F.array(F.struct(_first_of_name(F.transform(found, one)).alias("all"), class_names.alias("taken")))
    return F.flatten(
        F.transform(bound, lambda b: F.filter(b["all"], lambda s: ~F.array_contains(b["taken"], s["name"])))
    )

