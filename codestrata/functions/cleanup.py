"""Clean-up of generated text: column expressions from text to text, all within one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.markdown import drop_sections_like
from codestrata.functions.naming import BLANKS

# Titles of context sections that must not reach a document.
CONTEXT_TITLES = [
    "CI/CD WORKFLOWS", "GITHUB REPOSITORY CONFIGURATION", "COMPLETE CODEBASE STRUCTURE", "ALL FILES IN REPOSITORY",
    "KEY FILE CONTENTS",
]

# Tools whose sections go when they say that the tool is not used.
OPTIONAL_TOOLS = ["terraform", "ansible", "helm", "kubernetes"]
NOT_USED = ["not currently", "not applicable", "n/a"]

# Lines that are nothing but a dump of a list.
DUMP_LINES = [
    r"Languages:\s*\{[^}]+\}", r"Categories:\s*\{[^}]+\}", r"Tools:\s*\[[^\]]+\]", r"Purpose:\s*\w+\s+files",
]

PLACEHOLDER = "*[Structured data available in source files]*"


def drop_context_sections(text: Column) -> Column:
    """Without the first-level sections of the five context titles."""
    return drop_sections_like(text, "#(?!#)", rf"^#[ \t]*(?:{'|'.join(CONTEXT_TITLES)})[ \t]*(?:\n|\z)")


def drop_evidence_sections(text: Column) -> Column:
    """Without first- and second-level sections titled Repository Evidence, in any case."""
    return drop_sections_like(text, "#", r"(?i)^##?[ \t]*repository evidence")


def collapse_json_dumps(text: Column) -> Column:
    """Fenced JSON objects of 500 characters and more become one line."""
    return F.regexp_replace(text, r"```json\n\{[^}]{500,}\}\n```", PLACEHOLDER)


def drop_dump_lines(text: Column) -> Column:
    """Without the lines that only dump languages, categories, tools or a file purpose."""
    dump = rf"^\s*(?:{'|'.join(DUMP_LINES)})\s*$"
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(dump)), "\n")


def drop_directory_dumps(text: Column) -> Column:
    """Without sections that list one directory and go straight on to its purpose."""
    return drop_sections_like(text, "##", r"^##[ \t]+[\w/]+/[ \t]*\([0-9]+[ \t]+files?\)[ \t]*\n[ \t]+Purpose:")


def drop_inapplicable(text: Column) -> Column:
    """Without sections on an optional tool that say it is not used."""
    rules = [rf"{tool}.*(?:{'|'.join([*NOT_USED, 'no ' + tool])})" for tool in OPTIONAL_TOOLS]
    return drop_sections_like(text, "#", rf"(?is)^##?[ \t]*(?:{'|'.join(rules)})")


def squeeze_blank_lines(text: Column) -> Column:
    """At most two empty lines in a row, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"\n{4,}", "\n\n\n"), F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """All rules, in order."""
    for rule in (
        drop_context_sections,
        drop_evidence_sections,
        collapse_json_dumps,
        drop_dump_lines,
        drop_directory_dumps,
        drop_inapplicable,
        squeeze_blank_lines,
    ):
        text = rule(text)
    return text
