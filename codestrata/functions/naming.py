"""Readable names for symbols, parameters and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.doc_types import with_added
from codestrata.functions.paths import lookup
from codestrata.functions.words import CLASS_WORDS, FUNCTION_WORDS, PLAIN_BASES

BLANKS = " \t\r\n\f\u000b"

# The ten document types and how their titles read.
DOCUMENT_TITLES = {
    "repository-overview": "Repository Overview",
    "architecture-guide": "Architecture Guide",
    "configuration-guide": "Configuration Guide",
    "deployment-runbook": "Deployment Runbook",
    "operations-runbook": "Operations Runbook",
    "api-reference": "Api Reference",
    "quality-and-validation": "Quality And Validation",
    "usage-patterns": "Usage Patterns",
    "developer-workflows": "Developer Workflows",
    "getting-started": "Getting Started",
}


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit("\"'"))


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def name_words(name: Column) -> Column:
    """Lower-case words of a camelCase or snake_case name."""
    spaced = F.translate(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "_", " ")
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda word: word != "")


def _tail_of_base(bases: Column) -> Column:
    """`` (extends X)`` for the first base class, unless it says nothing."""
    base = strip(F.substring_index(bases, ",", 1))
    return F.when((base == "") | base.isin(PLAIN_BASES), "").otherwise(F.concat(F.lit(" (extends "), base, F.lit(")")))


def humanize_symbol(name: Column, kind: Column, bases: Column) -> Column:
    """What a function, class or interface does, told from its name alone."""
    words = name_words(name)
    count = F.size(words)
    first, last = F.get(words, F.lit(0)), F.get(words, count - 1)
    all_words = F.array_join(words, " ")
    after_first = F.array_join(F.slice(words, F.lit(2), F.greatest(count - 1, F.lit(0))), " ")
    before_last = F.array_join(F.slice(words, F.lit(1), F.greatest(count - 1, F.lit(0))), " ")

    verb = lookup(FUNCTION_WORDS, first)
    as_function = F.coalesce(strip(F.concat(verb, F.lit(" "), after_first)), sentence_case(all_words))

    role = lookup(CLASS_WORDS, last)
    as_class = F.when(
        first.isin("base", "abstract"),
        F.concat(F.lit("Abstract base class for "), F.when(count > 1, after_first).otherwise("functionality")),
    ).otherwise(
        F.concat(
            F.coalesce(strip(F.concat(role, F.lit(" "), before_last)), sentence_case(all_words)),
            _tail_of_base(F.coalesce(bases, F.lit(""))),
        )
    )
    return (
        F.when(count == 0, "")
        .when(kind == "function", as_function)
        .when(kind == "class", as_class)
        .when(kind == "interface", F.concat(F.lit("Interface defining "), all_words))
        .otherwise("")
    )


def simplify_params(params: Column) -> Column:
    """Parameter names only, in brackets, without ``self`` and ``cls``."""
    names = F.transform(
        F.split(params, ","),
        lambda p: strip(F.substring_index(F.substring_index(p, ":", 1), "=", 1)),
    )
    kept = F.filter(names, lambda n: ~n.isin("", "self", "cls"))
    return F.concat(F.lit("("), F.array_join(kept, ", "), F.lit(")"))


def document_filename(doc_type: Column) -> Column:
    return F.concat(F.translate(F.upper(doc_type), "-", "_"), F.lit(".md"))


def document_titles() -> dict[str, str]:
    """Titles by type, those of added types as well."""
    return with_added(DOCUMENT_TITLES, "title")


def document_title(repo: Column, doc_type: Column) -> Column:
    return F.concat(repo, F.lit(" "), lookup(document_titles(), doc_type))


def control_id(repo: Column, doc_type: Column) -> Column:
    """DOC-, ten characters of the repository, fifteen of the document."""
    return F.concat(
        F.lit("DOC-"), F.substring(F.upper(repo), 1, 10), F.lit("-"), F.substring(F.upper(doc_type), 1, 15)
    )


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")
