"""Reading YAML settings as columns: blocks by indentation, flow maps and lists by their brackets.

A block is a text whose first line has a key and whose further lines are indented below it. ``entries`` cuts it at the lines of
its own children, whatever their indent, so a key deeper down, or in a multi-line text, is not mistaken for a child. A
flow value is turned into JSON, which knows quotes and brackets of any depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = r"""^\s*(?:"([^"\n]*)"|'([^'\n]*)'|([^\s"'#{\[-][^:\n]*?|-[^\s:][^:\n]*?))[ \t]*:(?=\s|$)"""
# A quoted text, a comment, or a bare word of a flow value up to the sign that ends it.
TOKEN = r""""(?:[^"\\]|\\.)*+"|'(?:[^']|'')*+'|\s#[^\n]*|[^\s{}\[\],:"'](?:[^\s{}\[\],:#]|[ \t]++(?![\s#{}\[\],:])|:(?!\s)|(?<!\s)#)*+"""
ALL = 1_000_000_000


def first_line(block: Column) -> Column:
    return F.substring_index(block, "\n", 1)


def documents_text(content: Column) -> Column:
    """The settings without blank lines, comment lines and document marks."""
    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return F.rtrim(F.regexp_replace(text, r"(?m)^(?:[ \t]*(?:#[^\n]*)?|---[^\n]*|%[^\n]*)(?:\n|\z)", ""), F.lit("\n"))


def key(block: Column) -> Column:
    """The key of a block's first line without its quotes; empty if it has none."""
    head = first_line(block)
    return F.concat(*[F.regexp_extract(head, KEY, group) for group in (1, 2, 3)])


def value(block: Column) -> Column:
    """What follows the key, further lines included."""
    return F.btrim(F.regexp_replace(block, KEY, ""), F.lit(" \n\t"))


def is_flow(text: Column) -> Column:
    return text.startswith("{") | text.startswith("[")


def scalar(text: Column) -> Column:
    """The first line of a value as text: quotes and a comment behind it gone; empty for a multi-line text, a map or a list."""
    line = F.btrim(first_line(text), F.lit(" \t"))
    quoted = F.regexp_extract(line, r'''^"((?:[^"\\]|\\.)*)"|^'((?:[^']|'')*)\'''', 0)
    bare = F.btrim(F.regexp_replace(line, r"(?:^|\s)#.*$", ""), F.lit(" \t"))
    inside = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.when(quoted != "", inside).when(is_flow(line) | line.rlike(r"^[|>][+-]?\d*\s*(?:#.*)?$"), "").otherwise(bare)


def entries(block: Column) -> Column:
    """The blocks of a block's children: cut at every line that has the indent of the first line below the key."""
    indent = F.regexp_extract(block, r"\n( *)[^\s]", 1)
    return F.slice(F.split(block, F.concat(F.lit("\n(?="), indent, F.lit(r"[^\s-])")), -1), 2, ALL)


def top_entries(content: Column) -> Column:
    """The blocks of the top level. Items of a list at the margin belong to the key before them."""
    return F.split(documents_text(content), r"\n(?=[^\s-])", -1)


def items(block: Column) -> Column:
    """Texts of the list items directly below a block's key."""
    indent = F.regexp_extract(block, r"\n( *)-(?:\s|$)", 1)
    found = F.regexp_extract_all(block, F.concat(F.lit("(?m)^"), indent, F.lit(r"-[ \t]+(\S[^\n]*)$")), F.lit(1))
    return F.transform(found, scalar)


def child(blocks: Column, name: str) -> Column:
    """The block with this key, or null."""
    return F.get(F.filter(blocks, lambda b: key(b) == name), F.lit(0))


def flow_json(text: Column) -> Column:
    """A flow map or list as JSON: every word a quoted text."""
    tokens = F.regexp_extract_all(text, F.lit(rf"{TOKEN}|[{{}}\[\],:]"), F.lit(0))

    def as_json(token: Column) -> Column:
        single = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit("''"), F.lit("'"))
        word = F.when(token.startswith("'"), single).otherwise(token)
        quoted = F.concat(F.lit('"'), F.replace(F.replace(word, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.when(token.rlike(r"^(?:[{}\[\],:]|\"[\s\S]*)$"), token).when(token.rlike(r"^\s#"), "").otherwise(quoted)

    # A comma before the end is allowed in a flow value, a key without a value means null.
    text = F.array_join(F.transform(tokens, as_json), "")
    text = F.regexp_replace(text, r",(?=[}\]])", "")
    return F.regexp_replace(text, r":(?=[,}])", ":null")


def flow_map(text: Column) -> Column:
    """A flow map by key; values that are maps or lists as JSON. Null if it is none."""
    return F.from_json(flow_json(text), "map<string,string>")


def json_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def flow_list(text: Column) -> Column:
    return F.from_json(flow_json(text), "array<string>")


def names(block: Column) -> Column:
    """The keys or items of a value in any form: one word, a flow list, a flow map, a block list or a block map."""
    text = value(block)
    return (
        F.when(text.startswith("["), flow_list(text))
        .when(text.startswith("{"), F.map_keys(flow_map(text)))
        .when(scalar(text).rlike(r"^[^\s:-]\S*$") & ~block.contains("\n"), F.array(scalar(text)))
        .when(block.rlike(r"\n *-(?:\s|$)") & ~block.rlike(r"^[^\n]*\n *[^\s-]"), items(block))
        .otherwise(F.transform(entries(block), key))
    )
