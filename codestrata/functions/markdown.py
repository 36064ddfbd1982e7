"""Markdown structure as column expressions.

A text is cut at its code fences: pieces with an even index lie outside a
fence, pieces with an odd index inside one. Every rule below works on these
pieces within one row, so no line table has to be shuffled or sorted to know
whether a line is code, a heading or part of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.naming import strip

# Stands before the first line, so that a fence there does not shift the pieces. Never part of a text.
START = "\u0001"
CUT = "\u0002"


def fence_pieces(text: Column) -> Column:
    """Pieces of the text; each but the first begins with a fence line."""
    return F.split(F.concat(F.lit(START + "\n"), text), "\n(?=```)", -1)


def join_pieces(pieces: Column) -> Column:
    """The text that ``fence_pieces`` came from."""
    return F.substring(F.array_join(pieces, "\n"), 3, 2_147_483_647)


def fenced_lines(text: Column) -> Column:
    """Lines as structs: the text, whether it is a fence itself, whether it lies inside one."""
    nested = F.transform(
        fence_pieces(text),
        lambda piece, i: F.transform(
            F.split(piece, "\n", -1),
            lambda line, j: F.struct(
                line.alias("line"),
                ((i > 0) & (j == 0)).alias("is_fence"),
                ((i % 2 == 1) & (j > 0)).alias("inside"),
            ),
        ),
    )
    return F.slice(F.flatten(nested), 2, 1_000_000_000)


def cut_before(text: Column, line_start: str) -> Column:
    """Sections that begin at each line outside a fence where ``line_start`` matches; the first has none."""
    marked = F.transform(
        fence_pieces(text),
        lambda piece, i: F.when(i % 2 == 0, F.regexp_replace(piece, f"(?m)^(?={line_start})", CUT)).otherwise(piece),
    )
    return F.split(join_pieces(marked), CUT, -1)


def drop_sections_like(text: Column, line_start: str, unwanted: str) -> Column:
    """The text without the sections that match ``unwanted`` from their first character on."""
    return F.array_join(F.filter(cut_before(text, line_start), lambda section: ~section.rlike(unwanted)), "")


def line_kind(s: Column) -> Column:
    """Block kind of one struct of ``fenced_lines``."""
    line = s["line"]

    def begins(*marks: str) -> Column:
        out = line.startswith(marks[0])
        for mark in marks[1:]:
            out = out | line.startswith(mark)
        return out

    return (
        F.when(s["is_fence"], "fence")
        .when(s["inside"], "code")
        .when(begins("|") & line.contains("---"), "table_rule")
        .when(begins("|"), "table")
        .when(begins("# "), "h1")
        .when(begins("## "), "h2")
        .when(begins("### "), "h3")
        .when(begins("#### "), "h4")
        .when(begins("- ", "* "), "bullet")
        .when(begins("  - ", "  * "), "bullet2")
        .when(line.rlike("^[0-9]") & F.substring(line, 1, 4).contains(". "), "numbered")
        .when(strip(line) != "", "paragraph")
        .otherwise("blank")
    )


def line_text(kind: Column, line: Column) -> Column:
    """The line without its block mark."""
    skip = (
        F.when(kind.isin("h1", "bullet"), 2)
        .when(kind == "h2", 3)
        .when(kind.isin("h3", "bullet2"), 4)
        .when(kind == "h4", 5)
        .when(kind == "numbered", F.locate(". ", line) + 1)
        .otherwise(0)
    )
    return F.substring(line, skip + 1, F.lit(2_147_483_647))


def fence_state(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line, numbered from 1, with its place relative to code fences."""
    return df.select(key, F.posexplode(fenced_lines(F.col(text))).alias("at", "s")).select(
        key, (F.col("at") + 1).alias("line_number"), "s.line", "s.is_fence", "s.inside"
    )


def markdown_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with its block kind and its text without the mark."""
    rows = df.select(key, F.posexplode(fenced_lines(F.col(text))).alias("at", "s"))
    kinds = rows.select(key, (F.col("at") + 1).alias("line_number"), line_kind(F.col("s")).alias("kind"), "s.line")
    return kinds.select(key, "line_number", "kind", line_text(F.col("kind"), F.col("line")).alias("text"))


def markdown_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per table row: table number, row number from 0 (the header) and its cells.

    Neighbouring lines that start with a bar form a table; rule lines are left
    out, and a code fence ends a table.
    """
    # The possessive repeat keeps the match iterative, however long a table is.
    runs = F.transform(
        fence_pieces(F.col(text)),
        lambda piece, i: F.when(
            i % 2 == 0, F.regexp_extract_all(piece, F.lit(r"(?m)^\|[^\n]*(?:\n\|[^\n]*)*+"), F.lit(0))
        ).otherwise(F.array().cast("array<string>")),
    )
    tables = F.filter(
        F.transform(F.flatten(runs), lambda run: F.filter(F.split(run, "\n", -1), lambda line: ~line.contains("---"))),
        lambda rows: F.size(rows) > 0,
    )

    def cells(line: Column) -> Column:
        parts = F.split(line, r"\|", -1)
        inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        return F.transform(inner, lambda cell: strip(cell))

    per_table = df.select(key, F.posexplode(tables).alias("table_no", "rows"))
    per_row = per_table.select(
        key, "table_no", F.size(cells(F.get("rows", F.lit(0)))).alias("width"), F.posexplode("rows").alias("row_no", "line")
    )
    return per_row.select(
        key, (F.col("table_no") + 1).alias("table_no"), "row_no", F.slice(cells(F.col("line")), F.lit(1), F.col("width")).alias("cells")
    )


def markdown_table_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per cell, at most as many per row as the header has, without backticks around it."""
    return markdown_tables(df, key, text).select(
        key, "table_no", "row_no", F.posexplode("cells").alias("col_no", "cell"), (F.col("row_no") == 0).alias("is_header")
    ).withColumn("cell", F.btrim("cell", F.lit("`")))


def _marked(text: Column, regex: str) -> Column:
    return F.split(F.regexp_replace(text, f"({regex})", f"{START}$1{START}"), START, -1)


def spans(line: Column) -> Column:
    """Runs of code, bold and plain text of one paragraph; code is found first, empty runs are left out."""

    def inner(part: Column, width: int) -> Column:
        return F.substring(part, F.lit(width + 1), F.greatest(F.length(part) - 2 * width, F.lit(0)))

    def run(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def plain_or_bold(part: Column) -> Column:
        bold = part.startswith("**") & part.endswith("**")
        return F.when(bold, run("bold", inner(part, 2))).otherwise(run("plain", part))

    pieces = F.transform(
        _marked(line, "`[^`]+`"),
        lambda part: F.when(
            part.startswith("`") & part.endswith("`"), F.array(run("code", inner(part, 1)))
        ).otherwise(F.transform(_marked(part, r"\*\*[^*]+\*\*"), plain_or_bold)),
    )
    return F.filter(F.flatten(pieces), lambda r: r["text"] != "")


def markdown_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per run of text of each paragraph line."""
    paragraphs = markdown_blocks(df, key, text).filter(F.col("kind") == "paragraph")
    return paragraphs.select(key, "line_number", F.posexplode(spans(F.col("text"))).alias("at", "s")).select(
        key, "line_number", (F.col("at") + 1).alias("span_no"), "s.kind", "s.text"
    )


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per section: from a heading of any level to the next one. Section 0 precedes all headings."""
    rows = df.select(key, F.posexplode(cut_before(F.col(text), "#")).alias("section_id", "body"))
    heading = F.when(F.col("section_id") > 0, F.substring_index("body", "\n", 1))
    return rows.select(key, "section_id", heading.alias("heading"), "body")


def first_header(text: Column) -> Column:
    """First second-level heading line of a section, without its marks; null when there is none."""
    line = F.regexp_extract(text, r"(?m)^## [^\n]*", 0)
    return F.when(line != "", F.replace(line, F.lit("## "), F.lit("")))


def labelled_value(text: Column, label: str) -> Column:
    """What follows ``label`` on the last line that starts with it; null when there is none."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: strip(x)), lambda x: x.startswith(label))
    return strip(F.replace(F.try_element_at(lines, F.lit(-1)), F.lit(label), F.lit("")))


def parse_labelled_fields(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Purpose, architecture and concepts of a response whose lines start with these labels."""
    concepts = F.transform(F.split(labelled_value(F.col(text), "CONCEPTS:"), ","), lambda c: strip(c))
    return df.select(
        *keys,
        labelled_value(F.col(text), "PURPOSE:").alias("purpose"),
        labelled_value(F.col(text), "ARCHITECTURE:").alias("architecture"),
        F.filter(concepts, lambda c: c != "").alias("concepts"),
    )
