"""Markdown structure, clean-up and labelled responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, docs, strip, tree, tree_sql, view, view_sql
from checks.facts import big
from checks.scan import quoted
from codestrata.functions import cleanup as C
from codestrata.functions import markdown as M

registry = Registry()
add = registry.add

LINES = """
dl AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS ln FROM drafts),
fl AS (SELECT *, starts_with(line, '```') AS is_fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) % 2 = 1 AS open_ FROM dl),
st AS (SELECT doc_id, ln, line, is_fence, open_ AND NOT is_fence AS inside FROM fl)"""

add("fence_state", lambda s, d: big()(M.fence_state(view(s, d, "drafts"), "doc_id", "body")),
    view_sql("drafts", "SELECT doc_id, ln AS line_number, line, is_fence, inside FROM st", LINES))
add("fence_state_files",
    lambda s, d: big()(M.fence_state(tree(s, d).select(F.concat("repo", F.lit("/"), "path").alias("file"), "content"), "file", "content")
                       .groupBy("file").agg(F.count(F.when(F.col("inside"), 1)).alias("inside"), F.count(F.when(F.col("is_fence"), 1)).alias("fences"))),
    tree_sql("""SELECT file, count(*) FILTER (open_ AND NOT is_fence) AS inside, count(*) FILTER (is_fence) AS fences FROM (
      SELECT file, starts_with(line, '```') AS is_fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ln) % 2 = 1 AS open_ FROM (
        SELECT repo || '/' || path AS file, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM files))
    GROUP BY file"""))

KINDS = f"""
blocks AS (SELECT *, CASE WHEN is_fence THEN 'fence' WHEN inside THEN 'code' WHEN starts_with(line, '|') AND contains(line, '---') THEN 'table_rule'
    WHEN starts_with(line, '|') THEN 'table' WHEN starts_with(line, '# ') THEN 'h1' WHEN starts_with(line, '## ') THEN 'h2' WHEN starts_with(line, '### ') THEN 'h3'
    WHEN starts_with(line, '#### ') THEN 'h4' WHEN starts_with(line, '- ') OR starts_with(line, '* ') THEN 'bullet' WHEN starts_with(line, '  - ') OR starts_with(line, '  * ') THEN 'bullet2'
    WHEN regexp_matches(line, '^[0-9]') AND contains(substring(line, 1, 4), '. ') THEN 'numbered' WHEN {strip('line')} <> '' THEN 'paragraph' ELSE 'blank' END AS kind FROM st),
texts AS (SELECT *, CASE kind WHEN 'h1' THEN substring(line, 3) WHEN 'bullet' THEN substring(line, 3) WHEN 'h2' THEN substring(line, 4) WHEN 'h3' THEN substring(line, 5)
    WHEN 'bullet2' THEN substring(line, 5) WHEN 'h4' THEN substring(line, 6) WHEN 'numbered' THEN substring(line, strpos(line, '. ') + 2) ELSE line END AS text FROM blocks)"""
add("markdown_blocks", lambda s, d: big()(M.markdown_blocks(view(s, d, "drafts"), "doc_id", "body")),
    view_sql("drafts", "SELECT doc_id, ln AS line_number, kind, text FROM texts", LINES, KINDS))

TABLES = f"""
pipes AS (SELECT *, sum(CASE WHEN kind IN ('table', 'table_rule') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ln) AS grp FROM blocks),
trows AS (SELECT doc_id, ln, dense_rank() OVER (PARTITION BY doc_id ORDER BY grp) AS table_no, row_number() OVER (PARTITION BY doc_id, grp ORDER BY ln) - 1 AS row_no,
    list_transform(string_split(line, '|')[2:len(string_split(line, '|')) - 1], lambda c: {strip('c')}) AS cells FROM pipes WHERE kind = 'table'),
widths AS (SELECT *, first_value(len(cells)) OVER (PARTITION BY doc_id, table_no ORDER BY row_no) AS width FROM trows)"""
add("markdown_tables",
    lambda s, d: big()(M.markdown_tables(view(s, d, "drafts"), "doc_id", "body").withColumn("cells", F.array_join("cells", "|"))),
    view_sql("drafts", "SELECT doc_id, table_no, row_no, array_to_string(cells[1:width], '|') AS cells FROM widths", LINES, KINDS, TABLES))
add("markdown_table_cells", lambda s, d: big()(M.markdown_table_cells(view(s, d, "drafts"), "doc_id", "body")),
    view_sql("drafts", """SELECT doc_id, table_no, row_no, i - 1 AS col_no, trim(cell, '`') AS cell, row_no = 0 AS is_header FROM (
      SELECT doc_id, table_no, row_no, unnest(cells[1:width]) AS cell, generate_subscripts(cells[1:width], 1) AS i FROM widths)""", LINES, KINDS, TABLES))
SPANS = r"""
pcs AS (SELECT doc_id, ln, unnest(string_split(regexp_replace(text, '(`[^`]+`)', chr(1) || '\1' || chr(1), 'g'), chr(1))) AS part,
    generate_subscripts(string_split(regexp_replace(text, '(`[^`]+`)', chr(1) || '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM texts WHERE kind = 'paragraph'),
sub AS (SELECT doc_id, ln, i, 1 AS j, 'code' AS kind, substring(part, 2, greatest(length(part) - 2, 0)) AS text FROM pcs WHERE starts_with(part, '`') AND ends_with(part, '`')
  UNION ALL SELECT doc_id, ln, i, j, CASE WHEN starts_with(p, '**') AND ends_with(p, '**') THEN 'bold' ELSE 'plain' END,
    CASE WHEN starts_with(p, '**') AND ends_with(p, '**') THEN substring(p, 3, greatest(length(p) - 4, 0)) ELSE p END FROM (
    SELECT doc_id, ln, i, unnest(string_split(regexp_replace(part, '(\*\*[^*]+\*\*)', chr(1) || '\1' || chr(1), 'g'), chr(1))) AS p,
      generate_subscripts(string_split(regexp_replace(part, '(\*\*[^*]+\*\*)', chr(1) || '\1' || chr(1), 'g'), chr(1)), 1) AS j FROM pcs
    WHERE NOT (starts_with(part, '`') AND ends_with(part, '`'))))"""
add("markdown_spans", lambda s, d: big()(M.markdown_spans(view(s, d, "drafts"), "doc_id", "body")),
    view_sql("drafts", "SELECT doc_id, ln AS line_number, row_number() OVER (PARTITION BY doc_id, ln ORDER BY i, j) AS span_no, kind, text FROM sub WHERE text <> ''", LINES, KINDS, SPANS))


def sections_cte(name: str, source: str, heading: str) -> str:
    """Numbers the lines of ``source`` (doc_id, ln, line, inside) by the headings before them."""
    return f"""
{name} AS (SELECT *, sum(CASE WHEN NOT is_fence AND NOT inside AND regexp_matches(line, '{heading}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS sec FROM {source})"""


add("markdown_sections",
    lambda s, d: big()(M.markdown_sections(view(s, d, "drafts"), "doc_id", "body").select(
        "doc_id", "section_id", "heading", F.length(F.regexp_replace("body", r"\s+$", "")).alias("chars"))),
    view_sql("drafts", """SELECT doc_id, CAST(sec AS BIGINT) AS section_id, CASE WHEN sec > 0 THEN min_by(line, ln) END AS heading, length(regexp_replace(string_agg(line, chr(10) ORDER BY ln), '\\s+$', '')) AS chars
      FROM s0 GROUP BY doc_id, sec UNION ALL SELECT doc_id, 0, NULL, 0 FROM s0 WHERE ln = 1 AND sec = 1""", LINES, sections_cte("s0", "st", "^#")))

# Each rule as lines and windows, in a chain: the text is joined again between two rules.


def rejoin(name: str, source: str, keep: str) -> str:
    return f"{name} AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS body FROM {source} WHERE {keep} GROUP BY doc_id)"


def split_again(name: str, source: str) -> str:
    return f"""
{name}_l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS ln FROM {source}),
{name}_f AS (SELECT *, starts_with(line, '```') AS is_fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) % 2 = 1 AS open_ FROM {name}_l),
{name} AS (SELECT doc_id, ln, line, is_fence, open_ AND NOT is_fence AS inside FROM {name}_f)"""


def all_rows(name: str, source: str) -> str:
    """Documents whose lines were all dropped come back empty."""
    return f"{name} AS (SELECT d.doc_id, coalesce(x.body, '') AS body FROM drafts d LEFT JOIN {source} x USING (doc_id))"


TITLES = "|".join(C.CONTEXT_TITLES)


def rule_ctes(rule: str, source: str, out: str) -> list[str]:
    if rule == "context":
        return [split_again(f"{out}_s", source), sections_cte(f"{out}_n", f"{out}_s", "^#([^#]|$)"),
                f"{out}_d AS (SELECT *, max(CASE WHEN NOT is_fence AND NOT inside AND regexp_matches(line, '^#[ \\t]*({TITLES})[ \\t]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec) AS bad FROM {out}_n)",
                rejoin(f"{out}_j", f"{out}_d", "bad = 0"), all_rows(out, f"{out}_j")]
    if rule == "evidence":
        return [split_again(f"{out}_s", source), sections_cte(f"{out}_n", f"{out}_s", "^#"),
                f"{out}_d AS (SELECT *, max(CASE WHEN NOT is_fence AND NOT inside AND regexp_matches(line, '^##?[ \\t]*repository evidence', 'i') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec) AS bad FROM {out}_n)",
                rejoin(f"{out}_j", f"{out}_d", "bad = 0"), all_rows(out, f"{out}_j")]
    if rule == "json":
        return [f"{out} AS (SELECT doc_id, regexp_replace(body, '```json\\n\\{{[^}}]{{500,}}\\}}\\n```', '{C.PLACEHOLDER}', 'g') AS body FROM {source})"]
    if rule == "dumps":
        return [split_again(f"{out}_s", source),
                rejoin(f"{out}_j", f"{out}_s", f"NOT regexp_matches(line, {quoted('^' + chr(92) + 's*(?:' + '|'.join(C.DUMP_LINES) + ')' + chr(92) + 's*$')})"), all_rows(out, f"{out}_j")]
    if rule == "directories":
        return [split_again(f"{out}_s", source), sections_cte(f"{out}_n", f"{out}_s", "^##"),
                f"{out}_m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY ln) AS place FROM {out}_n)",
                f"""{out}_d AS (SELECT *, max(CASE WHEN place = 1 AND NOT is_fence AND NOT inside AND regexp_matches(line, '^##[ \\t]+[\\w/]+/[ \\t]*\\([0-9]+[ \\t]+files?\\)[ \\t]*$') THEN 1 ELSE 0 END) OVER w
                  + max(CASE WHEN place = 2 AND regexp_matches(line, '^[ \\t]+Purpose:') THEN 1 ELSE 0 END) OVER w AS bad FROM {out}_m WINDOW w AS (PARTITION BY doc_id, sec))""",
                rejoin(f"{out}_j", f"{out}_d", "bad < 2"), all_rows(out, f"{out}_j")]
    if rule == "inapplicable":
        bad = " OR ".join(
            f"regexp_matches(txt, '^##?[ \\t]*{t}', 'i') AND regexp_matches(txt, '(?s)^##?[ \\t]*{t}.*({'|'.join([*C.NOT_USED, 'no ' + t])})', 'i')" for t in C.OPTIONAL_TOOLS)
        return [split_again(f"{out}_s", source), sections_cte(f"{out}_n", f"{out}_s", "^#"),
                f"{out}_t AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY ln) AS txt FROM {out}_n GROUP BY doc_id, sec)",
                f"{out}_d AS (SELECT n.* FROM {out}_n n JOIN {out}_t t USING (doc_id, sec) WHERE NOT ({bad}))",
                rejoin(f"{out}_j", f"{out}_d", "true"), all_rows(out, f"{out}_j")]
    if rule == "blank":
        return [f"{out} AS (SELECT doc_id, {strip(f'regexp_replace(body, {quoted(chr(92) + chr(110) + chr(123) + chr(52) + chr(44) + chr(125))}, repeat(chr(10), 3), {quoted(chr(103))})')} AS body FROM {source})"]
    raise ValueError(rule)


RULES = {
    "context": C.drop_context_sections, "evidence": C.drop_evidence_sections, "json": C.collapse_json_dumps, "dumps": C.drop_dump_lines,
    "directories": C.drop_directory_dumps, "inapplicable": C.drop_inapplicable, "blank": C.squeeze_blank_lines,
}
NAMES = {
    "context": "drop_context_sections", "evidence": "drop_evidence_sections", "json": "collapse_json_dumps", "dumps": "drop_dump_lines",
    "directories": "drop_directory_dumps", "inapplicable": "drop_inapplicable", "blank": "squeeze_blank_lines",
}
# A dropped section at the end leaves the line break before it; both sides are compared without trailing white space.
for rule, function in RULES.items():
    add(NAMES[rule],
        lambda s, d, function=function: view(s, d, "drafts").select("doc_id", F.regexp_replace(function(F.col("body")), r"\s+$", "").alias("body")),
        view_sql("drafts", "SELECT doc_id, regexp_replace(body, '\\s+$', '') AS body FROM done", *rule_ctes(rule, "drafts", "done")))

CHAIN, previous = [], "drafts"
for number, rule in enumerate(RULES):
    CHAIN += rule_ctes(rule, previous, f"step{number}")
    previous = f"step{number}"
add("clean_text", lambda s, d: view(s, d, "drafts").select("doc_id", C.clean_text(F.col("body")).alias("body")),
    view_sql("drafts", f"SELECT doc_id, body FROM {previous}", *CHAIN))
add("squeeze_documents", lambda s, d: docs(s, d).select("doc_id", C.squeeze_blank_lines(F.col("text")).alias("body")),
    f"SELECT doc_id, {strip('regexp_replace(text, ' + quoted(chr(92) + 'n{4,}') + ', repeat(chr(10), 3), ' + quoted('g') + ')')} AS body FROM documents")

add("first_header", lambda s, d: view(s, d, "responses").select("repo", "doc_type", "section_ord", M.first_header(F.col("body")).alias("header")),
    view_sql("responses", """SELECT repo, doc_type, section_ord, (SELECT replace(line, '## ', '') FROM (
      SELECT unnest(string_split(r.body, chr(10))) AS line, generate_subscripts(string_split(r.body, chr(10)), 1) AS ln) WHERE starts_with(line, '## ') ORDER BY ln LIMIT 1) AS header FROM responses r"""))


def label_sql(label: str) -> str:
    return f"max_by({strip(f'replace(st, {quoted(label)}, {quoted(str())})')}, ln) FILTER (starts_with(st, '{label}'))"


add("parse_labelled_fields",
    lambda s, d: M.parse_labelled_fields(view(s, d, "responses"), ["repo", "doc_type", "section_ord"], "body").withColumn("concepts", F.array_join("concepts", "|")),
    view_sql("responses", f"""SELECT repo, doc_type, section_ord, {label_sql('PURPOSE:')} AS purpose, {label_sql('ARCHITECTURE:')} AS architecture,
      array_to_string(list_filter(list_transform(string_split({label_sql('CONCEPTS:')}, ','), lambda c: {strip('c')}), lambda c: c <> ''), '|') AS concepts
    FROM (SELECT repo, doc_type, section_ord, {strip('line')} AS st, ln FROM (SELECT repo, doc_type, section_ord, unnest(string_split(coalesce(body, ''), chr(10))) AS line,
      generate_subscripts(string_split(coalesce(body, ''), chr(10)), 1) AS ln FROM responses)) GROUP BY repo, doc_type, section_ord"""))
