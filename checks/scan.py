"""Sensitive-data scan, redaction, status, gate and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, conversations, docs, pages, text_list, tree, tree_sql, view, view_sql
from checks.features import BREAK, SCANNABLE_SQL
from codestrata.functions.catalog import CATALOG, LEVELS, Pattern, active_patterns
from codestrata.operators import scan as S
from codestrata.operators import status as ST
from codestrata.plans import report as R
from codestrata.sources.lines import explode_lines
from codestrata.sources.trees import scannable_files

registry = Registry()
add = registry.add

CASE_SSN = r"\b\d{9}\b.*(?:ssn|social)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def match_sql(p: Pattern) -> str:
    """Yes or no; the one look-ahead of the catalogue is written out, as RE2 has none."""
    regex = CASE_SSN if p.name == "ssn_unformatted" else p.regex
    return f"regexp_matches(line, {quoted(regex)}, 'i')"


def replace_sql(p: Pattern, line: str) -> str:
    if p.name == "ssn_unformatted":
        return f"regexp_replace({line}, {quoted(r'\b\d{9}\b(.*(?:ssn|social))')}, '[REDACTED]\\1', 'i')"
    return f"regexp_replace({line}, {quoted(p.regex)}, '[REDACTED]', 'gi')"


CATALOG_SQL = "catalog AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(quoted(x) for x in (p.name, p.severity, p.category, p.description, p.recommendation)) + ")" for p in CATALOG
) + ") AS t(pattern, severity, category, description, recommendation))"


def lines_cte(keys: str, source: str, text: str) -> str:
    return f"""
lines AS (
  SELECT {keys}, CAST(ln AS INT) AS line_number, line, (ltrim(line, ' ' || chr(9) || chr(11) || chr(12)) LIKE '#%'
      OR ltrim(line, ' ' || chr(9) || chr(11) || chr(12)) LIKE '//%') AS comment
  FROM (SELECT {keys}, unnest(parts) AS line, generate_subscripts(parts, 1) AS ln, len(parts) AS n
    FROM (SELECT {keys}, string_split_regex({text}, '{BREAK}') AS parts FROM {source}))
  WHERE NOT (ln = n AND line = '')
)"""


def hits_cte(keys: str, level: str, comment_aware: bool = False) -> str:
    cases = [
        f"CASE WHEN {match_sql(p)}{' AND NOT comment' if comment_aware and p.category == 'credential' else ''} THEN '{p.name}' END"
        for p in active_patterns(level)
    ]
    return f"""
hits AS (
  SELECT * FROM (SELECT {keys}, line_number, line, unnest([{", ".join(cases)}]) AS pattern FROM lines)
  WHERE pattern IS NOT NULL
)"""


FINDINGS_CTE = "findings AS (SELECT * FROM hits JOIN catalog USING (pattern))"


def corpus_sql(body: str, keys: str, source: str, text: str, level: str) -> str:
    return "WITH " + ",".join([lines_cte(keys, source, text), hits_cte(keys, level), CATALOG_SQL, FINDINGS_CTE]) + body


def repo_sql(body: str, level: str, *ctes: str) -> str:
    return tree_sql(
        body, SCANNABLE_SQL, lines_cte("repo, path", "scannable", "content"), hits_cte("repo, path", level, True), CATALOG_SQL, FINDINGS_CTE, *ctes
    )


# --- catalogue and lines --------------------------------------------------------------------------------------------

for level in LEVELS:
    names = text_list([p.name for p in active_patterns(level)])
    add(f"scan_level_{level}",
        lambda s, d, level=level: S.scan_lines(explode_lines(view(s, d, "planted"), ["doc_id"], "content"), ["doc_id"], level, False)
        .select("doc_id", "line_number", "pattern"),
        view_sql("planted", "SELECT doc_id, line_number, pattern FROM hits", lines_cte("doc_id", "planted", "content"), hits_cte("doc_id", level)))

add("pattern_catalog",
    lambda s, d: S.pattern_catalog(s).join(
        S.scan_lines(explode_lines(view(s, d, "planted"), ["doc_id"], "content"), ["doc_id"], "thorough", False)
        .groupBy("pattern").agg(F.count("*").alias("hits")), "pattern", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("bigint")),
    view_sql("planted", "SELECT catalog.*, (SELECT count(*) FROM hits WHERE hits.pattern = catalog.pattern) AS hits FROM catalog",
             lines_cte("doc_id", "planted", "content"), hits_cte("doc_id", "thorough"), CATALOG_SQL))

EXTRA = [Pattern("employee_number", "high", "pii", r"\bEMP-\d{6}\b", "Employee number", "Remove it."),
         Pattern("weekday", "low", "info", r"\b(?:monday|friday)\b", "Weekday", "Nothing to do.")]
add("extra_patterns",
    lambda s, d: S.scan_content(docs(s, d), ["doc_id"], "text", "thorough", EXTRA).select("doc_id", "line_number", "pattern", "severity"),
    "WITH " + lines_cte("doc_id", "documents", "text") + "," + hits_cte("doc_id", "thorough") + "," + CATALOG_SQL + r"""
    SELECT doc_id, line_number, pattern, severity FROM hits JOIN catalog USING (pattern)
    UNION ALL SELECT doc_id, line_number, 'employee_number', 'high' FROM lines WHERE regexp_matches(line, '\bEMP-\d{6}\b', 'i')
    UNION ALL SELECT doc_id, line_number, 'weekday', 'low' FROM lines WHERE regexp_matches(line, '\b(?:monday|friday)\b', 'i')""")

add("comment_lines",
    lambda s, d: explode_lines(scannable_files(tree(s, d)), ["repo", "path"], "content")
    .filter(S.is_comment(F.col("line"))).select("repo", "path", "line_number"),
    tree_sql("SELECT repo, path, line_number FROM lines WHERE comment", SCANNABLE_SQL, lines_cte("repo, path", "scannable", "content")))
add("comment_suppression",
    lambda s, d: S.scan_lines(explode_lines(scannable_files(tree(s, d)), ["repo", "path"], "content"), ["repo", "path"], "thorough", True)
    .select("repo", "path", "line_number", "pattern"),
    repo_sql("SELECT repo, path, line_number, pattern FROM hits", "thorough"))

# --- content scans --------------------------------------------------------------------------------------------------

DETAIL = ["line_number", "pattern", "severity", "category", "description", "recommendation"]
for name, reader, keys, text in (
    ("documents", docs, ["doc_id"], "text"),
    ("conversations", conversations, ["conv_id", "turn"], "text"),
    ("pages", pages, ["page_id"], "html"),
):
    add(f"scan_content_{name}",
        lambda s, d, reader=reader, keys=keys, text=text: S.scan_content(reader(s, d), keys, text, "thorough").select(*keys, *DETAIL),
        corpus_sql(f"SELECT {', '.join([*keys, *DETAIL])} FROM findings", ", ".join(keys), name, text, "thorough"))

SAMPLE_SQL = ("CASE pattern " + " ".join(f"WHEN '{p.name}' THEN {replace_sql(p, 'line')}" for p in CATALOG) + " END")
REDACTED_CTES = [
    f"red AS (SELECT *, regexp_replace(regexp_replace({SAMPLE_SQL}, '\\d{{3}}-\\d{{2}}-\\d{{4}}', '[SSN]', 'g'), "
    "'[''\"][^''\"]{20,}[''\"]', '\"[REDACTED]\"', 'g') AS safe FROM findings)",
    "sampled AS (SELECT *, trim(CASE WHEN length(safe) > 100 THEN substring(safe, 1, 100) || '...' ELSE safe END, "
    "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS data_sample FROM red)",
]
add("redact",
    lambda s, d: S.scan_content(view(s, d, "planted"), ["doc_id"], "content", "thorough").select("doc_id", "line_number", "pattern", "data_sample"),
    view_sql("planted", "SELECT doc_id, line_number, pattern, data_sample FROM sampled", lines_cte("doc_id", "planted", "content"),
             hits_cte("doc_id", "thorough"), CATALOG_SQL, FINDINGS_CTE, *REDACTED_CTES))
add("scan_repository",
    lambda s, d: S.scan_repository(tree(s, d), "thorough").select("repo", "path", *DETAIL, "data_sample"),
    repo_sql(f"SELECT repo, path, {', '.join(DETAIL)}, data_sample FROM sampled", "thorough", *REDACTED_CTES))


def chain(level: str) -> str:
    out = "line"
    for p in active_patterns(level):
        out = replace_sql(p, out)
    return out


def redacted_sql(keys: str, source: str, text: str, level: str) -> str:
    return f"""SELECT {keys}, string_agg(safe, chr(10) ORDER BY ln) AS {text} FROM (
      SELECT {keys}, ln, {chain(level)} AS safe FROM (
        SELECT {keys}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS ln FROM {source}))
    GROUP BY {keys}"""


add("redact_corpus_documents", lambda s, d: S.redact_corpus(docs(s, d).select("doc_id", "text"), "text", "thorough"),
    redacted_sql("doc_id", "documents", "text", "thorough"))
add("redact_corpus_planted", lambda s, d: S.redact_corpus(view(s, d, "planted"), "content", "standard"),
    view_sql("planted", redacted_sql("doc_id", "planted", "content", "standard")))

# --- gate rows ------------------------------------------------------------------------------------------------------

add("ai_safe_documents", lambda s, d: S.ai_safe_rows(docs(s, d).select("doc_id", "text"), "text", "standard").select("doc_id"),
    corpus_sql("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)", "doc_id", "documents", "text", "standard"))
add("ai_safe_conversations",
    lambda s, d: S.ai_safe_rows(conversations(s, d), "text", "standard").select("conv_id", "turn"),
    corpus_sql("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.conv_id = c.conv_id AND h.turn = c.turn)",
               "conv_id, turn", "conversations", "text", "standard"))
add("ai_safe_labelled",
    lambda s, d: S.ai_safe_rows(view(s, d, "planted"), "content", "quick").select("doc_id")
    .join(s.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg(F.count("*").alias("rows")),
    view_sql("planted", "SELECT quality, count(*) AS rows FROM planted JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM hits) GROUP BY quality",
             lines_cte("doc_id", "planted", "content"), hits_cte("doc_id", "quick")))

# --- counts and status ----------------------------------------------------------------------------------------------


def repo_findings(s, d):
    return S.describe(S.scan_lines(explode_lines(scannable_files(tree(s, d)), ["repo", "path"], "content"), ["repo", "path"], "thorough"))


def doc_findings(s, d):
    table = view(s, d, "planted").join(docs(s, d).select("doc_id", "source"), "doc_id")
    return S.scan_content(table, ["doc_id", "source"], "content", "thorough")


PLANTED_SOURCES = "(SELECT p.doc_id, source, content FROM planted p JOIN documents USING (doc_id))"


def source_sql(body: str) -> str:
    return view_sql("planted", body, lines_cte("doc_id, source", PLANTED_SOURCES, "content"), hits_cte("doc_id, source", "thorough"), CATALOG_SQL, FINDINGS_CTE)


COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + ", count(*) AS total"
add("severity_counts", lambda s, d: ST.severity_counts(repo_findings(s, d), ["repo"]),
    repo_sql(f"SELECT repo, {COUNTS} FROM findings GROUP BY repo", "thorough"))
add("severity_counts_by_source", lambda s, d: ST.severity_counts(doc_findings(s, d), ["source"]),
    source_sql(f"SELECT source, {COUNTS} FROM findings GROUP BY source"))
add("scan_totals", lambda s, d: ST.scan_totals(scannable_files(tree(s, d)), repo_findings(s, d), "repo", "path"),
    repo_sql("""SELECT repo, count(*) AS scanned, count(*) FILTER (EXISTS (SELECT 1 FROM findings f WHERE f.repo = x.repo AND f.path = x.path)) AS with_findings
      FROM scannable x GROUP BY repo""", "thorough"))
add("files_with_findings",
    lambda s, d: ST.files_with_findings(scannable_files(tree(s, d)).select("repo", "path"), repo_findings(s, d), ["repo", "path"]),
    repo_sql("SELECT DISTINCT repo, path FROM findings", "thorough"))

STATUS_SQL = """
status AS (
  SELECT g AS {group}, NOT coalesce(phi, false) AS hipaa_compliant, NOT coalesce(card, false) AS pci_compliant, cats IS NULL AS ai_safe,
    CASE WHEN cats IS NULL THEN '' ELSE 'Repository contains ' || cats || ' data. AI refinement blocked to prevent data exposure.' END AS ai_blocked_reason
  FROM (SELECT DISTINCT {group} AS g FROM {subjects}) LEFT JOIN (
    SELECT {group}, bool_or(category = 'phi') AS phi, bool_or(category = 'pii' AND contains(lower(description), 'credit')) AS card,
      string_agg(DISTINCT category, ', ' ORDER BY category) AS cats
    FROM findings WHERE severity IN ('critical', 'high') GROUP BY {group}) ON g = {group}
)"""
REPO_STATUS = STATUS_SQL.format(group="repo", subjects="scannable")
add("compliance_status", lambda s, d: ST.compliance_status(scannable_files(tree(s, d)), repo_findings(s, d), "repo"),
    repo_sql("SELECT * FROM status", "thorough", REPO_STATUS))


def source_status(s, d):
    """Status of each document source at the standard level."""
    table = docs(s, d).select("doc_id", "source", "text")
    found = S.scan_content(table, ["doc_id", "source"], "text", "standard")
    return ST.compliance_status(table, found, "source")


add("compliance_status_by_source", source_status,
    "WITH " + ",".join([lines_cte("doc_id, source", "documents", "text"), hits_cte("doc_id, source", "standard"), CATALOG_SQL, FINDINGS_CTE,
                        STATUS_SQL.format(group="source", subjects="documents")]) + " SELECT * FROM status")
add("medium_by_category", lambda s, d: ST.medium_by_category(repo_findings(s, d), "repo"),
    repo_sql("SELECT repo, category, count(*) AS findings FROM findings WHERE severity = 'medium' GROUP BY repo, category", "thorough"))
add("severity_rollup", lambda s, d: ST.severity_rollup(doc_findings(s, d), "source"),
    source_sql("SELECT source, severity, category, count(*) AS findings, grouping(source, severity, category) AS level FROM findings GROUP BY ROLLUP (source, severity, category)"))
add("report_head", lambda s, d: ST.report_head(doc_findings(s, d), "source", ["doc_id", "line_number", "pattern"], 3).withColumn("rank", F.col("rank").cast("bigint")),
    source_sql("""SELECT source, rank, doc_id, line_number, pattern, description, category, greatest(n - 3, 0) AS more FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_number, pattern) AS rank, count(*) OVER (PARTITION BY source) AS n
      FROM findings WHERE severity = 'high') WHERE rank <= 3"""))
for mode, force in (("healthcare", False), ("healthcare", True), ("scan", False), ("off", False)):
    blocked = "NOT ai_safe" if mode == "healthcare" and not force else "false"
    warned = "NOT ai_safe" if mode == "scan" and not force else "false"
    add(f"gate_{mode}{'_forced' if force else ''}",
        lambda s, d, mode=mode, force=force: ST.gate(ST.compliance_status(scannable_files(tree(s, d)), repo_findings(s, d), "repo"), mode, force)
        .select("repo", "allowed", "warn", "reason"),
        repo_sql(f"SELECT repo, NOT ({blocked}) AS allowed, {warned} AS warn, CASE WHEN {blocked} THEN ai_blocked_reason ELSE '' END AS reason FROM status",
                 "thorough", REPO_STATUS))

REPORT_SQL = f"""
totals AS (SELECT repo, count(*) AS scanned, count(*) FILTER (EXISTS (SELECT 1 FROM findings f WHERE f.repo = x.repo AND f.path = x.path)) AS with_findings
  FROM scannable x GROUP BY repo),
counts AS (SELECT repo, {COUNTS} FROM findings GROUP BY repo),
summary AS (SELECT totals.*, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
  FROM totals LEFT JOIN counts USING (repo)),
highs AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, line_number, pattern) AS rank, count(*) OVER (PARTITION BY repo) AS n
  FROM findings WHERE severity = 'high'),
blocks AS (
  SELECT repo, 10 AS section, '' AS path, 0 AS line_number, '' AS pattern,
    concat('# Sensitive data report', chr(10), chr(10), '**Repository:** ', repo, chr(10), chr(10), '## Summary', chr(10), chr(10), '| Metric | Value |', chr(10), '|---|---|', chr(10),
      '| Files scanned | ', scanned, ' |', chr(10), '| Files with findings | ', with_findings, ' |', chr(10), '| Critical findings | ', critical, ' |', chr(10),
      '| High findings | ', high, ' |', chr(10), '| Medium findings | ', medium, ' |', chr(10), '| Low findings | ', low, ' |', chr(10)) AS text FROM summary
  UNION ALL SELECT repo, 20, '', 0, '', concat('## Status', chr(10), chr(10), '- **HIPAA:** ', CASE WHEN hipaa_compliant THEN 'YES' ELSE 'NO - health data found' END, chr(10),
      '- **PCI:** ', CASE WHEN pci_compliant THEN 'YES' ELSE 'NO - payment card data found' END, chr(10), '- **AI safe:** ', CASE WHEN ai_safe THEN 'YES' ELSE 'NO - blocked' END, chr(10),
      CASE WHEN ai_safe THEN '' ELSE concat(chr(10), '> ', ai_blocked_reason, chr(10)) END) FROM status
  UNION ALL SELECT repo, 30, '', 0, '', concat('## Critical findings', chr(10), chr(10), '| File | Line | Issue | Category | Recommendation |', chr(10), '|---|---|---|---|---|') FROM counts WHERE critical > 0
  UNION ALL SELECT repo, 31, path, line_number, pattern, concat('| `', path, '` | ', line_number, ' | ', description, ' | ', upper(category), ' | ', recommendation, ' |') FROM findings WHERE severity = 'critical'
  UNION ALL SELECT repo, 40, '', 0, '', concat(chr(10), '## High findings', chr(10), chr(10), '| File | Line | Issue | Category |', chr(10), '|---|---|---|---|') FROM counts WHERE high > 0
  UNION ALL SELECT repo, 41, path, line_number, pattern, concat('| `', path, '` | ', line_number, ' | ', description, ' | ', upper(category), ' |') FROM highs WHERE rank <= 50
  UNION ALL SELECT repo, 42, '', 0, '', concat('| ... | ... | *', n - 50, ' more findings* | ... |') FROM highs WHERE rank = 1 AND n > 50
  UNION ALL SELECT repo, 50, '', 0, '', concat(chr(10), '## Medium findings', chr(10), chr(10), '*', medium, ' findings.*', chr(10)) FROM counts WHERE medium > 0
  UNION ALL SELECT repo, 51, lpad(CAST(1000000000000000 - count(*) AS VARCHAR), 16, '0'), 0, category, concat('- ', upper(category), ': ', count(*)) FROM findings WHERE severity = 'medium' GROUP BY repo, category
  UNION ALL SELECT repo, 60, '', 0, '', {"chr(10) || " + " || chr(10) || ".join(quoted(x) for x in R.CLOSING.split(chr(10)))} FROM summary
)"""
add("compliance_report", lambda s, d: R.compliance_report(scannable_files(tree(s, d)), repo_findings(s, d)),
    repo_sql("SELECT repo, 1::BIGINT AS part, string_agg(text, chr(10) ORDER BY section, path, line_number, pattern) AS body FROM blocks GROUP BY repo",
             "thorough", REPO_STATUS, REPORT_SQL))
