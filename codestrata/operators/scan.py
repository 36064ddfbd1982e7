"""Sensitive-data scan: every line against every active pattern, in one narrow stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.catalog import TRAITS, Pattern, active_patterns
from codestrata.sources.lines import explode_lines, text_lines, text_source
from codestrata.sources.trees import scannable_files

SAMPLE_CHARS = 100


def pattern_catalog(spark: SparkSession, level: str = "thorough", extra: list[Pattern] | None = None) -> DataFrame:
    """The active patterns as a table. Its size is fixed by the code: the catalogue and the caller's list."""
    rows = [
        F.struct(
            F.lit(p.name).alias("pattern"),
            F.lit(p.severity).alias("severity"),
            F.lit(p.category).alias("category"),
            F.lit(p.description).alias("description"),
            F.lit(p.recommendation).alias("recommendation"),
        )
        for p in active_patterns(level, extra)
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def is_comment(line: Column) -> Column:
    """Lines that start with a hash or two slashes after white space."""
    start = F.ltrim(F.translate(line, "\t\f\u000b", "   "))
    return start.startswith("#") | start.startswith("//")


def _line_traits(line: Column, *others: Column) -> Column:
    """A line with what the pattern tests share: its lower-case form and the traits of the catalogue."""
    traits = [line.rlike(regex).alias(name) for name, regex in TRAITS.items()]
    return F.struct(line.alias("line"), F.lower(line).alias("lower"), *traits, *others)


def _matches(s: Column, pattern: Pattern) -> Column:
    """Whether a line struct matches; the cheap tests stand first and end the evaluation early."""
    tests = [
        s[need] if isinstance(need, str) else reduce(lambda a, b: a | b, [s["lower"].contains(n) for n in need])
        for need in pattern.needles
    ]
    return reduce(lambda a, b: a & b, [*tests, s["line"].rlike("(?i)" + pattern.regex)])


def scan_lines(
    lines: DataFrame,
    keys: list[str],
    level: str = "standard",
    comment_aware: bool = True,
    extra: list[Pattern] | None = None,
) -> DataFrame:
    """One row per (line, matching pattern) with ``keys``, ``line_number``, ``line`` and ``pattern``.

    The patterns are constants of the plan, so each is compiled once per task
    and nothing is shuffled. With ``comment_aware``, credential patterns do not
    fire on comment lines.
    """
    patterns = active_patterns(level, extra)
    comment = is_comment(F.col("line")) if comment_aware else F.lit(False)
    prepared = lines.select(*keys, "line_number", _line_traits(F.col("line"), comment.alias("comment")).alias("s"))
    s = F.col("s")

    def fires(p: Pattern) -> Column:
        hit = _matches(s, p)
        return hit & ~s["comment"] if comment_aware and p.category == "credential" else hit

    hits = F.array_compact(F.array(*[F.when(fires(p), F.lit(p.name)) for p in patterns]))
    return prepared.select(*keys, "line_number", s["line"].alias("line"), F.explode(hits).alias("pattern"))


def describe(hits: DataFrame, level: str = "thorough", extra: list[Pattern] | None = None) -> DataFrame:
    """Severity, category, description and recommendation for each hit, looked up after the scan."""
    return hits.join(F.broadcast(pattern_catalog(hits.sparkSession, level, extra)), "pattern")


def redact(line: Column, pattern: Column, level: str = "thorough", extra: list[Pattern] | None = None) -> Column:
    """Sample of a line for a report: redacted as a whole first, then cut to 100 characters.

    All matches of the line's own pattern are replaced, then social security shapes, then long quoted texts. The expression of a
    pattern is looked up among constants, so the plan has three replacements, whatever the size of the catalogue.
    """
    known = F.create_map(*[F.lit(x) for p in active_patterns(level, extra) for x in (p.name, "(?i)" + p.regex)])
    out = F.regexp_replace(line, F.try_element_at(known, pattern), F.lit("[REDACTED]"))
    out = F.regexp_replace(out, r"\d{3}-\d{2}-\d{4}", "[SSN]")
    out = F.regexp_replace(out, r"""['"][^'"]{20,}['"]""", '"[REDACTED]"')

    def cut(safe: Column) -> Column:
        short = F.when(F.length(safe) > SAMPLE_CHARS, F.concat(F.substring(safe, 1, SAMPLE_CHARS), F.lit("..."))).otherwise(safe)
        return F.btrim(short, F.lit(" \t\r\n\f\u000b"))

    return F.get(F.transform(F.array(out), cut), F.lit(0))


def findings(
    lines: DataFrame,
    keys: list[str],
    level: str = "standard",
    comment_aware: bool = True,
    extra: list[Pattern] | None = None,
) -> DataFrame:
    """Complete finding rows: where, which pattern, what it means and a redacted sample."""
    hits = scan_lines(lines, keys, level, comment_aware, extra)
    sampled = hits.select(
        *keys, "line_number", "pattern", redact(F.col("line"), F.col("pattern"), level, extra).alias("data_sample")
    )
    return describe(sampled, level, extra)


def scan_repository(files: DataFrame, level: str = "standard", extra: list[Pattern] | None = None) -> DataFrame:
    """Findings of all scannable files, comment lines respected."""
    lines = explode_lines(scannable_files(files), ["repo", "path"], "content")
    return findings(lines, ["repo", "path"], level, True, extra)


def scan_content(
    df: DataFrame, keys: list[str], text: str, level: str = "standard", extra: list[Pattern] | None = None
) -> DataFrame:
    """Findings of any text column; comment lines are scanned like all others."""
    lines = explode_lines(text_source(df, keys, text), keys, "content")
    return findings(lines, keys, level, False, extra)


def has_blocker(text: Column, level: str = "standard", extra: list[Pattern] | None = None) -> Column:
    """Whether a text holds a critical or high finding: answered inside the row, without a join.

    A pattern that matches on a line matches somewhere in the whole text, so
    the whole text is asked first. Only a text that passes is cut into lines,
    to rule out matches that run across a line break.
    """
    patterns = [p for p in active_patterns(level, extra) if p.severity in ("critical", "high")]

    def any_match(s: Column) -> Column:
        return reduce(lambda a, b: a | b, [_matches(s, p) for p in patterns])

    def on_a_line(s: Column) -> Column:
        return F.exists(F.transform(text_lines(s["line"]), lambda line: _line_traits(line)), any_match)

    return F.exists(F.array(_line_traits(text)), lambda s: any_match(s) & on_a_line(s))


def ai_safe_rows(corpus: DataFrame, text: str, level: str = "standard") -> DataFrame:
    """Rows whose text has no critical or high finding. A null text has none."""
    return corpus.filter(~F.coalesce(has_blocker(F.col(text), level), F.lit(False)))


def redact_corpus(df: DataFrame, text: str, level: str = "standard", extra: list[Pattern] | None = None) -> DataFrame:
    """A full copy of the column with the matches of every active pattern replaced, line by line.

    Lines on which nothing fires are kept as they are, so the cost follows the
    number of hits and not the size of the catalogue.
    """
    patterns = active_patterns(level, extra)

    def clean(s: Column) -> Column:
        out = s["line"]
        for p in patterns:
            out = F.regexp_replace(out, "(?i)" + p.regex, "[REDACTED]")
        hit = reduce(lambda a, b: a | b, [_matches(s, p) for p in patterns])
        return F.when(hit, out).otherwise(s["line"])

    parts = F.split(F.col(text), "\n", -1)
    return df.withColumn(text, F.array_join(F.transform(F.transform(parts, lambda line: _line_traits(line)), clean), "\n"))
