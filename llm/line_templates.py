"""Line dedup by a log-template tree: lines that recur across documents but for variable fields are dropped.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens, where a token with digits is a
variable field. In a leaf, a token is constant at its position if enough documents have it there, and a variable field
otherwise; a line with its variable fields left open is its template. A template that enough documents share, and that
is mostly constant, is boilerplate.

How many documents are enough is judged on several levels: a fixed number, and shares of the leaf's documents. On the
first, a field of few values is read as constants; on the others, a value that recurs only because there are many
documents is left open, so that what happens to a line does not depend on the size of the corpus. A line goes if its
template on any level recurs.

A line of few tokens has no template worth the name: it goes if the line as it is recurs in many documents, a share of
the table's rows.

Everything is sums and joins over leaves, positions and templates, so no leaf is ever held in one place. Only hashes of
lines are shuffled to find the leaves that several documents reach; the words of a line are looked at in those alone, and
a filter on these hashes keeps the other lines from being shuffled or taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.sources.tables import likely_among
from llm.common import written

DEPTH = 3  # leading tokens that lead to a leaf
LEAST_TOKENS = 5  # of a line with a template
SHORT_DOCUMENTS, SHORT_SHARE = 20, 200  # a shorter line goes if as it is it is in so many documents, and in one of so many rows of the table
LEAST_DOCUMENTS = 3
LEAST_CONSTANT = 0.6  # share of a template's tokens
DIVISORS = (50, 10, 2)  # levels: a constant is in one of so many documents of its leaf, and in LEAST_DOCUMENTS
FIELD = "<*>"


def tokens(line: Column) -> Column:
    """Runs of characters other than blanks; a line seldom has a blank that is not a space."""
    plain = F.when(line.rlike(r"[\x09\x0B-\x0D]"), F.regexp_replace(line, r"[\x09-\x0D]", " ")).otherwise(line)
    return F.array_remove(F.split(plain, " "), "")


def masked(found: Column) -> Column:
    return F.transform(found, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def lines(docs: DataFrame, least_tokens: int) -> DataFrame:
    """(doc_id, row_key, line, leaf) of each line that is not blank; ``line`` is a hash of its text, ``leaf`` null for a line of few tokens."""
    cut = F.transform(F.split("text", "\n"), lambda t: F.struct(F.xxhash64(t).alias("line"), tokens(t).alias("words")))
    full = F.filter(cut, lambda x: F.size(x["words"]) > 0)
    leaf = lambda words: F.when(F.size(words) >= least_tokens, F.xxhash64(F.size(words), masked(F.slice(words, 1, DEPTH))))
    placed = F.transform(full, lambda x: F.struct(x["line"].alias("line"), leaf(x["words"]).alias("leaf")))
    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.inline(placed))


def recurring(docs: DataFrame, least_tokens: int = LEAST_TOKENS, least_documents: int = LEAST_DOCUMENTS, least_constant: float = LEAST_CONSTANT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, line) to be dropped, and the templates they have, one or more a line: (line, template, documents)."""
    docs = docs.select("doc_id", "text")
    all_rows = written(lines(docs, least_tokens).distinct(), "line-rows")
    rows, short = all_rows.filter("leaf IS NOT NULL"), all_rows.filter("leaf IS NULL")
    counts = written(rows.groupBy("leaf", "line").agg(F.count("*").alias("docs")), "line-counts")
    leaves = written(counts.groupBy("leaf").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_documents), "line-leaves")
    wanted = written(counts.join(leaves, "leaf").select("leaf", "line", "docs", F.col("n").alias("total")), "line-wanted")
    texts = docs.select(F.explode(F.split("text", "\n")).alias("text")).select(F.xxhash64("text").alias("line"), "text")
    texts = texts.filter(likely_among(wanted.select("line"), ["line"])).groupBy("line").agg(F.max("text").alias("text"))
    held = wanted.join(texts, "line").select("leaf", "line", "docs", "total", masked(tokens(F.col("text"))).alias("words"))
    held = written(held, "line-words")
    places = held.select("leaf", "line", "docs", "total", F.posexplode("words").alias("pos", "word"))
    common = places.filter(F.col("word") != FIELD).groupBy("leaf", "pos", "word").agg(F.sum("docs").alias("n"), F.first("total").alias("total")).filter(F.col("n") >= least_documents)
    level = sum((F.col("n") * d >= F.col("total")).cast("int") for d in DIVISORS)
    # Constants of each line, and up to which level they are; what is not among them is a variable field.
    fixed = places.join(common.select("leaf", "pos", "word", level.alias("level")), ["leaf", "pos", "word"]).groupBy("leaf", "line").agg(F.array_sort(F.collect_list(F.struct("pos", "level"))).alias("fixed"))
    enough = lambda at: F.size(at) >= F.lit(least_constant) * F.size("words")
    known = held.join(fixed, ["leaf", "line"]).filter(enough(F.col("fixed")))
    levels = F.array(*(F.filter("fixed", lambda x: x["level"] >= k)["pos"] for k in range(len(DIVISORS) + 1)))
    known = known.select("leaf", "line", "words", F.explode(F.array_distinct(F.filter(levels, enough))).alias("at"))
    word = lambda w, i: F.when(F.array_contains("at", i), w).otherwise(F.lit(FIELD))
    named = known.select("leaf", "line", F.array_join(F.transform("words", word), " ").alias("template"))
    named = written(named, "line-templates")
    pairs = rows.join(named, ["leaf", "line"])
    shared = pairs.select("leaf", "template", "doc_id", "row_key").distinct().groupBy("leaf", "template").agg(F.count("*").alias("documents"))
    shared = written(shared.filter(F.col("documents") >= least_documents), "line-shared")
    enough_short = F.greatest(F.lit(SHORT_DOCUMENTS), F.ceil(F.lit(docs.count()) / SHORT_SHARE))
    often = written(short.groupBy("line").agg(F.count("*").alias("documents")).filter(F.col("documents") >= enough_short), "line-short")
    gone = pairs.join(shared, ["leaf", "template"]).select("doc_id", "row_key", "line").distinct()
    gone = gone.unionByName(short.join(often, "line").select("doc_id", "row_key", "line"))
    return gone, named.join(shared, ["leaf", "template"]).select("line", "template", "documents")


def drop_recurring(docs: DataFrame, least_tokens: int = LEAST_TOKENS, least_documents: int = LEAST_DOCUMENTS, least_constant: float = LEAST_CONSTANT) -> DataFrame:
    """doc_id, text without recurring lines, n_lines and n_dropped for each row of ``docs``.

    Lines end at a line feed. Needs doc_id and text, other columns are ignored. A null text stays null and an empty one
    empty; rows that repeat an id and a text are one document, different texts under one id are several; a null id is
    an id. A text whose lines all go becomes empty.
    """
    gone, _ = recurring(docs, least_tokens, least_documents, least_constant)
    drops = written(gone.groupBy("doc_id", "row_key").agg(F.collect_set("line").alias("drops")), "line-drops").alias("g")
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key")).alias("d")
    both = d.join(drops, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.row_key") == F.col("g.row_key")), "left")
    cut = F.split("text", "\n")
    kept = F.when(F.col("drops").isNull(), cut).otherwise(F.filter(cut, lambda x: ~F.array_contains("drops", F.xxhash64(x))))
    result = both.select("d.doc_id", "text", cut.alias("cut"), kept.alias("kept"))
    n_lines = F.coalesce(F.size("cut"), F.lit(0))
    return result.select(
        "doc_id", F.array_join("kept", "\n").alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines - F.size("kept")).cast("long").alias("n_dropped"),
    )
