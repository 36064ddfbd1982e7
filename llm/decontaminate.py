"""Benchmark decontamination over a distributed positional inverted index.

The index keeps the postings of every benchmark term, by document: the words of a text at their positions, with a hole
where a word is no benchmark term. Turned by term, that is a list of (row, position). A benchmark item whose first word
stands at position ``shift`` of a document has each of its words at ``shift`` plus the word's offset, so the lists of an
item are adjusted by their offsets and intersected on (row, shift):

1. the list of each window's rarest term gives the first candidates,
2. the list of its second rarest term is intersected with them,
3. for the few that are left, the lists of all words of the item are; ``size`` neighbouring words on one shift are an
   exact phrase.

The two rarest terms of an item within ``slop`` words of each other are a proximity match, for reworded leaks.

Everything is DataFrame operations. Small tables are joined as measured: sent to every task while small, shuffled beyond
that. A bit map of 2^16 to 2^20 slots, eight for each term as far as that goes, keeps words that are no benchmark terms
out of the index; false hits of the map fall away in the joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import ascii_lower, written

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 20
SLOTS_PER_TERM = 8


def tokens(text: Column) -> Column:
    """Words of a text: digits, letters and all characters beyond ASCII; A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def bodies(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different word lists of the benchmark, (body, words), and the items that have them, (item_id, body).

    Items without id or without words take no part; an id that repeats has several bodies.
    """
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", tokens(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = written(items.distinct(), "items")
    lists = written(items.select("words").distinct().select(F.monotonically_increasing_id().alias("body"), "words"), "bodies")
    return lists, written(items.join(lists, "words").select("item_id", "body"), "names")


def slot(term: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")


def is_benchmark_term(terms: DataFrame) -> Callable[[Column], Column]:
    """Test of a word against a map with one byte for each slot; at most ``MOST_SLOTS`` of them come to the driver."""
    slots = LEAST_SLOTS
    wished = SLOTS_PER_TERM * terms.count()
    while slots < min(wished, MOST_SLOTS):
        slots *= 2
    flags = np.zeros(slots, dtype=np.uint8)
    flags[terms.select(slot(F.col("term"), slots).alias("slot")).distinct().toArrow()["slot"].to_numpy()] = 1
    return lambda w: F.substring(F.lit(flags.tobytes()), slot(w, slots) + 1, F.lit(1)) == F.lit(b"\x01")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row (a number), doc_id, row_key (hash of the text), n_words and the positional words."""
    known = is_benchmark_term(terms)
    base = docs.select("doc_id", F.xxhash64("text").alias("row_key"), tokens(F.col("text")).alias("w"))
    held = F.transform("w", lambda w: F.when(known(w), w))
    return base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "row_key", F.size("w").cast("long").alias("n_words"), held.alias("words"))


def postings(indexed: DataFrame) -> DataFrame:
    """The lists of an index: (row, pos, term), positions from 0."""
    return indexed.select("row", F.posexplode("words").alias("pos", "term")).filter(F.col("term").isNotNull())


def term_counts(indexed: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (term) occurs in the corpus: rows (term, n), without those that never do."""
    return postings(indexed).groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def rarest(lists: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Rarest and second rarest word of each window: distinct (body, q1, t1, q2, t2) with their offsets in the body.

    A window with a word that never occurs is left out; a window of one word has it twice.
    """
    n, need = F.size("words"), F.least(F.size("words"), F.lit(size))
    placed = lists.select("body", n.alias("len"), need.alias("need"), F.posexplode("words").alias("q", "term")).join(counts, "term")
    windows = F.sequence(F.greatest(F.col("q") - F.col("need") + 1, F.lit(0)), F.least("q", F.col("len") - F.col("need")))
    by_window = placed.select("body", "need", "q", "term", "n", F.explode(windows).alias("window")).groupBy("body", "window", "need")
    ranked = by_window.agg(F.array_sort(F.collect_list(F.struct("n", "term", "q"))).alias("r")).filter(F.size("r") == F.col("need"))
    first, second = F.col("r")[0], F.coalesce(F.get("r", F.lit(1)), F.col("r")[0])
    return ranked.select("body", first["q"].alias("q1"), first["term"].alias("t1"), second["q"].alias("q2"), second["term"].alias("t2")).distinct()


def phrase_matches(indexed: DataFrame, lists: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Stretches of ``size`` or more words that a document and an item share (all words of a shorter item).

    Rows (row, body, start, stop): the words ``start`` up to, without, ``stop`` of the document's row. A window of
    the item occurs in the document exactly where it lies within a stretch.
    """
    pairs = written(rarest(lists, counts, size), "rarest-terms")
    wanted = pairs.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    rare = written(postings(indexed).join(wanted, "term", "left_semi"), "rare-postings")
    first = rare.join(pairs, rare.term == pairs.t1).select("row", "body", (F.col("pos") - F.col("q1")).alias("shift"), "q2", "t2")
    second = rare.select(F.col("row").alias("row2"), F.col("pos").alias("pos2"), F.col("term").alias("term2"))
    both = (F.col("row") == F.col("row2")) & (F.col("shift") + F.col("q2") == F.col("pos2")) & (F.col("t2") == F.col("term2"))
    shifts = written(first.join(second, both).select("row", "body", "shift").distinct(), "shifts")

    expected = shifts.join(lists, "body").select("row", "body", "shift", F.size("words").alias("len"), F.posexplode("words").alias("q", "term"))
    expected = expected.withColumn("pos", F.col("shift") + F.col("q"))
    found = postings(indexed.join(shifts.select("row").distinct(), "row", "left_semi"))
    hits = expected.join(found, ["row", "pos", "term"])
    # Neighbouring offsets on one shift have the same difference to their rank.
    rank = F.row_number().over(Window.partitionBy("row", "body", "shift").orderBy("q"))
    runs = hits.withColumn("run", F.col("q") - rank).groupBy("row", "body", "shift", "len", "run").agg(F.min("q").alias("a"), F.max("q").alias("b"))
    long = runs.filter(F.col("b") - F.col("a") + 1 >= F.least("len", F.lit(size)))
    return long.select("row", "body", (F.col("shift") + F.col("a")).alias("start"), (F.col("shift") + F.col("b") + 1).alias("stop"))


def near_matches(indexed: DataFrame, lists: DataFrame, counts: DataFrame, slop: int) -> DataFrame:
    """Places where the two rarest different terms of a body, of those the corpus has, stand within ``slop`` words.

    Rows (row, body, first, second). Bodies with fewer than two such terms have none. Positions meet by stretches of
    ``slop`` + 1 words, so a frequent term costs its postings times ``slop`` at most.
    """
    own = lists.select("body", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term")
    two = own.groupBy("body").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term"))), 1, 2)["term"].alias("t")).filter(F.size("t") == 2)
    two = written(two.select("body", F.col("t")[0].alias("t1"), F.col("t")[1].alias("t2")), "near-terms")
    wanted = two.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    stretch = F.floor(F.col("pos") / (slop + 1))
    rare = written(postings(indexed).join(wanted, "term", "left_semi").withColumn("stretch", stretch), "near-postings")
    around = F.explode(F.array(*[F.col("stretch") + d for d in (-1, 0, 1)])).alias("stretch")
    first = rare.join(two, rare.term == two.t1).select("row", "body", F.col("t2").alias("term"), F.col("pos").alias("first"), around)
    second = rare.select("row", "term", "stretch", F.col("pos").alias("second"))
    return first.join(second, ["row", "term", "stretch"]).filter(F.abs(F.col("first") - F.col("second")) <= slop).select("row", "body", "first", "second")


def covered(matches: DataFrame) -> DataFrame:
    """Words inside any match of each row: (row, n_hit), by merging the matches in order of their start."""
    spans = matches.groupBy("row", "start").agg(F.max("stop").alias("stop"))
    earlier = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(earlier), F.lit(0))
    new = spans.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached)))
    return new.groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))


def item_lists(matches: DataFrame, names: DataFrame, alias: str) -> DataFrame:
    """Sorted ids, as strings, of the items that each row matches."""
    pairs = matches.select("row", "body").distinct().join(names, "body")
    return pairs.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias(alias))


def prepared(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Index, bodies, names of the items and counts of the benchmark's terms."""
    lists, names = bodies(benchmark)
    terms = written(lists.select(F.explode("words").alias("term")).distinct(), "terms")
    indexed = written(index(docs.select("doc_id", "text"), terms), "index")
    return indexed, lists, names, written(term_counts(indexed, terms), "term-counts")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 20) -> DataFrame:
    """Places where an item's two rarest different terms stand within ``slop`` words: (doc_id, item_id, first, second).

    Only terms that occur count. Items with fewer than two of them have no matches, nor have null and empty texts; equal
    rows of ``docs`` give a place once.
    """
    indexed, lists, names, counts = prepared(docs, benchmark)
    near = near_matches(indexed, lists, counts, slop)
    return near.join(names, "body").join(indexed.select("row", "doc_id"), "row").select("doc_id", "item_id", "first", "second").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int | None = None) -> DataFrame:
    """Overlap of each document with the benchmark: doc_id, row_key, n_words, n_hit, items (sorted item ids as strings).

    With ``slop``, also ``near``: items whose two rarest terms stand within so many words of each other.

    Needs doc_id and text, item_id and text; other columns are ignored, whatever their names. One row per row of
    ``docs``: null and empty texts have no words and no hits; rows that repeat an id and a text get the same result,
    different texts under one id are separate, and a null id is an id like any other. An empty benchmark hits nothing.
    """
    indexed, lists, names, counts = prepared(docs, benchmark)
    found = written(phrase_matches(indexed, lists, counts, size), "matches")
    none = F.array().cast("array<string>")
    result = indexed.drop("words").join(covered(found), "row", "left").join(item_lists(found, names, "items"), "row", "left")
    columns = ["doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")]
    if slop is not None:
        result = result.join(item_lists(near_matches(indexed, lists, counts, slop), names, "near"), "row", "left")
        columns.append(F.coalesce("near", none).alias("near"))
    return result.select(*columns)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` that no window of the benchmark occurs in."""
    hit = written(decontaminate(docs, benchmark, size).filter("n_hit > 0").select("doc_id", "row_key").distinct(), "contaminated").alias("h")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key"))
    same = (F.col("key") == F.col("h.row_key")) & F.col("row.doc_id").eqNullSafe(F.col("h.doc_id"))
    return keyed.join(hit, same, "left_anti").select("row.*")


def digest(result: DataFrame) -> DataFrame:
    """The columns that stand for a document in a report: counts, and a hash of the item ids."""
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )
