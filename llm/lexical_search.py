"""Ranked lexical search by impact-sorted lists without random access (NRA).

Texts are read once: every document keeps the query terms that it has, with their counts. Documents are then searched
shard by shard. In a shard each term has a list of (impact, document), highest impact first. The lists of an item's
terms are read in step down to a falling impact; every document met has a lower bound, what was read of it, and an upper
bound, which adds for each list without it the impact that comes next there. Reading goes on until no unread document can
enter, and every document that may still belong has equal bounds, so that members, ties and scores are exact. The best scores of
earlier shards of a task are the first hurdle of the next one; the last step ranks what is left of each task.

Items are taken in blocks of a bounded number of terms, so that what tasks receive does not grow with the item table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import text_chunks, written

BEST = 10
BLOCK_TERMS = 1 << 19  # terms of the items that are searched together
PIECE_BYTES = 8 << 20
FALL = 4  # each step reads down to this part of the impact before

# Bytes of terms: digits, letters and everything beyond ASCII; A-Z are lower-cased.
TERM = np.zeros(256, dtype=bool)
TERM[[*b"0123456789", *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts and the offset of each text in them."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts between ``bounds`` in order, and where each starts."""
    inside = TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]  # a term does not go on in the next text
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.empty(2 * len(starts), dtype=np.int64)
    cuts[::2], cuts[1::2] = starts, stops
    spans = pa.LargeStringArray.from_buffers(max(len(cuts) - 1, 0), pa.py_buffer(cuts), pa.py_buffer(LOWER[data])) if len(cuts) else pa.array([], pa.large_string())
    return spans.take(pa.array(np.arange(0, max(len(cuts) - 1, 0), 2))), starts


def pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``PIECE_BYTES`` that end between terms, so that a very long text is not held as terms at once."""
    start = 0
    while start < len(data):
        stop = min(start + PIECE_BYTES, len(data))
        while stop < len(data) and TERM[data[stop]] and TERM[data[stop - 1]]:
            stop += 1
        yield start, stop
        start = stop


def counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; then (text, number of the term, times) for those of ``vocabulary``, by text and number."""
    data, bounds = bytes_of(texts)
    length = np.zeros(len(texts), dtype=np.int64)
    width = len(vocabulary) + 1
    keys, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for start, stop in pieces(data, bounds):
        found, at = terms(data[start:stop], bounds - start)
        owner = np.searchsorted(bounds, at + start, side="right") - 1
        length += np.bincount(owner, minlength=len(texts))
        number = pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        key, count = np.unique(owner[number >= 0] * width + number[number >= 0], return_counts=True)
        keys.append(key)
        times.append(count)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), dtype=np.int64)
    np.add.at(total, where, np.concatenate(times))
    return length, key // width, key % width, total


def indexed(docs: DataFrame, vocabulary: pa.Array, key: str) -> DataFrame:
    """(key, n, terms, times, held): a row for each document with terms, and one for each task with the documents that hold each term."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n", "terms", "times", "held"]

    def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = np.zeros(len(vocabulary), dtype=np.int64), pa.null()
        for batch, text in text_chunks(batches):
            ids = batch.column("key").type
            length, owner, number, times = counted(text, vocabulary)
            held += np.bincount(number, minlength=len(vocabulary))
            some = np.flatnonzero(length)
            offsets = np.append(np.searchsorted(owner, some), len(owner))
            cells = [lists(number, offsets, pa.int32()), lists(times, offsets, pa.int64()), pa.nulls(len(some), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some)), pa.array(length[some]), *cells], names)
        seen = np.flatnonzero(held)
        if len(seen):
            whole = np.array([0, len(seen)])
            cells = [lists(seen, whole, pa.int32()), pa.nulls(1, pa.list_(pa.int64())), lists(held[seen], whole, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, ids), pa.nulls(1, pa.int64()), *cells], names)

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, n long, terms array<int>, times array<long>, held array<long>")


class Lists:
    """Impact-sorted lists of one shard: for each term its documents, those with the highest share first."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: int, documents: int, length: int):
        found = batch.column("terms")
        offsets = np.asarray(found.offsets, dtype=np.int64)
        number = np.asarray(found.flatten(), dtype=np.int64)
        times = np.asarray(batch.column("times").flatten(), dtype=np.int64)
        n = np.asarray(batch.column("n"), dtype=np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(offsets))
        measure = 25 + (75 * n * documents) // length
        share = (1_000_000_000 * times) // (1000 * times + 8 * measure[doc])  # at most a million
        order = np.argsort((number << 20) + ((1 << 20) - 1 - share), kind="stable")
        self.doc, self.share, self.size = doc[order], share[order], len(n)
        self.bounds = np.searchsorted(number[order], np.arange(vocabulary + 1))


def resolved(lists: Lists, number: np.ndarray, gain: np.ndarray, k: int, hurdle: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard that are among its ``k`` best and reach ``hurdle``, ties at the last place included, with exact scores.

    ``gain`` is what a share of one counts in each list ``number``. Only sequential reads: a list is never searched for a document.
    """
    start, stop = lists.bounds[number], lists.bounds[number + 1]
    some = (stop > start) & (gain > 0)
    start, stop, gain = start[some], stop[some], gain[some]
    lower = np.zeros(lists.size, dtype=np.int64)
    read = start.copy()
    entries, owners = [], []
    least = int((gain * lists.share[start]).max(initial=0))
    while True:
        least //= FALL
        for i in range(len(gain)):
            own = lists.share[read[i] : stop[i]]
            more = int(np.searchsorted(-own, -(least // gain[i] + 1), side="right")) if least else len(own)
            if more:
                at = slice(read[i], read[i] + more)
                lower[lists.doc[at]] += gain[i] * lists.share[at]  # a list has a document once
                entries.append(lists.doc[at])
                owners.append(np.full(more, i))
                read[i] += more
        next_one = np.zeros(len(gain), dtype=np.int64)
        left = read < stop
        next_one[left] = gain[left] * lists.share[read[left]]
        unread = int(next_one.sum())  # what a document can have at most that was not met yet
        if np.count_nonzero(lower) >= k:
            hurdle = max(hurdle, int(np.partition(lower, -k)[-k]))
        if not unread:
            break
        if unread < hurdle:
            may = lower + unread >= hurdle
            if not may.any():
                break
            doc, owner = np.concatenate(entries), np.concatenate(owners)
            of = may[doc]
            seen = np.zeros(lists.size, dtype=np.int64)
            np.add.at(seen, doc[of], next_one[owner[of]])
            upper = lower + unread - seen
            may &= upper >= hurdle
            if (upper[may] == lower[may]).all():
                break
    best = np.flatnonzero((lower >= max(hurdle, 1)))
    return best, lower[best]


def search(docs: DataFrame, items: DataFrame, best: int = BEST, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """item_key, rank, key, score: the ``best`` documents of each row of ``items`` with a score above 0, exact.

    Both tables need their key and ``text``, other columns are ignored. Equal scores rank by the smaller key, null last. Rows that
    repeat a document id are documents each; rows that repeat an item id are ranked each by itself; a null item id is
    kept. Null and empty texts have no terms: such documents count nowhere and such items find nothing.
    """
    numbered = written(items.select(F.col(item_key).alias("item"), "text", F.monotonically_increasing_id().alias("row")), "search-items")
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((docs, key), (items, item_key))}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_chunks(batches):
            data, bounds = bytes_of(text)
            found, at = terms(data, bounds)
            owner = np.searchsorted(bounds, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner)), found.cast(pa.string())], ["row", "term"])

    asked = written(numbered.mapInArrow(cut, "row long, term string").groupBy("row", "term").agg(F.count("*").alias("times")), "search-terms")
    count = -(-asked.count() // BLOCK_TERMS)
    found = [one_block(docs, asked.filter(F.pmod(F.xxhash64("row"), F.lit(count)) == block), best, key) for block in range(count)]
    if not found:
        return docs.sparkSession.createDataFrame([], f"{item_key} {kinds[item_key]}, rank int, {key} {kinds[key]}, score long")
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    # First within groups of tasks, then in all: no item's candidates of all tasks meet in one sort.
    order = [F.desc("score"), F.asc_nulls_last("key")]
    near = every.withColumn("place", F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))).filter(F.col("place") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(numbered.select("row", "item"), "row").select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def one_block(docs: DataFrame, asked: DataFrame, best: int, key: str) -> DataFrame:
    """(row, part, key, score): candidates of the items in ``asked`` (row, term, times), at most a few more than ``best`` from each task."""
    wanted = sorted(asked.collect())
    names = sorted({r.term for r in wanted})
    at = {term: i for i, term in enumerate(names)}
    vocabulary = pa.array(names, pa.large_string())
    index = written(indexed(docs, vocabulary, key), "search-index")
    documents, length = index.filter("n is not null").agg(F.count("*"), F.sum("n")).first()
    held = np.zeros(len(names), dtype=np.int64)
    per_task = index.filter("held is not null").select(F.explode(F.arrays_zip("terms", "held")).alias("x"))
    for r in per_task.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.held").alias("held")).collect():
        held[r.term] = r.held
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], dtype=np.int64)
    queries: dict[int, tuple[list, list]] = {}
    for r in wanted:
        number, gain = queries.setdefault(r.row, ([], []))
        number.append(at[r.term])
        gain.append(int(weight[at[r.term]]) * r.times)
    queries = {row: (np.array(number), np.array(gain, dtype=np.int64)) for row, (number, gain) in queries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}
        ids = None
        for batch in batches:
            ids = batch.column("key").type
            lists = Lists(batch, len(names), documents, length)
            for row, (number, gain) in queries.items():
                own = kept.get(row, [])
                hurdle = -own[-1][0] if len(own) == best else 0
                doc, score = resolved(lists, number, gain, best, hurdle)
                if len(doc):
                    keys = batch.column("key").take(pa.array(doc)).to_pylist()
                    both = own + [(-s, d is None, d) for s, d in zip(score.tolist(), keys, strict=True)]
                    kept[row] = sorted(both, key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:best]
        if kept:
            rows = [(row, d, -s) for row, own in kept.items() for s, _, d in own]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), ids, pa.int64()), strict=True)], ["row", "key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    found = index.filter("n is not null").select("key", "n", "terms", "times").mapInArrow(run, f"row long, key {kind}, score long")
    groups = max(1, round(found.rdd.getNumPartitions() ** 0.5))
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups)))
