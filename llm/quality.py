"""Quality of whole texts by boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.boosting import Trees, fit
from llm.common import ragged, segment_sum, text_chunks, written

SAMPLE_ROWS = 20_000
SLICE_BYTES = 1 << 20  # of texts measured at once
THRESHOLD = 0.7


def _bytes(chars: bytes | range) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[list(chars)] = 1
    return table


KINDS = {
    "lower": _bytes(range(97, 123)), "upper": _bytes(range(65, 91)), "digit": _bytes(range(48, 58)), "beyond": _bytes(range(128, 256)),
    "blank": _bytes(b" \t\r\x0b\x0c"), "line": _bytes(b"\n"), "stop": _bytes(b".!?"), "shout": _bytes(b"!"), "pause": _bytes(b",;:'\"()-"),
    "symbol": _bytes(b"#$%&*+/<=>@[\\]^_`{|}~"),
}


def share_of_repeats(owner: np.ndarray, value: np.ndarray, texts: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many of its values are not new in it, and how often its most frequent value occurs, as shares."""
    key, times = np.unique(owner * (int(value.max(initial=0)) + 1) + value, return_counts=True)
    text = key // (int(value.max(initial=0)) + 1)
    top = np.zeros(texts)
    np.maximum.at(top, text, times)
    return 1 - np.bincount(text, minlength=texts) / counts, top / counts


def statistics(text: pa.Array) -> np.ndarray:
    """One row of numbers for each text; an empty text has zeros."""
    text = text.cast(pa.large_string())
    n = len(text)
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
    raw = text.buffers()[2]
    data = (np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8))[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    size = np.diff(bounds)
    one = np.maximum(size, 1)
    by_kind = {k: segment_sum(table[data], bounds) for k, table in KINDS.items()}
    letters = np.maximum(by_kind["lower"] + by_kind["upper"] + by_kind["beyond"], 1)
    words, offsets = ragged(pc.ascii_split_whitespace(text))
    kinds = words.dictionary_encode()
    at, own = np.asarray(kinds.indices), kinds.dictionary
    real = np.asarray(pc.binary_length(own))[at] > 0
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    at = at[real]
    count = np.diff(offsets)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    per_word = lambda values: segment_sum(np.asarray(values, dtype=np.float32)[at], offsets) / some
    matches = lambda pattern: per_word(pc.match_substring_regex(own, pattern).to_numpy(zero_copy_only=False))
    same = np.zeros(len(at), dtype=np.float32)
    same[1:] = (at[1:] == at[:-1]) & (owner[1:] == owner[:-1])
    repeated, top = share_of_repeats(owner, at.astype(np.int64), n, some)
    pairs = (owner[1:] == owner[:-1]) & (at[1:] != at[:-1])
    pair = at[:-1][pairs].astype(np.int64) * (len(own) + 1) + at[1:][pairs]
    pair = np.unique(pair, return_inverse=True)[1]
    pair_count = np.bincount(owner[1:][pairs], minlength=n)
    again, _ = share_of_repeats(owner[1:][pairs], pair, n, np.maximum(pair_count, 1))
    lines, line_offsets = ragged(pc.split_pattern(text, "\n"))
    line_kinds = lines.dictionary_encode()
    line_count = np.diff(line_offsets)
    line_owner = np.repeat(np.arange(n), line_count)
    line_again, _ = share_of_repeats(line_owner, np.asarray(line_kinds.indices).astype(np.int64), n, np.maximum(line_count, 1))
    columns = [
        np.log1p(size), np.log1p(count), segment_sum(np.asarray(pc.binary_length(own), dtype=np.float32)[at], offsets) / some,
        by_kind["upper"] / letters, by_kind["digit"] / one, by_kind["beyond"] / letters, by_kind["blank"] / one, by_kind["line"] / some,
        by_kind["stop"] / some, by_kind["shout"] / some, by_kind["pause"] / some, by_kind["symbol"] / some,
        repeated, repeated / np.log1p(some), top, segment_sum(same, offsets) / some, np.where(pair_count, again, 0), line_again, line_count / some,
        matches(r"[#$%&*+/<=>@\[\]^_`{|}~\\]$"), matches(r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]+$"), matches(r"^[A-Z]"), matches(r"^[^a-z]*[A-Z][^a-z]+$"), matches(r"^.{1,3}$"),
    ]
    return np.where((size > 0)[:, None], np.stack(columns, axis=1), 0).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents at most, chosen by the hash of their id.

    ``usable`` (over doc_id) says which may be learned from. A document labelled more than once has its highest label;
    null labels and ids are left out. The chosen labels are bounded by ``rows``, so they go to every task and no text
    is shuffled.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(usable)
    total = known.count()
    share = min(1.0, rows / max(1, total))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    chosen = written(chosen.groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on the statistics of at most about ``rows`` labelled documents; only these statistics reach the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_chunks(batches, SLICE_BYTES):
            raw = pa.array([row.tobytes() for row in statistics(text)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), raw], ["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, label, usable, rows)
    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sorted((r.doc_id, r.x, r.label) for r in sample.mapInArrow(measure, f"doc_id {kind}, label int, x binary").collect())
    x = np.array([np.frombuffer(x, dtype=np.float32) for _, x, _ in found]) if found else np.zeros((0, 1), np.float32)
    return fit(x, np.array([float(y > 0) for *_, y in found]))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score for each row of ``docs``: how likely its quality is 1, from its text alone.

    Other columns are ignored and repeated rows are scored each. Null and empty texts have zeros for statistics; a
    model learned without labels gives one half. Tasks get the trees, whose size is fixed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in text_chunks(batches, SLICE_BYTES):
            found = statistics(text)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.predict(found[:, : len(model.edges)]))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, unchanged and in one pass over them."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in text_chunks(batches, SLICE_BYTES):
            good = model.predict(statistics(text)[:, : len(model.edges)]) >= threshold
            yield rows.filter(pa.array(good))

    return docs.mapInArrow(run, schema)
