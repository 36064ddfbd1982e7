"""Language of whole texts, and the spans of mixed ones.

Each word is scored under every language by its letter trigrams. The scripts of its letters first narrow the candidates
to the languages that use them. A Viterbi pass over the words of a text, in which a change of language costs a penalty,
labels spans; the document's language is the one with most letters, insertions counting less.

A word whose best language leads every other by more than two penalties has that label on any best path. The pass is
therefore cut at such words into short independent runs, which all advance together as rows of one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import code_points, mix64, ragged, segment_sum, text_chunks

# First and last code points of the scripts told apart; other letters share one number of their own.
SCRIPTS = [
    (0x0041, 0x024F), (0x0370, 0x03FF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0900, 0x097F),
    (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF),
    (0x0D00, 0x0D7F), (0x0D80, 0x0DFF), (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x10A0, 0x10FF), (0x1200, 0x137F),
    (0x1780, 0x17FF), (0x1E00, 0x1EFF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF),
]
SLOTS = 1 << 16  # trigram slots of a language
STRIPE = 1 << 12  # slots that are summed as one value
LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of the texts in lower case, the number of each word in turn, and where each text begins."""
    words, offsets = ragged(pc.utf8_split_whitespace(pc.utf8_lower(text)))
    kinds = words.dictionary_encode()
    return kinds.dictionary, np.asarray(kinds.indices), offsets


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: trigram slots (flat, with offsets), letters, and the script of its letters (-1: no letter).

    Trigrams run over the word's letters between two boundary marks; other characters are left out.
    """
    points, offsets = code_points(words)
    letter = LETTER[points]
    letters = segment_sum(letter, offsets).astype(np.int64)
    held = points[letter]
    ends = np.concatenate([[0], np.cumsum(letters)])
    script = np.full(len(held), len(SCRIPTS), dtype=np.int64)
    for number, (low, high) in enumerate(SCRIPTS):
        script[(held >= low) & (held <= high)] = number
    first = np.where(letters > 0, script[np.minimum(ends[:-1], max(len(held) - 1, 0))] if len(held) else -1, -1)
    # Each word with a mark on either side, so that it has as many trigrams as letters.
    padded = np.zeros(len(held) + 2 * len(letters), dtype=np.uint64)
    shift = 2 * np.arange(len(letters)) + 1
    padded[np.arange(len(held)) + np.repeat(shift, letters)] = held
    middle = np.arange(len(held)) + np.repeat(shift, letters)
    a, b, c = padded[middle - 1], padded[middle], padded[middle + 1]
    grams = mix64(a << np.uint64(42) | b << np.uint64(21) | c) % np.uint64(SLOTS)
    return grams.astype(np.int64), ends, letters, first


def add_up(counts: DataFrame) -> DataFrame:
    """Sum of the arrays of ``counts`` (lang, stripe, task, values) per language and stripe, first over groups of tasks."""
    groups = max(1, int(counts.rdd.getNumPartitions() ** 0.5))

    def total(keys: tuple, table: pa.Table) -> pa.Table:
        raw = table.column("values").combine_chunks()
        summed = np.sum([np.frombuffer(v.as_py(), dtype=np.int64) for v in raw], axis=0)
        return pa.table({"lang": table.column("lang").slice(0, 1), "stripe": table.column("stripe").slice(0, 1), "values": pa.array([summed.tobytes()], pa.binary())})

    schema = "lang string, stripe int, values binary"
    part = counts.groupBy("lang", "stripe", F.pmod("task", F.lit(groups)).alias("group")).applyInArrow(total, schema)
    return part.groupBy("lang", "stripe").applyInArrow(total, schema)


class Model:
    """Learned languages in order, log-likelihoods of trigram slots and the share of each script in their letters."""

    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.langs = langs
        grams, self.scripts = counts[:, :SLOTS].astype(np.float64) + smoothing, counts[:, SLOTS : SLOTS + len(SCRIPTS) + 1].astype(np.float64)
        self.logs = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
        self.scripts /= np.maximum(self.scripts.sum(axis=1, keepdims=True), 1)

    def scores(self, words: pa.Array, least_share: float) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word under each language, languages without its script ruled out; letters of each word."""
        grams, ends, letters, script = features(words)
        each = np.stack([segment_sum(one[grams], ends) for one in self.logs], axis=1).astype(np.float32)
        allowed = self.scripts.T[np.maximum(script, 0)] >= least_share
        allowed |= ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, each, -1e6), letters


def learn(docs: DataFrame, label: Column) -> Model:
    """Counts over all texts with a label. Each task adds up its own texts; languages times slots reach the driver."""
    width = SLOTS + STRIPE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, text in text_chunks(batches):
            lang = rows.column("lang").to_numpy(zero_copy_only=False)
            words, at, offsets = words_of(text)
            grams, ends, letters, script = features(words)
            for name in set(lang):
                chosen = np.repeat(lang == name, np.diff(offsets))
                times = np.bincount(at[chosen], minlength=len(words))
                own = sums.setdefault(name, np.zeros(width, dtype=np.int64))
                own[:SLOTS] += np.bincount(grams, weights=np.repeat(times, letters), minlength=SLOTS).astype(np.int64)
                own[SLOTS:] += np.bincount(np.maximum(script, 0), weights=times * letters, minlength=STRIPE).astype(np.int64)
        task = TaskContext.get().partitionId()
        rows = [(name, s // STRIPE, task, own[s : s + STRIPE].tobytes()) for name, own in sums.items() for s in range(0, width, STRIPE)]
        if rows:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "stripe", "task", "values"])

    labelled = docs.select(label.alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.mapInArrow(count, "lang string, stripe int, task int, values binary")
    table: dict[str, np.ndarray] = {}
    for row in add_up(counts).collect():
        table.setdefault(row.lang, np.zeros(width, dtype=np.int64))[row.stripe * STRIPE : (row.stripe + 1) * STRIPE] = np.frombuffer(row.values, dtype=np.int64)
    langs = sorted(table)
    return Model(langs, np.array([table[name] for name in langs]).reshape(len(langs), width))


def viterbi(scores: np.ndarray, at: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word in turn. ``scores``: per different word; ``at``: its number; ``offsets``: the texts."""
    n, labels = len(at), scores.shape[1]
    if n == 0 or labels == 1:
        return np.zeros(n, dtype=np.int64)
    best = scores.argmax(axis=1)
    two = np.partition(scores, -2, axis=1)
    fixed = (two[:, -1] - two[:, -2] > 2 * penalty)[at]
    start = fixed.copy()
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(start)
    length = np.diff(np.append(begin, n))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    first_of_text = np.zeros(n + 1, dtype=bool)
    first_of_text[offsets] = True
    value = scores[at[begin]].copy()
    sure = fixed[begin]
    value[sure] = np.where(np.arange(labels) == best[at[begin[sure]]][:, None], 0.0, -np.inf)
    back = np.zeros((n, labels), dtype=np.int16)
    alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
    for t in range(1, int(length[0])):
        rows = alive[t]
        where = begin[:rows] + t
        top = value[:rows].argmax(axis=1)
        moved = value[np.arange(rows), top] - penalty
        stay = value[:rows] >= moved[:, None]
        back[where] = np.where(stay, np.arange(labels), top[:, None])
        value[:rows] = np.where(stay, value[:rows], moved[:, None]) + scores[at[where]]
    after = begin + length
    bound = (after < n) & ~first_of_text[np.minimum(after, n)]
    following = best[at[np.minimum(after, n - 1)]]
    value -= penalty * (bound[:, None] & (following[:, None] != np.arange(labels)))
    out = np.zeros(n, dtype=np.int64)
    label = value.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        rows = alive[t]
        where = begin[:rows] + t
        out[where] = label[:rows]
        label[:rows] = back[where, label[:rows]] if t else label[:rows]
    return out


SCHEMA = "doc_id {kind}, lang_pred string, score double, spans array<struct<lang: string, words: int, letters: long>>"


def identify(docs: DataFrame, model: Model, penalty: float = 4.0, least_share: float = 0.02, enclosed: float = 0.25) -> DataFrame:
    """doc_id, lang_pred, score, spans for each row of ``docs``; only the text is looked at.

    ``spans`` are the labelled stretches in order, with their words (those with letters) and letters. A stretch between
    two of one other language is an insertion, whose letters count ``enclosed`` each; ``lang_pred`` has most letters so
    counted, the first by name on ties, and ``score`` is its share of them. Null texts and texts without letters,
    or without any learned language, give ``und``, score 0 and no spans. Other columns of ``docs`` are ignored and
    repeated rows are labelled each. Tasks get the model: languages times 2^16 numbers.
    """
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*langs, "und"])
        for rows, text in text_chunks(batches):
            words, at, offsets = words_of(text)
            scores, letters = model.scores(words, least_share) if langs else (np.zeros((len(words), 1)), np.zeros(len(words), dtype=np.int64))
            spoken = (letters > 0)[at]
            at = at[spoken]
            offsets = np.concatenate([[0], np.cumsum(spoken)])[offsets]
            text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            label = viterbi(scores, at, offsets, penalty)
            turn = np.ones(len(at), dtype=bool)
            turn[1:] = (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1])
            edge = np.append(np.flatnonzero(turn), len(at))
            own, lang, held = text_of[edge[:-1]], label[edge[:-1]], segment_sum(letters[at], edge)
            weight = np.ones(len(own))
            weight[1:-1][(own[2:] == own[:-2]) & (lang[2:] == lang[:-2])] = enclosed
            share = np.bincount(own * len(names) + lang, weights=weight * held, minlength=len(text) * len(names)).reshape(len(text), -1)
            total = share.sum(axis=1)
            winner = np.where(total > 0, share.argmax(axis=1), len(langs))
            score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1e-9), 0.0)
            spans = pa.StructArray.from_arrays(
                [names.take(pa.array(lang)), pa.array(np.diff(edge).astype(np.int32)), pa.array(held.astype(np.int64))], ["lang", "words", "letters"],
            )
            ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(text)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), names.take(pa.array(winner)), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), spans)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(kind=kind))
