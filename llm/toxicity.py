"""Toxicity of whole texts behind a noisy channel.

Words can be disguised: digits and signs for letters, letters repeated, letters spaced out or joined by signs. Every
suspicious word spans a lattice of the letters that each of its characters can stand for; a Viterbi pass with a
character trigram model, counted over the whole corpus, gives the likeliest restorations. Restored words are scored by
their letter 5-grams, whose weight is a cautious log-odds of the documents labelled toxic; boosted trees read a few
numbers about a document's worst words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.boosting import Trees, fit
from llm.common import code_points, mix64, ragged, segment_sum, text_chunks, written
from llm.language import LETTER
from llm.quality import labelled_sample

# Letters that a sign can stand for.
CHANNEL = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou",
}
JOINTS = ".-_*·•~'`,:;/\\|+=^"  # signs that can stand between the letters of one word
EDGE = ".,;:!?'\"()[]{}<>*#%&|~`^_-+=/\\"  # signs that can follow or lead a word without belonging to it
SLOTS = 1 << 16  # of the character model
GRAM_SLOTS = 1 << 20  # of the 5-grams
STRIPE = 1 << 16
ORDER = 3
LONGEST = 40  # characters of a disguise; a longer word is decoded in windows, each such stretch whole in one of them
KEPT = 4  # restorations of a word
TOGETHER = 8192  # words decoded in step
MEMORY = 200_000  # decoded words that a task remembers
SAMPLE_ROWS = 40_000
THRESHOLD = 0.7


# --- words ----------------------------------------------------------------------------------------------------------


INNER = "".join(c for c in EDGE if c not in CHANNEL)  # signs that cannot stand for letters either


def whole_words(words: pa.Array) -> pa.Array:
    """Words in lower case without the signs at their ends that cannot stand for letters."""
    return pc.utf8_trim(pc.utf8_lower(words), INNER)


def runs(single: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginning and end of each stretch of more than one ``single`` entry; a stretch ends with its segment."""
    edges = np.zeros(len(single) + 1, dtype=bool)
    edges[offsets] = True
    start = np.flatnonzero(single & (edges[:-1] | ~np.concatenate([[False], single])[:-1]))
    stop = np.flatnonzero(single & (edges[1:] | ~np.concatenate([single, [False]])[1:])) + 1
    long = stop - start > 1
    return start[long], stop[long]


class Words:
    """The different words of some texts, with the joined runs of one-character words, and which texts have them."""

    def __init__(self, text: pa.Array):
        cut, offsets = ragged(pc.ascii_split_whitespace(text))
        first = cut.dictionary_encode()
        kinds = whole_words(first.dictionary).dictionary_encode()
        at = np.asarray(kinds.indices).astype(np.int64)[np.asarray(first.indices)]
        # A letter with signs around it is a letter of a run, and so is a sign by itself that can stand for one.
        bare = pc.utf8_trim(kinds.dictionary, EDGE)
        letter = pc.if_else(pc.equal(pc.utf8_length(bare), 0), kinds.dictionary, bare)
        single = np.asarray(pc.equal(pc.utf8_length(letter), 1)).astype(bool)
        name = dict(zip(np.flatnonzero(single).tolist(), letter.filter(pa.array(single)).to_pylist(), strict=True))
        joined = [(a, "".join(name[i] for i in at[a:b].tolist())) for a, b in zip(*(x.tolist() for x in runs(single[at], offsets)), strict=True)]
        joined = [(a, run) for a, run in joined if len(set(run)) > 1]
        where = np.searchsorted(offsets, np.array([a for a, _ in joined], dtype=np.int64), side="right") - 1
        self.owner = np.concatenate([np.repeat(np.arange(len(text)), np.diff(offsets)), where])
        self.at = np.concatenate([at, len(kinds.dictionary) + np.arange(len(joined))]).astype(np.int64)
        self.kinds = pa.concat_arrays([kinds.dictionary, pa.array([run for _, run in joined], kinds.dictionary.type)])


# A word that is nothing but different letters in a row needs no further test.
UNUSUAL = re.compile(r"(?s)(.)\1|[\W\d_]")
REPEATED = re.compile(r"(?s)(.)\1{2,}")
MORE_THAN_THREE = re.compile(r"(?s)(.)\1{3,}")


def suspicious(word: str) -> bool:
    """Whether a word without its edges can be a disguise: signs that can stand for letters or join them, or a letter twice over.

    Without a letter, it has a sign that is no digit: numbers are read as they are.
    """
    if not UNUSUAL.search(word) or len(REPEATED.sub(r"\1\1", word)) < 3:
        return False
    if word.isalpha():
        return True
    others = [c for c in word if not c.isalpha()]
    return all(c in CHANNEL or c in JOINTS for c in others) and (len(others) < len(word) or any(c in CHANNEL and not c.isdigit() for c in others))


def windows(word: str) -> list[str]:
    """The word with runs of one character cut to three, which read the same, in stretches of at most twice LONGEST that overlap by LONGEST."""
    word = MORE_THAN_THREE.sub(r"\1\1\1", word)
    return [word[k : k + 2 * LONGEST] for k in range(0, max(len(word) - LONGEST, 1), LONGEST)]


# --- character model ------------------------------------------------------------------------------------------------


def gram_slots(points: np.ndarray, offsets: np.ndarray, order: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the ``order``-grams of each word between two marks (flat), and the word of each."""
    length = np.diff(offsets)
    padded = np.zeros(len(points) + 2 * len(length), dtype=np.uint64)
    padded[np.arange(len(points)) + np.repeat(2 * np.arange(len(length)) + 1, length)] = points
    owner = np.repeat(np.arange(len(length)), length + 2)
    count = max(len(padded) - order + 1, 0)
    code = np.zeros(count, dtype=np.uint64)
    for k in range(order):
        code = mix64(code * np.uint64(31) + padded[k : k + count] + np.uint64(1))
    inside = owner[:count] == owner[order - 1 :]
    return (code[inside] % np.uint64(slots)).astype(np.int64), owner[:count][inside]


class Characters:
    """Interpolated trigram model over hashed slots: how likely a letter is after the two before it."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray):
        self.pairs, self.triples = np.log(pairs + 2.0), np.log(triples + 0.05)

    def log(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of each ``c`` after ``a`` and ``b``; the mark at both ends of a word is a zero."""
        code = np.zeros(len(a), dtype=np.uint64)
        for x in (a, b):
            code = mix64(code * np.uint64(31) + x.astype(np.uint64) + np.uint64(1))
        pair = self.pairs[code % np.uint64(SLOTS)]
        code = mix64(code * np.uint64(31) + c.astype(np.uint64) + np.uint64(1))
        return self.triples[code % np.uint64(SLOTS)] - pair


def lattice(word: str) -> list[tuple[str, int, bool]]:
    """The steps of a word: (character, how often in a row, three for more, whether signs alone lie between it and an end)."""
    runs: list[list] = []
    for c in word:
        if runs and runs[-1][0] == c:
            runs[-1][1] = min(runs[-1][1] + 1, 3)
        else:
            runs.append([c, 1, False])
    if runs[0][0] in EDGE or runs[-1][0] in EDGE:
        for side in (runs, runs[::-1]):
            for run in side:
                if run[0] not in EDGE:
                    break
                run[2] = True
    return [(*run,) for run in runs]


def readings_of(c: str, times: int, edge: bool) -> list[tuple[str, float]]:
    """What a step of a lattice can be read as, and what that costs.

    A letter may be read once or twice where it is repeated; a sign between letters is a letter it can stand for, or
    nothing where it can join letters; so is a sign at an end that need not belong to the word.
    """
    options = [(c, 0.0)] if c.isalpha() else [(x, -0.7) for x in CHANNEL.get(c, "")]
    if times == 2:
        options = [(x * 2, cost) for x, cost in options] + [(x, cost - 1.0) for x, cost in options]
    elif times > 2:
        options = [(x * k, cost - 0.5 * k) for x, cost in options for k in (1, 2)]
    if not c.isalpha() and (edge or c in JOINTS or not options):
        options.append(("", -0.5))
    return options


def first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys`` (the last is the main one), and the place in the order where each entry's run of equal main keys begins."""
    order = np.lexsort(keys)
    own = keys[-1][order]
    new = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=bool)
    return order, np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))


def restore(model: Characters, words: list[str]) -> list[list[str]]:
    """The likeliest readings of each word, best first: Viterbi over all their lattices at once, step by step.

    A state is a word, the last two letters read of it and whether there were three yet; each keeps its two best different
    readings. Of a word's last states the best ``KEPT`` readings of three letters or more are returned.
    """
    found: list[list[str]] = [[] for _ in words]
    for start in range(0, len(words), TOGETHER):
        restore_block(model, words[start : start + TOGETHER], found, start)
    return found


def restore_block(model: Characters, words: list[str], found: list[list[str]], base: int) -> None:
    """``restore`` for some of the words, into ``found`` from ``base`` on."""
    numbers: dict[tuple[str, int, bool], int] = {}
    steps = [[numbers.setdefault(step, len(numbers)) for step in lattice(word)] for word in words]
    options = [readings_of(*step) for step in numbers]
    first = np.concatenate([[0], np.cumsum([*map(len, options)])])
    flat = [x for own in options for x in own]
    one, two = (np.array([ord(x[k]) if len(x) > k else 0 for x, _ in flat], dtype=np.int64) for k in (0, 1))
    cost = np.array([c for _, c in flat])
    length = np.array([*map(len, steps)])
    place = np.concatenate([[0], np.cumsum(length)])
    step = np.array([x for own in steps for x in own])

    zero = np.zeros(len(words), dtype=np.int64)
    word, a, b, score, text, letters = np.arange(len(words)), zero, zero, np.zeros(len(words)), zero.astype(np.uint64), zero
    trail, ends = [], []
    for k in range(int(length.max(initial=0))):
        # Every path goes on by every reading of its word's next step.
        own = step[place[word] + k]
        count = first[own + 1] - first[own]
        parent = np.repeat(np.arange(len(word)), count)
        option = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(len(parent))
        word, a, b, score, text, letters = (x[parent] for x in (word, a, b, score, text, letters))
        score = score + cost[option]
        for letter in (one[option], two[option]):
            some = letter > 0
            score[some] += model.log(a[some], b[some], letter[some])
            a, b = np.where(some, b, a), np.where(some, letter, b)
            text = np.where(some, mix64(text * np.uint64(31) + letter.astype(np.uint64) + np.uint64(1)), text)
            letters = letters + some
        # Where paths branched: of equal readings the cheapest stays, then the two best of each state.
        branched = count[parent] > 1
        at = np.flatnonzero(branched)
        key = mix64(text[at] + mix64(word[at].astype(np.uint64)))
        order, begin = first_of(-score[at], key)
        at = at[order[begin == np.arange(len(order))]]
        state = mix64(word[at].astype(np.uint64) * np.uint64(4) + np.minimum(letters[at], 3).astype(np.uint64))
        state = mix64(mix64(state + a[at].astype(np.uint64)) + b[at].astype(np.uint64))
        order, begin = first_of(text[at], -score[at], state)
        kept = np.sort(np.concatenate([np.flatnonzero(~branched), at[order[np.arange(len(order)) - begin < 2]]]))
        word, a, b, score, text, letters = (x[kept] for x in (word, a, b, score, text, letters))
        trail.append((parent[kept], one[option[kept]], two[option[kept]]))
        done = length[word] == k + 1
        closed = np.flatnonzero(done & (letters >= 3))
        ends.append((np.full(len(closed), k), closed, word[closed], score[closed] + model.log(a[closed], b[closed], np.zeros(len(closed), dtype=np.int64)), text[closed]))
        going = np.flatnonzero(~done)
        word, a, b, score, text, letters = (x[going] for x in (word, a, b, score, text, letters))
        trail[-1] = (*trail[-1], going)
    if not ends:
        return
    last, at, owner, value, text = (np.concatenate(x) for x in zip(*ends, strict=True))
    order, begin = first_of(text, -value, owner)
    best = order[np.arange(len(order)) - begin < KEPT]
    last, at, owner = last[best], at[best], owner[best]
    spelled = np.zeros((len(best), 2 * len(trail)), dtype=np.uint32)
    for k in range(len(trail) - 1, -1, -1):
        parent, first_letter, second_letter, going = trail[k]
        before = last > k
        at[before] = going[at[before]]  # where the path was before the ended ones were set aside
        there = last >= k
        spelled[there, 2 * k], spelled[there, 2 * k + 1] = first_letter[at[there]], second_letter[at[there]]
        at[there] = parent[at[there]]
    size = np.count_nonzero(spelled, axis=1)
    whole = spelled[spelled > 0].tobytes().decode("utf-32-le", "surrogatepass")
    stop = np.cumsum(size)
    for number, x, y in zip(owner.tolist(), (stop - size).tolist(), stop.tolist(), strict=True):
        found[base + number].append(whole[x:y])


def restored(model: Characters, wholes: pa.Array, memory: dict[str, list[str]]) -> tuple[list[str], np.ndarray]:
    """All readings of disguised words, and the word of each.

    A word is decoded without the signs at its ends, and with those that can stand for letters, window by window. What was
    decoded before is taken from ``memory``, which is emptied when it is full.
    """
    unusual = np.flatnonzero(np.asarray(pc.match_substring_regex(wholes, r"[^\p{L}]")).astype(bool) | doubled(wholes))
    chosen = wholes.take(pa.array(unusual))
    asked = zip(unusual.tolist(), pc.utf8_trim(chosen, EDGE).to_pylist(), chosen.to_pylist(), strict=True)
    parts = [(n, part) for n, word, whole in asked for w in ((word,) if word == whole else (word, whole)) if suspicious(w) for part in windows(w)]
    if len(memory) > MEMORY:
        memory.clear()
    new = [*dict.fromkeys(part for _, part in parts if part not in memory)]
    memory |= zip(new, restore(model, new), strict=True)
    pairs = dict.fromkeys((number, reading) for number, part in parts for reading in memory[part])
    return [reading for _, reading in pairs], np.array([number for number, _ in pairs], dtype=np.int64)


def doubled(words: pa.Array) -> np.ndarray:
    """Whether a word has one character twice in a row."""
    points, offsets = code_points(words)
    same = np.flatnonzero(points[1:] == points[:-1]) + 1
    owner = np.searchsorted(offsets, same, side="right") - 1
    found = np.zeros(len(words), dtype=bool)
    found[owner[same > offsets[owner]]] = True
    return found


def grams_of(model: Characters, wholes: pa.Array, memory: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the 5-grams of all readings of some words, each word as it is among them, and the word of each gram."""
    readings, owner = restored(model, wholes, memory)
    texts = pa.concat_arrays([pc.utf8_trim(wholes, EDGE).cast(pa.large_string()), pa.array(readings, pa.large_string())])
    points, ends = code_points(texts)
    letter = LETTER[points]
    ends = np.concatenate([[0], np.cumsum(segment_sum(letter, ends).astype(np.int64))])
    grams, reading = gram_slots(points[letter], ends, 5, GRAM_SLOTS)
    return grams, np.concatenate([np.arange(len(wholes)), owner])[reading]


def add_up(counts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the counts that tasks send as (stripe, task, slots, a, b): first over groups of tasks, then in all.

    Each task sends a stripe once, with only the slots that it has seen; what comes to the driver is one dense pair of
    arrays for each stripe.
    """
    groups = max(1, int(counts.rdd.getNumPartitions() ** 0.5))
    schema = "stripe int, task int, slots binary, a binary, b binary"

    def total(keys: tuple, table: pa.Table) -> pa.Table:
        sums = np.zeros((2, STRIPE), dtype=np.int64)
        for row in table.to_pylist():
            at = np.frombuffer(row["slots"], dtype=np.uint16)
            sums[0, at] += np.frombuffer(row["a"], dtype=np.int64)
            sums[1, at] += np.frombuffer(row["b"], dtype=np.int64)
        at = np.flatnonzero(sums.any(axis=0))
        cells = [pa.array([x], pa.binary()) for x in (at.astype(np.uint16).tobytes(), sums[0, at].tobytes(), sums[1, at].tobytes())]
        return pa.table([table.column("stripe").slice(0, 1), table.column("task").slice(0, 1), *cells], names=["stripe", "task", "slots", "a", "b"])

    part = counts.groupBy("stripe", F.pmod("task", F.lit(groups)).alias("group")).applyInArrow(total, schema)
    found = {}
    for row in part.groupBy("stripe").applyInArrow(total, schema).collect():
        found[row.stripe] = sums = np.zeros((2, STRIPE), dtype=np.int64)
        at = np.frombuffer(row.slots, dtype=np.uint16)
        sums[0, at], sums[1, at] = np.frombuffer(row.a, dtype=np.int64), np.frombuffer(row.b, dtype=np.int64)
    return found


COUNTS = "stripe int, task int, slots binary, a binary, b binary"


def sent(sums: np.ndarray) -> pa.RecordBatch:
    """The non-zero slots of two rows of counts, one row for each stripe."""
    rows = []
    for stripe in range(0, sums.shape[1], STRIPE):
        own = sums[:, stripe : stripe + STRIPE]
        at = np.flatnonzero(own.any(axis=0))
        rows.append((stripe // STRIPE, TaskContext.get().partitionId(), at.astype(np.uint16).tobytes(), own[0, at].tobytes(), own[1, at].tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["stripe", "task", "slots", "a", "b"])


def learn_characters(docs: DataFrame) -> Characters:
    """Counts of letter pairs and triples over every text of ``docs``. Each task adds up its own texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SLOTS), dtype=np.int64)
        for _, text in text_chunks(batches):
            words, _ = ragged(pc.ascii_split_whitespace(pc.utf8_lower(text)))
            kinds = words.dictionary_encode()
            times = np.bincount(np.asarray(kinds.indices), minlength=len(kinds.dictionary))
            points, offsets = code_points(kinds.dictionary)
            letter = LETTER[points]
            length = segment_sum(letter, offsets).astype(np.int64)
            # Words that are letters but for signs at the end; the others may be disguises and teach nothing.
            plain = length >= 0.7 * np.diff(offsets)
            held = letter & np.repeat(plain, np.diff(offsets))
            ends = np.concatenate([[0], np.cumsum(np.where(plain, length, 0))])
            grams, owner = gram_slots(points[held], ends, ORDER, SLOTS)
            sums[1] += np.bincount(grams, weights=times[owner], minlength=SLOTS).astype(np.int64)
            grams, owner = gram_slots(points[held], ends, ORDER - 1, SLOTS)
            sums[0] += np.bincount(grams, weights=times[owner], minlength=SLOTS).astype(np.int64)
        yield sent(sums)

    found = add_up(docs.select("text").mapInArrow(count, COUNTS))
    pairs, triples = found.get(0, np.zeros((2, SLOTS), dtype=np.int64))
    return Characters(pairs, triples)


# --- documents ------------------------------------------------------------------------------------------------------


class Evidence:
    """Cautious log-odds of each 5-gram slot, from the numbers of toxic and other documents that have it.

    ``without`` holds the weights that a learned document of either label sees: those of all others but itself.
    """

    def __init__(self, with_gram: np.ndarray, documents: tuple[int, int], caution: float = 1.0):
        def weight(other: np.ndarray, toxic: np.ndarray) -> np.ndarray:
            odds = np.log((toxic + 0.5) / (documents[1] + 1)) - np.log((other + 0.5) / (documents[0] + 1))
            spread = np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
            return np.maximum(odds - caution * spread, 0).astype(np.float32)

        other, toxic = with_gram.astype(np.float64)
        self.weight = weight(other, toxic)
        self.without = [weight(np.maximum(other - 1, 0), toxic), weight(other, np.maximum(toxic - 1, 0))]



class Scores:
    """How toxic words are, under each of some weights; a word's score is kept for the texts to come."""

    def __init__(self, model: Characters, *weights: np.ndarray):
        self.model, self.weights = model, weights
        self.decoded: dict[str, list[str]] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.weights)), dtype=np.float32)

    def of(self, words: pa.Array) -> np.ndarray:
        """A row for each word: the largest weight among the 5-grams of its readings."""
        if len(self.known) > MEMORY:
            self.clear()
        names = words.to_pylist()
        new = [i for i, name in enumerate(names) if name not in self.known]
        if new:
            grams, owner = grams_of(self.model, words.take(pa.array(new)), self.decoded)
            order = np.argsort(owner, kind="stable")
            first = np.searchsorted(owner[order], np.arange(len(new) + 1))
            some = np.flatnonzero(np.diff(first))
            rows = np.zeros((len(new), len(self.weights)), dtype=np.float32)
            for k, weight in enumerate(self.weights):
                rows[some, k] = np.maximum.reduceat(weight[grams[order]], first[some]) if len(some) else 0
            self.known |= {names[i]: len(self.table) + k for k, i in enumerate(new)}
            self.table = np.concatenate([self.table, rows])
        return self.table[[self.known[name] for name in names]]


def statistics(words: Words, score: np.ndarray, texts: int) -> np.ndarray:
    """Numbers about the worst words of each text, from a score for each different word."""
    total = np.maximum(np.bincount(words.owner, minlength=texts), 1)
    of = score[words.at]
    columns = [np.log1p(total)]
    for least in (0.5, 1.0, 2.0, 3.0):
        n = np.bincount(words.owner[of > least], minlength=texts)
        columns += [np.log1p(n), n / total]
    owner, of = words.owner[of > 0], of[of > 0]
    order = np.lexsort((-of, owner))
    owner, of = owner[order], of[order]
    first = np.searchsorted(owner, np.arange(texts + 1))
    for k in range(4):
        at = first[:-1] + k
        own = at < first[1:]
        worst = np.zeros(texts)
        worst[own] = of[at[own]]
        columns.append(worst)
    return np.stack(columns, axis=1)


def learn(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS) -> tuple[Characters, Evidence, Trees]:
    """Character model over all texts; evidence and trees from at most about ``rows`` labelled documents."""
    characters = learn_characters(docs)
    sample = written(labelled_sample(docs, labels, label, usable, rows), "toxicity-sample")
    documents = {r.label: r["count"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, memory = np.zeros((2, GRAM_SLOTS), dtype=np.int64), {}
        for batch, text in text_chunks(batches):
            words, toxic = Words(text), np.asarray(batch.column("label")) > 0
            grams, owner = grams_of(characters, words.kinds, memory)
            grams = grams[np.argsort(owner, kind="stable")]
            size = np.bincount(owner, minlength=len(words.kinds))
            first = np.cumsum(size) - size
            # Each text has each gram once, however many words and readings it is in.
            text_word = np.unique(words.owner * max(len(words.kinds), 1) + words.at)
            word = text_word % max(len(words.kinds), 1)
            length = size[word] if len(word) else np.zeros(0, dtype=np.int64)
            where = np.repeat(first[word] - (np.cumsum(length) - length), length) + np.arange(length.sum()) if len(word) else length
            pair = np.unique(np.repeat(text_word // max(len(words.kinds), 1), length) * GRAM_SLOTS + grams[where])
            for k in (0, 1):
                sums[k] += np.bincount(pair[toxic[pair // GRAM_SLOTS] == bool(k)] % GRAM_SLOTS, minlength=GRAM_SLOTS)
        yield sent(sums)

    counted = add_up(sample.mapInArrow(count, COUNTS))
    none = np.zeros((2, STRIPE), dtype=np.int64)
    evidence = Evidence(np.concatenate([counted.get(s, none) for s in range(GRAM_SLOTS // STRIPE)], axis=1), (documents.get(0, 0), documents.get(1, 0)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(characters, *evidence.without)
        for batch, text in text_chunks(batches):
            words, toxic = Words(text), np.asarray(batch.column("label")) > 0
            score = scores.of(words.kinds)
            found = np.where(toxic[:, None], *(statistics(words, score[:, k], len(text)) for k in (1, 0)))
            raw = pa.array([row.tobytes() for row in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), raw], ["doc_id", "label", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sorted((r.doc_id, r.x, r.label) for r in sample.mapInArrow(measure, f"doc_id {kind}, label int, x binary").collect())
    x = np.array([np.frombuffer(x) for _, x, _ in found]) if found else np.zeros((0, 1))
    return characters, evidence, fit(x, np.array([float(y > 0) for *_, y in found]), trees=40, depth=3)


def score(docs: DataFrame, model: tuple[Characters, Evidence, Trees]) -> DataFrame:
    """doc_id, score for each row of ``docs``: how likely it is toxic, from its text alone.

    Other columns are ignored and repeated rows are scored each. Null and empty texts have no words; a model learned
    without labels gives one half. Tasks get the model: numbers for a fixed count of slots.
    """
    characters, evidence, trees = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(characters, evidence.weight)
        for rows, text in text_chunks(batches):
            words = Words(text)
            found = statistics(words, scores.of(words.kinds)[:, 0], len(text))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(trees.predict(found[:, : len(trees.edges)]))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def deobfuscate(words: DataFrame, characters: Characters) -> DataFrame:
    """word, readings for each row of ``words`` (word): the likeliest readings of a suspicious word, itself otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes = whole_words(pc.fill_null(batch.column("word"), ""))
            texts, owner = restored(characters, wholes, {})
            plain = pc.utf8_trim(wholes, EDGE).to_pylist()
            readings: list[list[str]] = [[] for _ in plain]
            for number, reading in zip(owner.tolist(), texts, strict=True):
                readings[number].append(reading)
            found = [own or [word] for own, word in zip(readings, plain, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found, pa.list_(pa.string()))], ["word", "readings"])

    return words.select("word").mapInArrow(run, "word string, readings array<string>")
