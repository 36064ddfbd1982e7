"""Token ids packed into rows of one length: best-fit-decreasing with a segment tree over capacities.

Texts are encoded with a public vocabulary and cut losslessly where they are longer than a row; the pieces of a block
of texts are placed, longest first, into the fullest row that still has room. The tree holds for each remaining
capacity whether an open row has it, so that this row is found in log(row length) steps.

A block is a bounded slice of one input split: nothing is shuffled, a lost task packs its split again to the same
rows, and only the last rows of a block can stay partly empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from llm.common import text_chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary splits a text before pairs are merged.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 2 << 20  # encoded at once
SLICE_ROWS = 128  # made and handed on at once
KEPT_CUTS = 200_000

SCHEMA = "pack_id string, ids array<int>, n_tokens int, cu_seqlens array<int>, position_ids array<int>, doc_ids array<{kind}>, piece_starts array<long>"



def encoder(ranks: bytes):
    """The encoder of a vocabulary file's bytes."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


SPACE, NEWLINE, APOSTROPHE = b" \n'"
# Classes of bytes: 1 for ASCII letters and digits, 2 for other visible ASCII, 4 for the lead byte of U+00C0 to U+07FF (no blank among them).
KIND = np.zeros(256, dtype=np.uint8)
KIND[0x21:0x7F] = 2
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KIND[0xC3:0xE0] = 4


def breaks(body: np.ndarray) -> np.ndarray:
    """Where a text may be cut without changing a token: true at each byte that can begin a cut, and one entry for the end.

    That is before a single space between visible characters, before and after a single line break between such, and
    between a letter or digit and the sign after it, unless that is an apostrophe.
    """
    cut = np.zeros(len(body) + 1, dtype=bool)
    if len(body) < 3:
        return cut
    kind = KIND[body]
    visible = kind > 0
    visible[1:] |= kind[:-1] == 4
    between = visible[:-2] & visible[2:]
    line = (body[1:-1] == NEWLINE) & between
    cut[1:-2] = ((body[1:-1] == SPACE) & between) | line
    cut[2:-1] |= line
    cut[1:-1] |= (kind[:-1] == 1) & (kind[1:] == 2) & (body[1:] != APOSTROPHE)
    return cut


class Coder:
    """Encodes texts; the ids of the cuts of earlier texts are kept."""

    def __init__(self, ranks: bytes):
        self.encoding = encoder(ranks)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def cuts(self, cuts: pa.Array) -> np.ndarray:
        """The number of each cut among the kept ones; new cuts are encoded, together."""
        if len(self.known) > KEPT_CUTS:
            self.clear()
        texts = cuts.to_pylist()
        numbers = [*map(self.known.get, texts)]
        new = [i for i, number in enumerate(numbers) if number is None]
        if new:
            coded = [*map(self.encoding.encode_ordinary, [texts[i] for i in new])]
            size = np.array([*map(len, coded)], dtype=np.int64)
            base, end = len(self.size), len(self.flat)
            self.first = np.concatenate([self.first, end + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.array([*chain.from_iterable(coded)], dtype=np.int32)])
            for k, i in enumerate(new, base):
                self.known[texts[i]] = numbers[i] = k
        return np.array(numbers, dtype=np.int64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each ended by ``end``, and the offset of each text in them. Taken in slices, whose arrays are a multiple of their texts."""
        ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
        ids, lengths, start = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)], 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right")))
            found, offsets = self.encode_slice(texts.slice(start, stop - start), end)
            ids.append(found)
            lengths.append(np.diff(offsets))
            start = stop
        return np.concatenate(ids), np.cumsum(np.concatenate(lengths))

    def encode_slice(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``.

        The texts are cut where no token can reach across. The cuts repeat a lot, so each different one is encoded once and
        the ids are gathered.
        """
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        body, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        cut = breaks(body)
        cut[bounds] = True
        cut[-1] = True
        edges = np.flatnonzero(cut)
        starts = edges[:-1]
        cuts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(body)).dictionary_encode()
        at = self.cuts(cuts.dictionary)[np.asarray(cuts.indices)]
        size = self.size[at]
        before = np.concatenate([[0], np.cumsum(size)])
        lengths = np.diff(before[np.searchsorted(starts, bounds)]) + 1
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.full(int(offsets[-1]), end, dtype=np.int32)
        where = np.ones(len(ids), dtype=bool)
        where[offsets[1:] - 1] = False
        ids[where] = self.flat[np.repeat(self.first[at] - before[:-1], size) + np.arange(before[-1])]
        return ids, offsets


class Capacities:
    """Segment tree over 0..length: which remaining capacities open rows have."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.any = bytearray(2 * self.base)
        self.rows: dict[int, list[int]] = {}

    def put(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        at = self.base + capacity
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The open row with the smallest capacity of at least ``least``, with that capacity."""
        at = self.base + least
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        capacity = at - self.base
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            while at and not (at < self.base and (self.any[2 * at] or self.any[2 * at + 1])):
                self.any[at] = 0
                at >>= 1
        return row, capacity


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Piece numbers of each row, longest piece first; every piece is at most ``length``."""
    rows: list[list[int]] = []
    tree = Capacities(length)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = tree.take(need)
        row, room = found or (len(rows), length)
        if found is None:
            rows.append([])
        rows[row].append(piece)
        if room > need:
            tree.put(room - need, row)
    return rows


def pack(docs: DataFrame, length: int = 2048, path: str = VOCABULARY, end: int = END_OF_TEXT) -> DataFrame:
    """Rows of ``length`` ids from all texts of ``docs``.

    pack_id; ids (padded with ``end``); n_tokens (without padding); cu_seqlens (0 and the end of each segment, as
    attention kernels take them); position_ids (from 0 in each segment, 0 in the padding); doc_ids (the document of
    each segment); piece_starts (the segment's first token within its document).

    Each text gives its tokens and one ``end``, cut into segments of at most ``length``; the segments of a document
    join to exactly those tokens. Null and empty texts give a segment of one ``end``; repeated rows are packed each.
    Needs doc_id and text, other columns are ignored. Tasks get the vocabulary file, whose size is fixed.
    """
    with open(path, "rb") as file:
        ranks = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, coder = TaskContext.get().partitionId(), Coder(ranks)
        for block, (rows, text) in enumerate(text_chunks(batches, BLOCK_BYTES)):
            ids, offsets = coder.encode(text, end)
            pieces = -(-np.diff(offsets) // length)
            owner = np.repeat(np.arange(len(pieces)), pieces)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = offsets[owner] + within * length
            sizes = np.minimum(offsets[owner + 1] - start, length)
            packed = best_fit_decreasing(sizes, length)
            names = rows.column("doc_id").take(pa.array(owner))
            for at in range(0, len(packed), SLICE_ROWS):
                yield table(packed[at : at + SLICE_ROWS], ids, start, sizes, within * length, names, f"{split:07d}-{block:05d}", at)

    def table(packed, ids, start, sizes, first, names, prefix, at) -> pa.RecordBatch:
        order = np.fromiter((p for row in packed for p in row), dtype=np.int64)
        counts = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        size = sizes[order]
        ends = np.cumsum(size)
        row = np.repeat(np.arange(len(packed)), counts)
        base = np.concatenate([[0], ends])[bounds[:-1]]
        inside = ends - size - base[row]  # where the segment begins in its row
        matrix = np.full((len(packed), length), end, dtype=np.int32)
        places = np.zeros((len(packed), length), dtype=np.int32)
        step = np.arange(size.sum()) - np.repeat(ends - size, size)
        target = np.repeat(row * length + inside, size) + step
        matrix.ravel()[target] = ids[np.repeat(start[order], size) + step]
        places.ravel()[target] = step
        filled = ends[bounds[1:] - 1] - base
        limits = np.insert(inside + size, bounds[:-1], 0).astype(np.int32)
        full = pa.array(np.arange(0, (len(packed) + 1) * length, length, dtype=np.int32))
        segments = pa.array(bounds.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"{prefix}-{i:06d}" for i in range(at, at + len(packed))]), pa.ListArray.from_arrays(full, pa.array(matrix.ravel())),
                pa.array(filled.astype(np.int32)), pa.ListArray.from_arrays(pa.array((bounds + np.arange(len(bounds))).astype(np.int32)), pa.array(limits)),
                pa.ListArray.from_arrays(full, pa.array(places.ravel())), pa.ListArray.from_arrays(segments, names.take(pa.array(order))),
                pa.ListArray.from_arrays(segments, pa.array(first[order])),
            ],
            ["pack_id", "ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "piece_starts"],
        )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(kind=kind))


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files whose id, length and position columns are little-endian 32-bit binaries.

    Each is one row of a matrix, to be mapped with ``numpy.frombuffer(value, "<i4")``.
    """
    columns = ["ids", "cu_seqlens", "position_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [pa.array([np.asarray(x.values, dtype="<i4").tobytes() for x in batch.column(c)], type=pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("pack_id"), *raw, batch.column("doc_ids"), batch.column("piece_starts")], ["pack_id", *columns, "doc_ids", "piece_starts"])

    kind = packed.schema["doc_ids"].dataType.simpleString()
    packed.mapInArrow(run, f"pack_id string, ids binary, cu_seqlens binary, position_ids binary, doc_ids {kind}, piece_starts array<long>").write.parquet(path)
