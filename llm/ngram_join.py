"""Exact n-gram Jaccard join: which documents share at least ``threshold`` of their word n-grams, by prefix trees.

1. Every text becomes a set of hashed n-grams. An n-gram that only one document has can be in no overlap, so a set of
   which too few elements occur elsewhere links with nothing. Tasks send their n-grams to buckets of the hash range and
   get back those that also occur elsewhere; an n-gram common inside a slice of texts is sent once for the slice, so
   that no bucket grows with how frequent an n-gram is.
2. Equal sets are one class. Over the classes that are left, n-grams are ordered by how many classes have them, rarest
   first. Two linked classes share elements among the first few of either (prefix filter), and so many that what their
   prefixes leave out can make up the rest. Pairs for which that holds are followed to clusters of classes outside of
   which nothing links. An n-gram that many prefixes have is not taken apart in pairs: it keeps its classes together.
3. Within a cluster the ordered sets, most frequent element first, form a trie whose shared paths are stored once. A
   probe walks down from the root, adds up overlaps along shared paths once, and leaves a subtree as soon as the
   lengths that remain cannot reach the threshold. Sets already connected to the cluster's largest component need no
   probe of their own: a pair of them is connected anyway.
4. Clusters over a size bound are dealt out in blocks, each with the cluster's first set. If that connects the cluster,
   nothing is left to find; otherwise the sets outside its component are probed against every block.

Links are exact up to collisions of hashes (40 bits and the bucket's number) inside one pair of documents, about one in
a thousand million pairs of long texts. No list of pairs is made: what leaves
a cluster is at most one link for each set and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import components, mix64, ragged, text_chunks, written

N = 5
THRESHOLD = (3, 4)  # numerator and denominator, so that the test is in whole numbers
BLOCK_ELEMENTS = 150_000  # of the sets of one trie
SLICE_BYTES, PIECE_BYTES = 4 << 20, 1 << 20  # of texts whose n-grams are sent together, and that are taken apart at once
PROBE_BLOCKS = 4  # probes that meet one trie have as many elements as this many blocks
BUCKET_BYTES = 8 << 20  # of texts, whose n-grams come to a bucket
PAIRED = 32  # most classes with an n-gram in their prefixes that are compared pair by pair
KEPT_BITS = 40  # of a hash that are sent; the others are what the bucket stands for
PARTS = "slice long, bucket long, hashes binary, docs binary, meta binary"


def need(n: int | np.ndarray, m: int | np.ndarray = 0):
    """Smallest overlap of linked sets of ``n`` and ``m`` elements; with one argument, over all partners."""
    top, bottom = THRESHOLD
    return -(-top * n // bottom) if isinstance(m, int) and m == 0 else -(-top * (n + m) // (top + bottom))


# --- n-gram sets ----------------------------------------------------------------------------------------------------


def gram_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, sorted (flat), and the text of each.

    Words are the runs between ASCII white space, A-Z in lower case; a text of fewer words is one n-gram, one without
    words has none.
    """
    words, offsets = ragged(pc.ascii_split_whitespace(pc.ascii_lower(text)))
    kinds = words.dictionary_encode()
    code = pd.util.hash_array(kinds.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    real = np.asarray(pc.binary_length(kinds.dictionary)) > 0
    at = np.asarray(kinds.indices)
    kept = real[at]
    value = code[at[kept]]
    offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
    count = np.diff(offsets)
    owner = np.repeat(np.arange(len(text)), count)
    total = max(len(value) - n + 1, 0)
    grams = np.zeros(total, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for k in range(n):
        grams = grams * base + value[k : k + total]
    inside = owner[:total] == owner[n - 1 :] if total else np.zeros(0, dtype=bool)
    grams, grams_owner = grams[inside], owner[:total][inside]
    few = np.flatnonzero((count > 0) & (count < n))
    short = np.zeros(len(few), dtype=np.uint64)
    for k in range(n - 1):
        longer = count[few] > k
        short[longer] = (short[longer] + np.uint64(k + 1)) * base + value[(offsets[few] + k)[longer]]
    grams = mix64(np.concatenate([grams, short ^ np.uint64(0x5851F42D4C957F2D)]))
    grams_owner = np.concatenate([grams_owner, few])
    order = np.argsort(grams)
    order = order[by_small(grams_owner[order], len(text))]
    grams, grams_owner = grams[order], grams_owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (grams_owner[1:] != grams_owner[:-1])
    return grams[new], grams_owner[new]


def by_small(values: np.ndarray, below: int) -> np.ndarray:
    """Stable order of whole numbers from 0 to ``below``; numbers of 16 bits are sorted by radix."""
    return np.argsort(values.astype(np.uint16) if below <= 1 << 16 else values, kind="stable")


def gram_ids(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and kept bits of each hash in one number: what n-grams are told apart by from here on."""
    bits = np.uint64(KEPT_BITS)
    return ((grams >> bits) % np.uint64(buckets) << bits | grams & np.uint64((1 << KEPT_BITS) - 1)).view(np.int64)


def low_bytes(ids: np.ndarray) -> bytes:
    return ids.view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8].tobytes()


def from_low_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // KEPT_BITS, 8), dtype=np.uint8)
    out[:, : KEPT_BITS // 8] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, KEPT_BITS // 8)
    return out.reshape(-1).view(np.int64)


def counts_of(docs: np.ndarray, n: int) -> bytes:
    """How many entries each of ``n`` documents has, in as few bytes as the largest count needs (the first byte).

    Where fewer entries than documents are named: 0 and the steps from one entry's document to the next one's, a byte
    each; 255 says that the step goes on in the next byte. So the bytes grow with the entries at any number of buckets.
    """
    docs = docs[docs < n]
    if len(docs) < n:
        steps = np.diff(docs, prepend=0)
        raw = np.full(len(docs) + int((steps // 255).sum()), 255, dtype=np.uint8)
        raw[np.cumsum(steps // 255 + 1) - 1] = steps % 255
        return b"\0" + raw.tobytes()
    counts = np.bincount(docs, minlength=n)
    width = next(w for w in (1, 2, 4) if counts.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def from_counts(raw: bytes, entries: int) -> np.ndarray:
    """The document of each entry; entries that several documents of the slice have come last and have -1."""
    if raw[0]:
        counts = np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1)
        named = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    else:
        steps = np.frombuffer(raw, dtype=np.uint8, offset=1)
        named = np.cumsum(steps, dtype=np.int32)[steps < 255]
    docs = np.full(entries, -1, dtype=np.int32)
    docs[: len(named)] = named
    return docs


def slice_sets(rows: pa.RecordBatch, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice, taken in pieces: id and document of each n-gram of each text, sizes of the sets and their two fingerprints."""
    ids, owners, sizes, prints = [], [], [], []
    start = 0
    for part, text in text_chunks(iter([rows]), PIECE_BYTES):
        grams, owner = gram_sets(text, n)
        ids.append(gram_ids(grams, buckets))
        owners.append((owner + start).astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(text)).astype(np.int64))
        both = np.zeros((2, len(text)), dtype=np.uint64)
        np.add.at(both[0], owner, mix64(grams))
        np.add.at(both[1], owner, mix64(grams ^ np.uint64(0xD6E8FEB86659FD93)))
        prints.append(both.view(np.int64))
        start += part.num_rows
    return np.concatenate(ids), np.concatenate(owners), np.concatenate(sizes), np.concatenate(prints, axis=1)


def slice_rows(rows: pa.RecordBatch, here: int, n: int, buckets: int) -> pa.RecordBatch:
    """What slice ``here`` sends: its n-grams by bucket, and (bucket below 0) what it keeps about its documents."""
    whole, owner, size, prints = slice_sets(rows, n, buckets)
    order = np.argsort(whole)
    ordered = whole[order]
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(whole) else np.zeros(1, np.int64)
    del ordered
    times = np.diff(edge)
    many = np.zeros(len(whole), dtype=bool)
    many[order] = np.repeat(times > 1, times)
    # One entry for each n-gram, by bucket, then in the order of documents; those that several have come last.
    who = np.where(many, np.int32(rows.num_rows), owner)
    first = order[edge[:-1]]
    del order, edge, times
    first = first[by_small(who[first], rows.num_rows + 1)]
    first = first[by_small(whole[first] >> KEPT_BITS, buckets)]
    out, docs_of = whole[first], who[first]
    bucket = out >> KEPT_BITS
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(out) else np.zeros(1, np.int64)
    parts = [(here, int(bucket[a]), low_bytes(out[a:b]), counts_of(docs_of[a:b], rows.num_rows), None) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    ids = rows.column("doc_id").cast(pa.int64())
    meta = np.stack([np.asarray(pc.fill_null(ids, 0)), np.asarray(pc.is_null(ids)).astype(np.int64), size, *prints])
    parts.append((here, -1 - here, whole[many].tobytes(), owner[many].astype(np.uint16).tobytes(), meta.tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*parts, strict=True), kinds, strict=True)], ["slice", "bucket", "hashes", "docs", "meta"])


def send(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Rows for each slice of texts, with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (rows, _) in enumerate(text_chunks(batches, SLICE_BYTES)):
            yield slice_rows(rows, (task << 24) + number, n, buckets)

    return docs.select("doc_id", "text").mapInArrow(run, PARTS)


def answer(table: pa.Table) -> pa.Table:
    """Of one bucket: the n-grams that more than one slice or document has, back to the slices that named a document."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table
    slices = table.column("slice").to_pylist()
    parts = [from_low_bytes(x) for x in table.column("hashes").to_pylist()]
    docs = np.concatenate([from_counts(x, len(p)) for x, p in zip(table.column("docs").to_pylist(), parts, strict=True)])
    bounds = np.cumsum([0, *map(len, parts)])
    grams = np.concatenate(parts)
    order = np.argsort(grams)
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(grams), dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    again &= docs >= 0
    found = []
    for here, a, b in zip(slices, bounds[:-1], bounds[1:], strict=True):
        if again[a:b].any():
            found.append((here, low_bytes(grams[a:b][again[a:b]]), docs[a:b][again[a:b]].astype(np.uint16).tobytes()))
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table({
        "slice": pa.array(columns[0], pa.int64()), "bucket": pa.array([bucket] * len(found), pa.int64()), "hashes": pa.array(columns[1], pa.binary()),
        "docs": pa.array(columns[2], pa.binary()), "meta": pa.array([None] * len(found), pa.binary()),
    })


def gather(table: pa.Table) -> pa.Table:
    """Of one slice: each document with the size of its set, and its n-grams that others have where enough of them do."""
    grams, docs, meta = [], [], None
    for row in table.to_pylist():
        if row["bucket"] < 0:
            meta = np.frombuffer(row["meta"], dtype=np.int64).reshape(5, -1)
            grams.append(np.frombuffer(row["hashes"], dtype=np.int64))
        else:
            grams.append(from_low_bytes(row["hashes"]) | row["bucket"] << KEPT_BITS)
        docs.append(np.frombuffer(row["docs"], dtype=np.uint16))
    grams, docs = np.concatenate(grams), np.concatenate(docs)
    ids, no_id, size, first, second = meta
    held = np.bincount(docs, minlength=len(ids))
    kept = (held >= need(size)) & (size > 0) & (no_id == 0)
    order = by_small(docs, len(ids))
    order = order[kept[docs[order]]]
    ends = np.concatenate([[0], np.cumsum(np.where(kept, held, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[order]))
    return pa.table({
        "doc_id": pa.array(ids, mask=no_id > 0), "n": pa.array(size), "fa": pa.array(first), "fb": pa.array(second), "kept": pa.array(kept), "grams": lists,
    })


# --- trie -----------------------------------------------------------------------------------------------------------


class Trie:
    """Sets of element numbers (ascending = most frequent first), paths that sets share stored once.

    Node 0 is the root; a node's ``segment`` is the stretch of elements between its parent and itself. ``fewest`` and
    ``most`` are the smallest and largest full sizes of the sets below. Nodes of one depth are neighbours, and so are
    the children of a node.
    """

    def __init__(self, sets: list[np.ndarray], full: np.ndarray):
        self.sets, self.full = sets, full
        order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        shared = [0] * len(order)  # elements in common with the set before
        for i in range(1, len(order)):
            a, b = sets[order[i - 1]], sets[order[i]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = int(differ[0]) if len(differ) else m
        nodes: list[list] = [[-1, 0, 0, []]]  # parent, depth in elements, a set below, sets that end here
        stack = [0]
        for i, k in enumerate(order):
            last = None
            while nodes[stack[-1]][1] > shared[i]:
                last = stack.pop()
            if nodes[stack[-1]][1] < shared[i]:  # split the edge above ``last``
                nodes.append([stack[-1], shared[i], nodes[last][2], []])
                nodes[last][0] = len(nodes) - 1
                stack.append(len(nodes) - 1)
            if len(sets[k]) > shared[i]:
                nodes.append([stack[-1], len(sets[k]), k, []])
                stack.append(len(nodes) - 1)
            nodes[stack[-1]][3].append(k)
        children: list[list[int]] = [[] for _ in nodes]
        for node, (parent, *_) in enumerate(nodes[1:], 1):
            children[parent].append(node)
        low, high, starts, pieces, self.ends = [], [], [0], [], []
        self.fewest, self.most = np.full(len(nodes), np.iinfo(np.int64).max), np.zeros(len(nodes), dtype=np.int64)
        listed, layer = [], [0]
        while layer:
            listed += layer
            layer = [c for node in layer for c in children[node]]
        place = {node: k for k, node in enumerate(listed)}
        at = 1
        for node in listed:
            parent, depth, some, ending = nodes[node]
            pieces.append(sets[some][nodes[parent][1] : depth] if node else np.zeros(0, np.int64))
            starts.append(starts[-1] + len(pieces[-1]))
            low.append(at)
            at += len(children[node])
            high.append(at)
            self.ends.append(ending)
        for node in reversed(listed):
            k = place[node]
            sizes = [int(full[e]) for e in nodes[node][3]]
            self.fewest[k] = min([int(self.fewest[k]), *sizes])
            self.most[k] = max([int(self.most[k]), *sizes])
            if node:
                up = place[nodes[node][0]]
                self.fewest[up], self.most[up] = min(self.fewest[up], self.fewest[k]), max(self.most[up], self.most[k])
        self.low, self.high, self.starts = np.array(low), np.array(high), np.array(starts)
        self.elements = np.concatenate(pieces)
        self.depth = np.array([nodes[node][1] for node in listed])
        self.last = np.array([sets[nodes[node][2]][nodes[node][1] - 1] if node and nodes[node][1] else -1 for node in listed])

    def linked(self, probe: np.ndarray, size: int, universe: int) -> list[int]:
        """Numbers of the sets that link with ``probe``, a set of ``size`` elements in all."""
        mark = np.zeros(universe, dtype=np.int64)
        mark[probe] = 1
        passed = np.cumsum(mark)  # elements of the probe up to each element
        found: list[int] = []
        node, overlap = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        while len(node):
            width = self.high[node] - self.low[node]
            child = np.repeat(self.low[node] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            if not len(child):
                break
            length = self.starts[child + 1] - self.starts[child]
            where = np.repeat(self.starts[child] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            sums = np.concatenate([[0], np.cumsum(mark[self.elements[where]])])
            ends = np.cumsum(length)
            overlap = np.repeat(overlap, width) + sums[ends] - sums[ends - length]
            missed, left_out = self.depth[child] - overlap, passed[self.last[child]] - overlap
            most, fewest = self.most[child], self.fewest[child]
            alive = (missed <= most - need(size, most)) & (left_out <= size - need(size, fewest))
            node, overlap = child[alive], overlap[alive]
            for k, o in zip(node.tolist(), overlap.tolist(), strict=True):
                found += [e for e in self.ends[k] if o >= need(size, int(self.full[e]))]
        return found


def forest(sets: list[np.ndarray], full: np.ndarray, probes: list[int] | None, universe: int) -> list[tuple[int, int]]:
    """Links (set, set) that connect what all links of ``probes`` connect.

    Without a list of probes all links count, and sets are probed until those that are left lie in one component. Listed
    probes meet the other sets only.
    """
    held = np.setdiff1d(np.arange(len(sets)), [] if probes is None else probes)
    if not len(held):
        return []
    trie = Trie([sets[k] for k in held], full[held])
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    links = []
    size = [1] * len(sets)
    largest = 0

    def probe(k: int) -> None:
        nonlocal largest
        for other in held[trie.linked(sets[k], int(full[k]), universe)].tolist():
            a, b = find(k), find(other)
            if a != b:
                links.append((k, other))
                root[b] = a
                size[a] += size[b]
        if size[find(k)] > size[find(largest)]:
            largest = k

    if probes is not None:
        for k in probes:
            probe(k)
        return links
    # A set of the largest component waits: should another component outgrow that one, its turn comes after all.
    waiting = [*range(len(sets))]
    while waiting:
        later = []
        for k in waiting:
            if find(k) == find(largest) and size[find(k)] > 1:
                later.append(k)
            else:
                probe(k)
        waiting = [k for k in later if find(k) != find(largest)]
    return links


def hopeful(number: np.ndarray, offsets: np.ndarray, full: np.ndarray, asking: np.ndarray) -> np.ndarray:
    """Which of the rows that are ``asking`` share enough of their prefixes with one of the others to link, as in ``pairs``.

    The elements of a row come as they are ordered for the prefixes, the same in all rows: rarest first.
    """
    held, least = np.diff(offsets), need(full)
    row = np.repeat(np.arange(len(full)), held)
    early = np.arange(len(number)) - offsets[row] <= held[row] - least[row]
    others, place = np.flatnonzero(~asking), np.cumsum(~asking) - 1
    at = np.flatnonzero(early & ~asking[row])
    at = at[np.argsort(number[at], kind="stable")]
    keys, owner = number[at], place[row[at]]
    at = np.flatnonzero(early & asking[row])
    mine, mine_of = number[at], row[at]
    rows, passed = np.flatnonzero(asking), np.zeros(len(full), dtype=bool)
    step = max(1, (1 << 22) // max(len(keys), len(others), 1))  # a row meets each key once at most
    for k in range(0, len(rows) if len(others) else 0, step):
        some = rows[k : k + step]
        a, b = np.searchsorted(mine_of, some[0]), np.searchsorted(mine_of, some[-1], side="right")
        low = np.searchsorted(keys, mine[a:b])
        width = np.searchsorted(keys, mine[a:b], side="right") - low
        met = owner[np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        cell = np.repeat(np.searchsorted(some, mine_of[a:b]), width) * len(others) + met
        shared = np.bincount(cell, minlength=len(some) * len(others)).reshape(len(some), len(others))
        needed = need(full[some][:, None], full[others][None, :])
        larger, fewer = np.maximum(least[some][:, None], least[others]), np.minimum(held[some][:, None], held[others])
        passed[some] = ((shared > 0) & (shared + larger > needed) & (fewer >= needed)).any(axis=1)
    return passed


def link(table: pa.Table, marked: bool) -> pa.Table:
    """Links (a, b) within one block; with ``marked``, those of the rows marked as probes with the others."""
    order = np.argsort(np.asarray(table.column("c")), kind="stable")
    table = table.take(pa.array(order))
    ids, full = np.asarray(table.column("c")), np.asarray(table.column("n"))
    values, offsets = ragged(table.column("grams").combine_chunks())
    values = np.asarray(values)
    kinds, number, times = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), dtype=np.int64)
    rank[np.lexsort((kinds, -times))] = np.arange(len(kinds))
    number = rank[number]
    rows, probes = np.arange(len(ids)), None
    if marked:
        asking = table.column("probe").to_numpy()
        rows = np.flatnonzero(~asking | hopeful(number, offsets, full, asking))
        probes = np.flatnonzero(asking[rows]).tolist()
    found = []
    if probes is None or probes:
        found = forest([np.sort(number[offsets[k] : offsets[k + 1]]) for k in rows], full[rows], probes, len(kinds))
    a, b = (pa.array([ids[rows[x[k]]] for x in found], pa.int64()) for k in (0, 1))
    return pa.table({"a": a, "b": b})


# --- join -----------------------------------------------------------------------------------------------------------


def sets_with_partners(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n, fa, fb, kept, grams: every document with the size and fingerprint of its set, and the shared elements."""
    docs = docs.select("doc_id", "text")
    octets = docs.agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each slice sends a row to each bucket: both are as large as a task has room for, however large the table.
    buckets = max(2 * partitions, octets // BUCKET_BYTES)
    sent = send(docs, n, buckets)
    answered = sent.groupBy("bucket").applyInArrow(answer, PARTS)
    schema = "doc_id long, n long, fa long, fb long, kept boolean, grams array<long>"
    return written(answered.groupBy("slice").applyInArrow(gather, schema), "ngram-sets")


def clustered(elements: DataFrame) -> DataFrame:
    """c, n, grams, cluster of the classes of ``elements`` (c, fa, n, g) that may link with another one."""
    often = elements.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    items = elements.join(often, "g").groupBy("c", "fa", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("items"))
    top, bottom = THRESHOLD
    able = items.withColumn("least", F.ceil(F.col("n") * top / bottom).cast("int")).filter(F.size("items") >= F.col("least"))
    able = written(able.select("c", "n", "items", "least", (F.size("items") - F.col("least") + 1).alias("prefix")), "ngram-items")
    first = F.explode(F.slice("items", F.lit(1), F.col("prefix"))).alias("x")
    prefixes = written(able.select("c", "n", F.size("items").alias("held"), "least", first).select("c", "n", "held", "least", "x.g"), "ngram-prefixes")
    edges = pairs(prefixes).unionByName(stars(prefixes)).distinct()
    clusters = components(edges, "ngram-clusters").select(F.col("node").alias("c"), F.col("label").alias("cluster"))
    return written(able.join(clusters, "c").select("c", "n", F.col("items.g").alias("grams"), "cluster"), "ngram-clustered")


def pairs(prefixes: DataFrame) -> DataFrame:
    """(a, b) of the classes that share enough of their ``prefixes`` (c, n, held, least, g) to link, but for n-grams of more than ``PAIRED`` classes.

    Say the prefix of a set ends first in the common order. Elements shared up to there are in both prefixes, and ``least`` - 1
    elements of that set come later: the overlap is below the shared elements of the prefixes plus the larger ``least``. It is
    not above the ``held`` elements of either. A pair that shares a more frequent n-gram besides is held together by ``stars``.
    """
    top, bottom = THRESHOLD
    lists = prefixes.groupBy("g").agg(F.count("*").alias("k")).filter(F.col("k").between(2, PAIRED)).select("g")
    short = written(prefixes.join(lists, "g"), "ngram-lists")
    x, y = (short.select("g", *[F.col(c).alias(f"{c}_{side}") for c in ("c", "n", "held", "least")]) for side in "ab")
    needed = top * (F.col("n_a") + F.col("n_b"))
    met = x.join(y, "g").filter((F.col("c_a") < F.col("c_b")) & ((top + bottom) * F.least("held_a", "held_b") >= needed))
    shared = met.groupBy("c_a", "c_b", "n_a", "n_b", F.greatest("least_a", "least_b").alias("least")).agg(F.count("*").alias("shared"))
    enough = (top + bottom) * (F.col("shared") + F.col("least") - 1) >= needed
    return shared.filter(enough).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))


def stars(prefixes: DataFrame) -> DataFrame:
    """(a, b) that hold together the classes of each n-gram that more than ``PAIRED`` of the ``prefixes`` have."""
    roots = prefixes.groupBy("g").agg(F.min("c").alias("root"), F.count("*").alias("k")).filter(F.col("k") > PAIRED)
    return prefixes.join(roots, "g").filter("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b"))


def links(sets: DataFrame) -> DataFrame:
    """(a, b) that connect what the sets (c, n, grams, cluster) connect."""
    sizes = sets.groupBy("cluster").agg(F.sum(F.size("grams")).alias("elements"))
    blocks = sizes.select("cluster", F.ceil(F.col("elements") / BLOCK_ELEMENTS).cast("int").alias("blocks"))
    dealt = written(sets.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")), "ngram-blocks")
    # The first set of a cluster joins each block but its own.
    first = dealt.filter("c = cluster AND blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = first.filter("other <> block").withColumn("block", F.col("other")).drop("other")
    columns = ["c", "n", "grams", "cluster", "block"]
    inside = dealt.select(columns).unionByName(first.select(columns)).withColumn("probe", F.lit(True))
    found = written(inside.groupBy("cluster", "block").applyInArrow(lambda t: link(t, False), "a long, b long"), "ngram-links")
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        return found
    labels = components(found, "ngram-first-round").select(F.col("node").alias("c"), "label")
    labelled = large.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    main = labelled.filter("c = cluster").select("cluster", F.col("label").alias("main"))
    outside = written(labelled.join(main, "cluster").filter("label <> main").select("c", "n", "grams", "cluster", "blocks"), "ngram-outside")
    if outside.isEmpty():
        return found
    # Sets outside the component of the first one meet every block of their cluster; a block's own rows are dealt to each group of them.
    groups = outside.groupBy("cluster").agg(F.ceil(F.sum(F.size("grams")) / (PROBE_BLOCKS * BLOCK_ELEMENTS)).cast("int").alias("groups"))
    probes = outside.join(groups, "cluster").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    probes = probes.withColumn("part", F.pmod(F.xxhash64("c", F.lit(1)), F.col("groups")).cast("int")).withColumn("probe", F.lit(True))
    base = large.join(groups, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("probe", F.lit(False))
    columns = ["c", "n", "grams", "cluster", "block", "part", "probe"]
    more = base.select(columns).unionByName(probes.select(columns)).groupBy("cluster", "block", "part").applyInArrow(lambda t: link(t, True), "a long, b long")
    return written(found.unionByName(more), "ngram-all-links")


def near_duplicates(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``: the smallest id reachable over links, itself included.

    Needs doc_id (a whole number) and text; other columns are ignored. Null and empty texts have an empty set, which
    links with nothing, not even another empty one. Rows without id link with nothing and have no component. Repeated
    rows are documents with equal sets. An empty table gives an empty result.
    """
    rows = sets_with_partners(docs, n)
    prints = ["fa", "fb", "n"]
    classes = written(rows.filter("kept").groupBy(prints).agg(F.min("doc_id").alias("c")), "ngram-classes")
    # The set of a class is that of the row with the smallest id; the classes know which rows need to move.
    first = rows.filter("kept").join(classes.withColumnRenamed("c", "doc_id"), [*prints, "doc_id"], "left_semi")
    sets = first.dropDuplicates([*prints, "doc_id"])
    elements = written(sets.select(F.col("doc_id").alias("c"), "fa", "n", F.explode("grams").alias("g")), "ngram-elements")
    labels = components(links(clustered(elements)), "ngram-components")
    named = classes.join(labels, classes.c == labels.node, "left").select(*prints, F.least("c", "label").alias("class"))
    named = written(named, "ngram-names").alias("k")
    d = rows.select("doc_id", "n", "fa", "fb", "kept").alias("d")
    same = F.col("d.kept") & (F.col("d.fa") == F.col("k.fa")) & (F.col("d.fb") == F.col("k.fb")) & (F.col("d.n") == F.col("k.n"))
    return d.join(named, same, "left").select("d.doc_id", F.col("d.n").alias("n_shingles"), F.coalesce("class", "d.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, a null id being the largest.

    Texts are told apart by a 64-bit hash, not by id: rows that share an id are judged each by its own text, and rows without
    id like all others. Of rows equal in id and text one stays. Texts without words link with nothing and all stay.
    """
    key = F.xxhash64("text").alias("text_key")
    near = near_duplicates(docs.select(key.alias("doc_id"), "text"), n).filter("n_shingles > 0")
    near = near.select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("component")).distinct()
    rows = docs.select("doc_id", key).groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    grouped = written(rows.join(near, "text_key"), "ngram-grouped")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    # Written by itself, so that a large component is reduced by every task and its rows then join as a splittable side.
    first = written(grouped.groupBy("component").agg(F.min(order).alias("first")), "ngram-firsts")
    stays = order.eqNullSafe(F.col("first"))
    judged = grouped.join(first, "component").filter(~stays | (F.col("times") > 1)).select("doc_id", "text_key", (~stays).alias("gone"))
    judged = written(judged, "ngram-judged").withColumnRenamed("doc_id", "judged_id").withColumnRenamed("text_key", "judged_key")
    same = docs["doc_id"].eqNullSafe(F.col("judged_id")) & (F.xxhash64(docs["text"]) == F.col("judged_key"))
    # The list of rows to go grows with the table: the texts meet it by a shuffle at every size.
    kept = docs.join(judged.hint("merge"), same, "left_anti")
    repeated = judged.filter("NOT gone")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
