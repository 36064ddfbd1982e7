"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are dealt to lists by their nearest centroid, and turned by one random rotation, after which every few columns
are a fair sample of an inner product. A query scans the lists whose centroids it is nearest to. Within a list, columns
come in blocks: after each block a test asks whether the partial product, given its spread under random rotation, can
still belong to a product above the query's threshold; candidates that fail are not read further. What is left is
scored on the original vectors in double precision.

The threshold begins with what the query's nearest list alone gives, and rises with every tile of candidates that a task
has scanned, in the nearest list too. Equal vectors are one class with its smallest ids, so copies cost nothing. Short
lists share a pack, so that a query's vector is sent once for several lists; packs and their queries are cut into blocks
of bounded size, so a list may be as long as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import written

SAMPLE_ROWS = 32_768  # vectors that centroids are fitted on
MOST_LISTS = 1_024
LIST_ROWS = 1_000
PROBE_SHARE = 0.85  # of the lists; see README for the recall measured
PACK_ROWS = 4_096  # vectors of one scan: a block of a long list, or several short lists
PART_ROWS = 4_096  # queries of one scan
TILE_ROWS = 512  # vectors between two thresholds
PIECE_ROWS = 32_768  # pairs whose vectors are gathered at once
COLUMNS = 16  # of one column block
CAUTION = 3.0  # standard deviations that the test allows for

FOUND = "array<struct<neg: double, id: long>>"


def usable(vectors: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, vec): doubles of each vector of ``dimension`` finite numbers that are not all zero, and has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            kept, vecs = [], []
            for k, (row, name) in enumerate(zip(rows, batch.column("vec_id").to_pylist(), strict=True)):
                if name is not None and row is not None and len(row) == dimension and None not in row:
                    vec = np.array(row, dtype=np.float64) + 0.0
                    if np.isfinite(vec).all() and vec.any():
                        kept.append(k)
                        vecs.append(vec.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept, pa.int64())).cast(pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "vec"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vec binary")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(cls, vec, ids, asked): each different vector with its ``k`` + 1 smallest ids; ``asked`` if any row is a query.

    Copies are put together inside the tasks first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for name, vec, query in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "vec", "query")), strict=True):
                own = found.setdefault(vec, [set(), False])
                own[0].add(name)
                own[1] |= query
            columns = [pa.array([*found], pa.binary()), pa.array([sorted(x)[: k + 1] for x, _ in found.values()], pa.list_(pa.int64())), pa.array([q for _, q in found.values()], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["vec", "ids", "asked"])

    part = rows.mapInArrow(run, "vec binary, ids array<long>, asked boolean")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return part.groupBy("vec").agg(ids.alias("ids"), F.max("asked").alias("asked")).withColumn("cls", F.md5("vec"))


def matrix(column, dimension: int) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(len(values), dimension)


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Means of the nearest sample vectors, from evenly spaced rows on; an empty list keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy() if len(sample) else sample
    for _ in range(rounds if len(sample) else 0):
        near = nearest(sample, centres)
        count = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(part @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1) for part in np.array_split(x, len(x) // 4096 + 1)])


def products(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``a`` of ``x`` and ``b`` of ``y``; only a piece of the pairs is gathered at a time."""
    out = np.empty(len(a))
    for at in range(0, len(a), PIECE_ROWS):
        piece = slice(at, at + PIECE_ROWS)
        out[piece] = np.einsum("ij,ij->i", x[a[piece]], y[b[piece]])
    return out


def tested(queries: np.ndarray, q: np.ndarray, least: np.ndarray, vectors: np.ndarray, x: np.ndarray, caution: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, product) of all pairs that no test rejects and whose product reaches the query's ``least``; ``q`` and ``x`` are rotated."""
    dimension = queries.shape[1]
    length = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)
    alive, partial = np.ones(length.shape, dtype=bool), np.zeros(length.shape)
    pairs = None
    for start in range(0, dimension, COLUMNS):
        stop = min(start + COLUMNS, dimension)
        share = stop / dimension
        spread = caution * np.sqrt(2 * share * (1 - share) / dimension) + 1e-9
        if pairs is None:
            partial += q[:, start:stop] @ x[:, start:stop].T
            alive &= partial >= share * least[:, None] - spread * length
            if alive.mean() < 0.3:  # cheaper pair by pair from here on
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            a, b = pairs
            partial += products(q[:, start:stop], x[:, start:stop], a, b)
            kept = partial >= share * least[a] - spread * length[a, b]
            pairs, partial = (a[kept], b[kept]), partial[kept]
    a, b = np.nonzero(alive) if pairs is None else pairs
    exact = products(queries, vectors, a, b)
    kept = exact >= least[a]
    return a[kept], b[kept], exact[kept]


def scan(
    queries: np.ndarray, least: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, caution: float,
    k: int | None = None, lists: np.ndarray | None = None, chosen: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, product) of all pairs that no test rejects and whose product reaches the query's ``least``.

    With ``k``, those alone that may be among a query's ``k`` + 1 best, ties with the last of them included: the best products
    so far of each query are kept, and the last of them is its threshold for the next tile. ``lists`` has the list of each
    vector and ``chosen`` which of them a query scans; without them there is one list, which all scan.
    """
    q, x, least = queries @ rotation, vectors @ rotation, least.copy()
    lists = np.zeros(len(vectors), dtype=int) if lists is None else lists
    chosen = np.ones((len(queries), 1), dtype=bool) if chosen is None else chosen
    top = np.full((len(queries), (k or 0) + 1), -np.inf)
    found = []
    for own in np.unique(lists):
        who, rows = np.flatnonzero(chosen[:, own]), np.flatnonzero(lists == own)
        for at in range(0, len(rows) if len(who) else 0, TILE_ROWS):
            tile = rows[at : at + TILE_ROWS]
            a, b, score = tested(queries[who], q[who], least[who], vectors[tile], x[tile], caution)
            found.append((who[a], tile[b], score))
            if k is None:
                continue
            seen = np.full((len(who), k + 1 + len(tile)), -np.inf)
            seen[:, : k + 1] = top[who]
            seen[a, k + 1 + b] = score
            top[who] = np.partition(seen, len(tile), axis=1)[:, len(tile) :]
            least[who] = np.maximum(least[who], top[who].min(axis=1))
    if not found:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    a, b, score = (np.concatenate(part) for part in zip(*found, strict=True))
    kept = score >= least[a]
    return a[kept], b[kept], score[kept]


def packs(sizes: np.ndarray) -> np.ndarray:
    """The pack of each list: neighbours in order share one while they have ``PACK_ROWS`` vectors together at most."""
    out, pack, held = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for own, size in enumerate(sizes):
        if held and held + size > PACK_ROWS:
            pack, held = pack + 1, 0
        out[own], held = pack, held + size
    return out


def best(found, k: int):
    """The ``k`` + 1 first of collected arrays of (negative score, id)."""
    return F.slice(F.array_sort(F.flatten(F.collect_list(found))), 1, k + 1)


class Index:
    """Lists of the classes of ``vectors``: centroids from a bounded sample chosen by hash, every class in its list."""

    def __init__(self, vectors: DataFrame, k: int, dimension: int | None = None, query_every: int = 20, seed: int = 7):
        spark = vectors.sparkSession
        if dimension is None:  # what most vectors have
            sizes = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count()
            top = sizes.agg(F.max(F.struct("count", "d")).alias("m")).first().m
            dimension = top.d if top else 1
        self.k, self.dimension = k, dimension
        rows = written(usable(vectors, dimension).withColumn("query", F.col("vec_id") % query_every == 0), "vectors")
        self.queries = rows.filter("query").select(F.col("vec_id").alias("query_id"), F.md5("vec").alias("cls")).distinct()
        self.classes = written(classes(rows, k), "vector-classes")
        count = self.classes.count()
        share = min(1.0, SAMPLE_ROWS / max(1, count))
        sample = self.classes.filter(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("cls", "vec").collect()
        points = matrix(pa.array([r.vec for r in sorted(sample)], pa.binary()), dimension)
        self.lists = max(1, min(MOST_LISTS, count // LIST_ROWS, len(points)))
        self.centres = centres = centroids(points, self.lists)
        self.rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))[0]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = nearest(matrix(batch.column("vec"), dimension), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "list"])

        dealt = written(self.classes.select("cls", "vec", "ids").mapInArrow(deal, "cls string, vec binary, ids array<long>, list long"), "vector-lists")
        sizes = np.zeros(self.lists, dtype=np.int64)
        for row in dealt.groupBy("list").count().collect():  # MOST_LISTS rows at most
            sizes[row["list"]] = row["count"]
        self.packs = packs(sizes)
        dealt = dealt.withColumn("pack", F.get(F.array(*[F.lit(int(p)) for p in self.packs]), F.col("list").cast("int")))
        self.blocks = written(dealt.groupBy("pack").agg(F.ceil(F.count("*") / PACK_ROWS).cast("int").alias("blocks")), "pack-blocks")
        self.index = dealt.join(self.blocks, "pack").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).drop("blocks")
        self.index = written(self.index, "vector-index")
        self.spark = spark

    def probes(self, share: float) -> DataFrame:
        """(cls, vec, home, pack, lists): the lists that each different query vector scans, by pack.

        ``lists`` has a bit for each list of the pack. The nearest list comes in a row of its own, which is ``home``.
        """
        centres, dimension, count, packs = self.centres, self.dimension, max(1, int(np.ceil(self.lists * share))), self.packs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    batch = whole.slice(start, 512)
                    order = np.argsort(-(matrix(batch.column("vec"), dimension) @ centres.T), axis=1, kind="stable")[:, :count]
                    for home, turns in ((True, order[:, :1]), (False, order[:, 1:])):
                        chosen = np.zeros((len(order), len(packs)), dtype=bool)
                        np.put_along_axis(chosen, turns, True, axis=1)
                        for pack in np.unique(packs[turns]):
                            bits = chosen[:, packs == pack]
                            rows = np.flatnonzero(bits.any(axis=1))
                            at, n = pa.array(rows), len(rows)
                            lists = pa.array([row.tobytes() for row in np.packbits(bits[rows], axis=1)], pa.binary())
                            columns = [batch.column("cls").take(at), batch.column("vec").take(at), pa.array([home] * n, pa.bool_()), pa.array([int(pack)] * n, pa.int32()), lists]
                            yield pa.RecordBatch.from_arrays(columns, ["cls", "vec", "home", "pack", "lists"])

        return written(self.classes.filter("asked").select("cls", "vec").mapInArrow(run, "cls string, vec binary, home boolean, pack int, lists binary"), "probes")

    def scanned(self, probes: DataFrame, caution: float) -> DataFrame:
        """(cls, found) for each query and block of ``probes`` (cls, vec, pack, lists, least): at most ``k`` + 1 best ids each."""
        k, dimension, rotation, packs = self.k, self.dimension, self.rotation, self.packs
        parts = probes.groupBy("pack").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).join(self.blocks, "pack")
        parts = written(parts, "pack-parts")
        asked = probes.join(parts, "pack").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks")
        held = self.index.join(parts.select("pack", "parts"), "pack").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            names, found = [], []
            if left.num_rows and right.num_rows:
                own_lists = np.flatnonzero(packs == left.column("pack")[0].as_py())
                bits = np.frombuffer(b"".join(left.column("lists").to_pylist()), dtype=np.uint8).reshape(left.num_rows, -1)
                chosen = np.unpackbits(bits, axis=1, count=len(own_lists)).astype(bool)
                lists = np.searchsorted(own_lists, np.asarray(right.column("list")))
                least = np.asarray(left.column("least"), dtype=np.float64)
                a, b, score = scan(matrix(left.column("vec"), dimension), least, matrix(right.column("vec"), dimension), rotation, caution, k, lists, chosen)
                cls, ids = left.column("cls").to_pylist(), right.column("ids").to_pylist()
                order = np.lexsort((b, -score, a))
                a, b, score = a[order], b[order], score[order]
                edge = np.searchsorted(a, np.arange(left.num_rows + 1))
                for q in range(left.num_rows):
                    own = range(edge[q], edge[q + 1])
                    if own:
                        last = score[own[min(k, len(own) - 1)]]  # ties with the last place stay
                        pairs = sorted((-float(score[p]), i) for p in own if score[p] >= last for i in ids[b[p]])
                        names.append(cls[q])
                        found.append([{"neg": s, "id": i} for s, i in pairs[: k + 1]])
            kind = pa.list_(pa.struct([("neg", pa.float64()), ("id", pa.int64())]))
            return pa.table({"cls": pa.array(names, pa.string()), "found": pa.array(found, kind)})

        key = ["pack", "block", "part"]
        out = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(run, f"cls string, found {FOUND}")
        # Any number of packs and blocks: first within groups of a query's results, then in all.
        part = out.groupBy("cls", F.pmod(F.hash("found"), F.lit(8)).alias("salt")).agg(best("found", k).alias("found"))
        return part.groupBy("cls").agg(best("found", k).alias("found"))

    def search(self, share: float = PROBE_SHARE, caution: float = CAUTION) -> DataFrame:
        """query_id, rank, vec_id, score: up to ``k`` nearest other rows found for each query, ties to smaller ids."""
        probes = self.probes(share)
        home = written(self.scanned(probes.filter("home").withColumn("least", F.lit(float("-inf"))), caution), "home-results")
        reached = home.select("cls", F.when(F.size("found") > self.k, -F.col("found")[self.k]["neg"]).otherwise(float("-inf")).alias("least"))
        rest = probes.filter("not home").join(reached, "cls")
        both = written(home.unionByName(self.scanned(rest, caution)), "scan-results")
        merged = both.groupBy("cls").agg(best("found", self.k).alias("found"))
        others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, self.k)
        named = self.queries.join(merged, "cls").select("query_id", F.posexplode(others).alias("at", "x"))
        return named.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.neg")).alias("score"))


def neighbours(vectors: DataFrame, k: int = 20, query_every: int = 20, share: float = PROBE_SHARE, dimension: int | None = None) -> DataFrame:
    """The ``k`` largest inner products of every row whose id ``query_every`` divides, among all other rows.

    Needs vec_id and embedding; other columns are ignored. Vectors that are null, zero or hold a null or a number that
    is not finite take no part, nor do those without id or of another dimension than most. Rows that repeat an id and
    a vector count once; the same id with another vector is another candidate, though never its own neighbour. Equal
    products rank by id. An empty table gives an empty result.
    """
    return Index(vectors, k, dimension, query_every).search(share)
