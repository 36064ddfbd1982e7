"""Embedding whitening with distributed block matrices.

Rows become integers and are indexed into blocks of a distributed ``BlockMatrix``. The centred distinct rows, transposed
and multiplied with themselves, give the scatter matrix; its eigenvectors are found on the driver (a square of the number
of dimensions); a second block product with the whitening matrix projects all rows. Rows never meet on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BLOCK_VALUES = 1 << 16  # numbers of a block
GROUP = 8  # blocks that one task multiplies


def finite(vector: Column) -> Column:
    """Whether a vector is there, has entries and only finite ones."""
    entry = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry)


def integers(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, x: the rows with a finite vector, each entry c as floor(64 * c) + 1,000,000.

    Where vectors differ in length, only those of the most frequent length (of these, the smallest) take part.
    """
    entry = lambda c: F.floor(c.cast("double") * SCALE) + SHIFT
    rows = written(embeddings.filter(finite(F.col(column))).select(F.col(key).alias("key"), F.transform(column, entry).alias("x")), "whitening-rows")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.filter(F.size("x") == sizes[0].size) if sizes else rows


def blocks(rows: DataFrame, dims: int, name: str, *more: str) -> tuple[DataFrame, int, int]:
    """Rows (part, k, number, x, …) of a table of blocks, how many there are and how many indices a part has.

    Every task cuts its own rows into blocks of one height, the last filled up with rows to be ignored; ``x`` is the block's numbers
    row by row, and ``more`` columns come as lists. A block's index is its part times the height of parts, plus ``k``.
    """
    height = max(1, BLOCK_VALUES // dims)
    kinds = "".join(f", {c} array<{rows.schema[c].dataType.simpleString()}>" for c in more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, k = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            while waiting.num_rows >= height:
                yield block(part, k, waiting.slice(0, height))
                waiting, k = waiting.slice(height).combine_chunks(), k + 1
        if waiting is not None and waiting.num_rows:
            yield block(part, k, waiting)

    def block(part: int, k: int, table: pa.Table) -> pa.RecordBatch:
        x = np.asarray(table.column("x").combine_chunks().flatten(), dtype="<i8")
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in more]
        cells = [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([table.num_rows], pa.int32()), pa.array([x.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cells + lists, ["part", "k", "number", "x", *more])

    found = written(rows.select("x", *more).mapInArrow(cut, f"part int, k int, number int, x binary{kinds}"), name)
    extent = found.agg(F.count("*").alias("blocks"), F.max("k").alias("k")).first()
    return found, extent.blocks, (extent.k or 0) + 1


def matrix(table: DataFrame, count: int, stride: int, sums: np.ndarray, n: int) -> BlockMatrix:
    """The block matrix of centred rows: (n * x - sums) / n, exact up to the division. Filled-up rows are zero."""
    dims = len(sums)
    height = max(1, BLOCK_VALUES // dims)

    def centred(row) -> tuple[tuple[int, int], DenseMatrix]:
        values = np.zeros((height, dims))
        values[: row.number] = (n * np.frombuffer(row.x, dtype="<i8").reshape(-1, dims) - sums) / n
        return (row.part * stride + row.k, 0), DenseMatrix(height, dims, values.ravel(), True)

    # A product holds the blocks of one partition at once, so that partitions are kept to a few blocks each.
    dealt = table.select("part", "k", "number", "x").repartition(max(1, -(-count // (2 * GROUP))))
    parts = table.agg(F.max("part").alias("part")).first().part + 1
    return BlockMatrix(dealt.rdd.map(centred), height, dims, parts * stride * height, dims)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left * right, the common dimension split over ``splits`` tasks before the partial products are added."""
    found = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, left.rowsPerBlock, right.colsPerBlock)


def scatter(rows: BlockMatrix, count: int) -> np.ndarray:
    """rows' * rows as a local matrix: the number of columns squared."""
    return product(rows.transpose(), rows, max(1, -(-count // GROUP))).toLocalMatrix().toArray()


def eigenvectors(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit vectors as columns, the largest entry of each positive.

    Directions without variance (beyond rounding) are left out, as they cannot be scaled to one.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = values[:most] > values[0] * len(values) * np.finfo(float).eps * 16
    values, vectors = values[:most][kept], vectors[:, :most][:, kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def whiten(embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for each row and each of the first ``components``.

    Fitted on each distinct integer vector once; copies all get rows. ``deviation`` is the exact squared distance from the
    mean times n squared and fails rather than overflow. Rows whose vector is null, empty or not finite, or of another
    length than most, give none; rows that repeat an id, and a null id, are projected each. No row, or only one different
    vector, has no variance: the result is empty. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(embeddings, key, column)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    totals = fit.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total")).collect()
    if n < 2:
        return spark.createDataFrame([], schema)
    sums = np.array([r.total for r in sorted(totals)], dtype=np.int64)
    dims = len(sums)

    table, count, stride = blocks(fit, dims, "whitening-fit-blocks")
    fitted = matrix(table, count, stride, sums, n)
    covariance = scatter(fitted, count) / n
    values, vectors = eigenvectors(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    transform = vectors / np.sqrt(values)
    weights = DenseMatrix(dims, len(values), transform.ravel(order="F"))
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), weights)], 1), dims, len(values))
    error = float(np.abs(scatter(product(fitted, whitening), count) / n - np.eye(len(values))).max())

    difference = F.zip_with("x", F.array(*map(F.lit, sums.tolist())), lambda a, s: F.lit(n) * a - s)
    deviation = F.aggregate(difference, F.lit(0).cast("long"), lambda total, v: total + v * v)
    table, count, stride = blocks(rows.select("key", "x", deviation.alias("deviation")), dims, "whitening-blocks", "key", "deviation")
    projected = product(matrix(table, count, stride, sums, n), whitening)
    values_of = projected.blocks.map(lambda b: (int(b[0][0]), b[1].toArray().ravel().tolist())).toDF("index int, values array<double>")
    named = table.select((F.col("part") * stride + F.col("k")).alias("index"), "number", "key", "deviation")
    explained = values / np.trace(covariance)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(explained)
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column("number")[row].as_py()
                owner = pa.array(np.repeat(np.arange(number), width))
                own = lambda c: batch.column(c)[row].values.take(owner)  # noqa: B023, E731
                whitened = batch.column("values")[row].values.slice(0, number * width)
                each = [pa.array(np.tile(x, number)) for x in (np.arange(1, width + 1, dtype=np.int32), explained)]
                same = [pa.array(np.full(number * width, x)) for x in (n, error)]
                yield pa.RecordBatch.from_arrays([own("key"), each[0], same[0], own("deviation"), whitened, each[1], same[1]], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return named.join(values_of, "index").mapInArrow(expand, schema)
