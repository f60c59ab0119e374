"""Whitening of embeddings on distributed block matrices.

Vectors become rows of whole numbers, are centred exactly and laid into the blocks of a ``BlockMatrix`` of Spark
MLlib where they are read, without an exchange. The product of the transposed matrix with itself is the scatter,
summed over as many parts as there are groups of blocks; its eigenvectors are found on the driver, which holds one
matrix of dimensions x dimensions. A second product, with the whitening matrix, projects the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.tables import drop_staged, stage

#: A component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Columns of a block, and the bytes that a block holds at most.
BLOCK_COLUMNS, BLOCK_BYTES = 512, 32 << 20
#: Rows of a block are at least these, and so many that this number of blocks holds the table, up to BLOCK_BYTES.
LEAST_ROWS, BLOCKS = 1024, 100_000
#: Blocks that one task of a scatter multiplies.
TASK_BLOCKS = 4
#: Eigenvalues below this share of the largest are no variance.
NO_VARIANCE = 1e-12
#: Sums of whole numbers are taken in a low part of so many bits and the rest, so that they fit.
LOW_BITS = 20

_MATRIX = pa.struct(
    [
        ("type", pa.int8()),
        ("numRows", pa.int32()),
        ("numCols", pa.int32()),
        ("colPtrs", pa.list_(pa.int32())),
        ("rowIndices", pa.list_(pa.int32())),
        ("values", pa.list_(pa.float64())),
        ("isTransposed", pa.bool_()),
    ]
)
_BLOCKS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("column", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("deviations", T.ArrayType(T.LongType())),
        T.StructField("matrix", MatrixUDT()),
    ]
)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments(NamedTuple):
    """Number of vectors of the fit list and the exact sums of their dimensions."""

    n: int
    sums: list[int]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, x): the vectors that take part, as whole numbers.

    Vectors that are null or hold a null or a component that is not finite go, and with them those with a component
    whose multiple is beyond 2**62 and cannot be exact. Of vectors with different numbers of components, the most
    frequent number stays, the larger if two are as frequent. Zero vectors stay, as do rows without a vec_id.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < 2.0**62)))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("vec") == (sizes["size"] if sizes else 1))
    return rows.select("vec_id", F.transform("vec", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))


def moments(fit: DataFrame) -> Moments:
    """Exact count and sums of the column ``x``; one row per dimension comes to the driver."""
    entries = fit.select(F.posexplode("x").alias("at", "x"))
    low = F.sum(F.col("x").bitwiseAND((1 << LOW_BITS) - 1)).alias("low")
    parts = entries.groupBy("at").agg(F.count("*").alias("n"), F.sum(F.shiftright("x", LOW_BITS)).alias("high"), low).orderBy("at").collect()
    return Moments(parts[0]["n"] if parts else 0, [(r["high"] << LOW_BITS) + r["low"] for r in parts])


def _rows_per_block(n: int, width: int) -> int:
    most = BLOCK_BYTES // (8 * min(width, BLOCK_COLUMNS))
    return max(1, min(most, max(LEAST_ROWS, -(-n // BLOCKS))))


def _centred(x: np.ndarray, fitted: Moments) -> tuple[np.ndarray, list[int | None]]:
    """Rows less the mean, each entry rounded once, and the exact sum of squares of n times that; null beyond a long."""
    sums, top = fitted.sums, max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if fitted.n * top + max(map(abs, sums)) < 1 << 62:
        off = x * fitted.n - np.array(sums, np.int64)
    else:
        off = x.astype(object) * fitted.n - np.array(sums, object)
    largest = max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0))))
    if largest * largest * x.shape[1] < 1 << 63:
        deviations = (off.astype(np.int64) ** 2).sum(1).tolist()
    else:
        exact = (sum(int(v) ** 2 for v in row) for row in off)
        deviations = [v if v < 1 << 63 else None for v in exact]
    # Division of whole numbers by Python rounds once; by floats it does so while both are below 2**53.
    if largest < 1 << 53 and fitted.n < 1 << 53:
        return off.astype(np.float64) / fitted.n, deviations
    return np.array([[int(v) / fitted.n for v in row] for row in off]).reshape(x.shape), deviations


def blocked(rows: DataFrame, fitted: Moments, rows_per_block: int) -> DataFrame:
    """(vec_id, x) -> centred rows in blocks, written: a task fills its own blocks, the last padded with rows of zeros.

    ``block`` numbers the blocks from 0. A zero row changes no product; it has no entry in ``ids``.
    """
    width = len(fitted.sums)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        count = 0

        def block(ids: list, x: np.ndarray, place: int) -> Iterator[pa.RecordBatch]:
            centred, deviations = _centred(x, fitted)
            full = np.zeros((rows_per_block, width))
            full[: len(centred)] = centred
            for column, at in enumerate(range(0, width, BLOCK_COLUMNS)):
                piece = full[:, at : at + BLOCK_COLUMNS]
                values = pa.ListArray.from_arrays(pa.array([0, piece.size], pa.int32()), pa.array(np.ascontiguousarray(piece).reshape(-1)))
                none = pa.nulls(1, pa.list_(pa.int32()))
                matrix = pa.StructArray.from_arrays(
                    [pa.array([1], pa.int8()), pa.array([rows_per_block], pa.int32()), pa.array([piece.shape[1]], pa.int32()), none, none, values, pa.array([True])],
                    fields=list(_MATRIX),
                )
                first = column == 0
                yield pa.record_batch(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([place], pa.int32()),
                        pa.array([column], pa.int64()),
                        pa.array([ids if first else None], pa.list_(pa.int64())),
                        pa.array([deviations if first else None], pa.list_(pa.int64())),
                        matrix,
                    ],
                    names=_BLOCKS.names,
                )

        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            own = batch.column("vec_id").to_pylist()
            at = 0
            while at < len(own):
                take = min(rows_per_block - count, len(own) - at)
                held.append(x[at : at + take])
                ids += own[at : at + take]
                count, at = count + take, at + take
                if count == rows_per_block:
                    yield from block(ids, np.concatenate(held), place)
                    ids, held, count, place = [], [], 0, place + 1
        if count:
            yield from block(ids, np.concatenate(held), place)

    filled = stage(rows.select("vec_id", "x").mapInArrow(fill, _BLOCKS), "blocks")
    sizes = filled.where("column = 0").groupBy("part").agg(F.count("*").alias("size"))
    # One row per task that filled blocks.
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return filled.join(F.broadcast(before), "part").withColumn("block", F.col("before") + F.col("place")).drop("part", "place", "before")


def block_matrix(blocks: DataFrame, rows_per_block: int, width: int) -> tuple[BlockMatrix, int]:
    """The blocks as a matrix, and the number of its rows of blocks."""
    height = blocks.where("column = 0").count()
    columns = min(width, BLOCK_COLUMNS)
    placed = blocks.select(F.struct(F.col("block").cast("long").alias("_1"), F.col("column").alias("_2")).alias("at"), "matrix")
    java = callMLlibFunc("createBlockMatrix", placed, rows_per_block, columns, height * rows_per_block, width)
    return BlockMatrix(java, rows_per_block, columns), height


def scatter(matrix: BlockMatrix, height: int) -> np.ndarray:
    """Transposed matrix times itself; its middle is cut so that a task multiplies a few blocks, and sums combine."""
    turned = matrix.transpose()
    parts = max(1, -(-height // TASK_BLOCKS))
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    """Matrix times the whitening matrix, whose blocks are one column of blocks."""
    high = matrix.colsPerBlock
    pieces = [((i, 0), DenseMatrix(len(p), p.shape[1], p.reshape(-1, order="F").tolist())) for i, p in enumerate(weights[a : a + high] for a in range(0, len(weights), high))]
    right = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), high, weights.shape[1], *weights.shape)
    return matrix.multiply(right)


def _eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, whitening columns for those with variance, and each value's share of the trace."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1][:most], 0), vectors[:, ::-1][:, :most]
    largest = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    has = int((values > NO_VARIANCE * values[0]).sum()) if values[0] > 0 else 0
    trace = np.trace(covariance)
    return vectors[:, :has] / np.sqrt(values[:has]), values, values / trace if trace > 0 else np.full(len(values), np.nan)


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, embedding) -> one row per vector that takes part and component, up to ``components``.

    ``whole_vectors`` says which take part. The fit list holds each distinct vector of whole numbers once: n vectors
    with sums S. ``deviation`` is the sum over dimensions of (n * x - S)**2, exact, null beyond a long. Components are
    eigenvectors of the covariance of the fit list (divisor n) by falling eigenvalue e, with the entry of largest size
    positive; ``whitened`` is x - S / n on the component over sqrt(e), ``explained`` e over the trace. Equal
    eigenvalues may come in any order. A component without variance (one vector, constant or dependent dimensions) has
    a null ``whitened``, and ``explained`` is null if nothing varies. ``identity_error`` is the largest entry of
    |covariance of the whitened fit list - identity| over components with variance, null if there is none. Repeated
    rows and ids give rows of their own; an empty table and vectors without components give no rows; other columns are
    not read.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors)
    fit = stage(rows.select("x").distinct(), "fit")
    fitted = moments(fit)
    width = len(fitted.sums)
    if not width:
        return spark.createDataFrame([], RESULT)
    rows_per_block = _rows_per_block(fitted.n, width)
    fit_blocks = blocked(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), fitted, rows_per_block)
    matrix, height = block_matrix(fit_blocks, rows_per_block, width)
    weights, values, explained = _eigen(scatter(matrix, height) / fitted.n, min(components, width))
    shares = [float(v) if np.isfinite(v) else None for v in explained]
    error = None
    if weights.shape[1]:
        # Rows of the fit list are centred, hence so are their projections.
        own = scatter(projected(spark, matrix, weights), height) / fitted.n
        error = float(np.abs(own - np.eye(weights.shape[1])).max())
    drop_staged(fit)

    blocks = blocked(rows, fitted, rows_per_block)
    names = blocks.where("column = 0").select("block", "ids", "deviations")
    if weights.shape[1]:
        whole, _ = block_matrix(blocks, rows_per_block, width)
        product = callMLlibFunc("getMatrixBlocks", projected(spark, whole, weights)._java_matrix_wrapper._java_model)
        names = names.join(product.select(F.col("_1._1").cast("long").alias("block"), F.col("_2").alias("product")), "block")
    else:
        names = names.withColumn("product", F.lit(None).cast(MatrixUDT()))
    count, n = len(values), fitted.n

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, deviations, product in zip(*(batch.column(x) for x in ("ids", "deviations", "product"))):
                rows = len(ids)
                whitened = np.full((rows, count), np.nan)
                if product.is_valid:
                    flat = product["values"].values.to_numpy(zero_copy_only=False)
                    shape = (product["numRows"].as_py(), product["numCols"].as_py())
                    made = flat.reshape(shape, order="C" if product["isTransposed"].as_py() else "F")
                    whitened[:, : shape[1]] = made[:rows]
                again = pa.array(np.repeat(np.arange(rows), count))
                flat = whitened.reshape(-1)
                yield pa.record_batch(
                    [
                        ids.values.take(again),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                        pa.array(np.full(len(flat), n)),
                        deviations.values.take(again),
                        pa.array(flat, mask=np.isnan(flat)),
                        pa.array(shares * rows, pa.float64()),
                        pa.array([error] * len(flat), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return names.select("ids", "deviations", "product").mapInArrow(unfold, RESULT)
