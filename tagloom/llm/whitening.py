"""Whitening of embeddings with distributed block matrices.

Entries become integers x = floor(256 c), so sums and deviations are exact. Equal rows of integers count once: the
distinct ones, the fit list, are packed into blocks of rows, centred, and read as an MLlib ``BlockMatrix`` A. Its
scatter is transpose(A) times A, split over the cluster along the rows; the eigenvectors of that one matrix of
dimension x dimension are local; A times the whitening matrix projects all rows, and the projection's own transpose
product says how far its covariance is from the identity. A last short block is filled with rows of zeros, which add
nothing to a product of centred rows.

Edge cases: a null vector, and one with null or non-finite entries, is dropped; so is an empty one, one of another
length than most (of two lengths that are as common the larger stays), and one with an entry of 2^40 and more, whose
integers no long could sum. Repeated rows come back each, but count once in the fit; so do rows that differ but by
less than 1/256. Null ids are kept as any other. A component without variance (an eigenvalue under 1e-12 of the
trace: constant or dependent dimensions, or one distinct row) has a null ``whitened`` and is left out of
``identity_error``; without any variance ``explained`` and ``identity_error`` are null. Where ``deviation`` is beyond a long,
it is null. Fewer dimensions than components give as many rows as there are dimensions. An empty table gives
an empty result. Ties between equal eigenvalues leave any rotation of their vectors right. Columns other than the
id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, join_spread, lean

SCALE = 256
TOO_LARGE = 1 << 40
BLOCK_ROWS = 1024
BLOCK_NUMBERS = 1 << 20  # of a block at most: 8 MB
NO_VARIANCE = 1e-12

_INDEX = T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])
_MATRIX = "struct<type: tinyint, numRows: int, numCols: int, colPtrs: array<int>, rowIndices: array<int>, values: array<double>, isTransposed: boolean>"
_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array of bigint), key (sha256 of x) of the rows without a null or non-finite entry."""
    c = F.col("v")
    fine = F.forall(c, lambda e: F.coalesce((e > -TOO_LARGE) & (e < TOO_LARGE) & ~F.isnan(e), F.lit(False)))
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    x = F.transform(c, lambda e: F.floor(e * SCALE).cast("bigint"))
    rows = rows.where(F.coalesce(fine & (F.size(c) > 0), F.lit(False))).select("vec_id", x.alias("x"))
    return rows.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)))


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _pack(rows: int, width: int):
    """Blocks of up to ``rows`` rows of a task, as its partition and the block's number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, keys, members, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def emit() -> pa.RecordBatch:
            x = np.concatenate(held)
            columns = [[part], [block], [len(x)], [x.ravel()], [np.concatenate(keys)], [np.concatenate(members)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "k", "m", "xs", "ks", "members"])

        for batch in batches:
            x, key = _lists(batch.column(0), width), np.array(batch.column(1).to_pylist(), object)
            count = np.asarray(batch.column(2))
            at = 0
            while at < len(x):
                stop = min(len(x), at + rows - n)
                held.append(x[at:stop])
                keys.append(key[at:stop])
                members.append(count[at:stop])
                n, at = n + stop - at, stop
                if n == rows:
                    yield emit()
                    block, held, keys, members, n = block + 1, [], [], [], 0
        if n:
            yield emit()

    return lean(run)


def _sums(width: int):
    """Sums of the entries' upper and lower halves, as neither overflows: one row of each dimension a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _lists(batch.column(0), width)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    return run


def _centre(rows: int, width: int, n: int, sums: list[int]):
    """Centred blocks in the layout of MLlib's matrices (by column), and each row's exact deviation."""
    mean = np.array([s / n for s in sums])
    small = max(map(abs, sums)) < 1 << 62
    total = np.array(sums if small else [0] * width, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, values, devs = np.asarray(batch.column(0)), [], []
            for row in range(batch.num_rows):
                x = _lists(batch.column(1).slice(row, 1), width)
                centred = np.zeros((rows, width))
                centred[: len(x)] = x - mean
                values.append(centred.ravel("F"))
                # n x - S is n times the centred entry: its size tells whether longs can hold the squares
                if small and n * int(np.abs(x).max()) < 1 << 62 and (n * np.abs(centred)).max() ** 2 * width < 2.0**62:
                    off = n * x - total
                    devs.append((off * off).sum(1).tolist())
                else:
                    wide = [sum((n * int(e) - s) ** 2 for e, s in zip(own, sums, strict=True)) for own in x]
                    devs.append([d if d < 1 << 63 else None for d in wide])
            m = batch.num_rows
            matrix = pa.StructArray.from_arrays(
                [
                    pa.array([1] * m, pa.int8()), pa.array([rows] * m, pa.int32()), pa.array([width] * m, pa.int32()),
                    pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array([False] * m),
                ],
                names=["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"],
            )
            index = pa.StructArray.from_arrays([pa.array(blocks, pa.int64()), pa.array([0] * m, pa.int64())], names=["_1", "_2"])
            yield pa.RecordBatch.from_arrays(
                [index, matrix, batch.column(2), pa.array(devs, pa.list_(pa.int64())), batch.column(3)], names=["_1", "_2", "ks", "devs", "members"]
            )

    return lean(run)


def block_matrix(ws: Workspace, name: str, shape: tuple[int, int], block: tuple[int, int]) -> BlockMatrix:
    """The matrix whose blocks are the columns _1 (index) and _2 of a kept table; a lost executor's are read again."""
    typed = T.StructType([T.StructField("_1", _INDEX), T.StructField("_2", MatrixUDT())])
    blocks = ws.spark.read.schema(typed).parquet(f"{ws.root}/{name}")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, *block, *shape), *block)


def scatter(a: BlockMatrix, splits: int) -> np.ndarray:
    """transpose(a) x a, its rows dealt to ``splits`` tasks and summed."""
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def spectrum(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit vectors as columns."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    return e[::-1], v[:, ::-1]


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component; see the module."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "whitening")
    rows = ws.keep(quantise(vectors, id_col, vector_col), "rows")
    widths = rows.groupBy(F.size("x").alias("width")).count()
    most = widths.orderBy(F.desc("count"), F.desc("width")).first()
    if most is None:
        return spark.createDataFrame([], _RESULT)
    width = most["width"]
    rows = rows.where(F.size("x") == width)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    deep = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // width, -(-most["count"] // tasks)))
    # equal rows meet in partial sums before the shuffle
    fit = rows.groupBy("x", "key").agg(F.count(F.lit(1)).alias("members"))
    packed = ws.keep(
        fit.select("x", "key", "members").mapInArrow(_pack(deep, width), "part int, k int, m int, xs array<bigint>, ks array<binary>, members array<bigint>"), "packed"
    )
    halves = packed.select("xs").mapInArrow(_sums(width), "i bigint, high bigint, low bigint")
    total = halves.groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    sums = [(int(r.high) << 32) + int(r.low) for r in total.orderBy("i").collect()]  # a row a dimension
    # a row for each task that packed: its blocks come after those of the tasks before
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = packed.groupBy("part").agg(F.count(F.lit(1)).alias("blocks")).select("part", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("base"))
    counts = packed.agg(F.count(F.lit(1)).alias("blocks"), F.sum("m").alias("n")).first()
    n, high = int(counts.n), int(counts.blocks)
    placed = packed.join(bases, "part").select((F.col("base") + F.col("k")).alias("block"), "xs", "ks", "members")
    centred = ws.keep(
        placed.mapInArrow(
            _centre(deep, width, n, sums), f"_1 struct<_1: bigint, _2: bigint>, _2 {_MATRIX}, ks array<binary>, devs array<bigint>, members array<bigint>"
        ),
        "centred",
    )
    a = block_matrix(ws, "centred", (high * deep, width), (deep, width))
    splits = min(high, tasks)
    values, axes = spectrum(scatter(a, splits) / n)
    trace = float(values.sum())
    take = min(components, width)
    real = int((values[:take] > NO_VARIANCE * trace).sum()) if trace > 0 else 0
    error = None
    if real:
        whitening = axes[:, :real] / np.sqrt(values[:real])
        single = [(0, 0), (1, width, real, None, None, whitening.ravel("F").tolist(), False)]
        ws.keep(spark.createDataFrame([tuple(single)], f"_1 struct<_1: bigint, _2: bigint>, _2 {_MATRIX}"), "whitening")
        w = block_matrix(ws, "whitening", (width, real), (width, real))
        # the blocks of a product are those of its own type; the kept table is read as both matrices and numbers
        product = callMLlibFunc("getMatrixBlocks", a.multiply(w)._java_matrix_wrapper._java_model)
        product.select(F.struct(F.col("_1._1").cast("bigint").alias("_1"), F.col("_1._2").cast("bigint").alias("_2")).alias("_1"), "_2").write.parquet(f"{ws.root}/projected")
        ws.adopt("projected")
        y = block_matrix(ws, "projected", (high * deep, real), (deep, real))
        error = float(np.abs(scatter(y, splits) / n - np.eye(real)).max())
        numbers = spark.read.schema("_1 struct<_1: bigint>, _2 struct<values: array<double>>").parquet(f"{ws.root}/projected")
        numbers = numbers.select(F.col("_1._1").alias("block"), F.col("_2.values").alias("y"))
    else:
        numbers = centred.select(F.col("_1._1").alias("block"), F.array().cast("array<double>").alias("y"))
    # one row a block of the fit list meets its projection, then each distinct row's facts meet its copies
    facts = (
        centred.select(F.col("_1._1").alias("block"), "ks", "devs", "members")
        .join(numbers, "block")
        .select("y", F.posexplode(F.arrays_zip("ks", "devs", "members")).alias("at", "f"))
        .select(
            F.col("f.ks").alias("key"), F.col("f.devs").alias("deviation"), F.col("f.members").alias("members"),
            F.array(*[F.get("y", F.lit(c * deep) + F.col("at")) for c in range(take)]).alias("w"),
        )
    )
    facts = ws.keep(facts, "facts")
    joined = join_spread(rows.select("vec_id", "key"), facts, ["key"], "members", most["count"])
    explained = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values[:take]])
    out = joined.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened")).select(
        "vec_id",
        (F.col("c") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("c")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
    return ws.result(out)
