"""Whitening of embeddings with distributed block matrices.

Each entry c of a vector becomes the whole number x = floor(1024 * c) + 100000. Rows are numbered by
prefix sums of the rows of each written partition, centred, and indexed into an `IndexedRowMatrix`,
which becomes a `BlockMatrix` of `BLOCK_ROWS` rows a block. The transpose times the matrix gives the
scatter; the row blocks are dealt to `splits` groups first, so that no task receives more than
`BLOCKS_A_TASK` blocks and only matrices of dimension by dimension are added up. The eigenvectors of
that small matrix are found on the driver, and the block matrix times the whitening matrix projects
every row. Only sums, one count a partition, block numbers and the small scatter reach the driver.

Null vectors and vectors with null or non-finite entries are left out; so are empty vectors and those
whose length is not the commonest one (the longer of equally common ones). Repeated rows and null ids
are rows of their own. Components without variance (an eigenvalue of at most 1e-12 of the largest)
are not given, so a single row or equal rows give no result, and neither does an empty table.
Only the two named columns are read; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS, BLOCKS_A_TASK = 1024, 16
SCALE, SHIFT = 1024, 100_000
RESULT = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double")


def usable(vector: Column) -> Column:
    """Is every entry a finite number?"""
    finite = F.forall(vector, lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def scaled(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """place (unique and rising within a partition), vec_id and the whole numbers x of the usable vectors."""
    good = vectors.filter(usable(F.col(vector)))
    lengths = good.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    same_length = good.filter(F.size(vector) == F.lit(lengths.dim if lengths else 0))
    x = F.transform(F.col(vector), lambda e: F.floor(e.cast("double") * SCALE).cast("long") + SHIFT)
    return same_length.select(F.monotonically_increasing_id().alias("place"), F.col(key).cast("long").alias("vec_id"), x.alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with index 0, 1, ...: what the partitions before hold, plus the place inside the partition."""
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())
    starts = np.cumsum([0, *[c for _, c in counts]])
    table = rows.sparkSession.createDataFrame([(int(p), int(s)) for (p, _), s in zip(counts, starts)], "part long, start long")
    return rows.join(F.broadcast(table), part == F.col("part")).withColumn("index", F.col("start") + at).drop("part", "start")


def _numbers(values, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def _blocks(rows: DataFrame, n: int, dim: int) -> BlockMatrix:
    """rows (index, array v) as a block matrix."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(indexed, n, dim).toBlockMatrix(BLOCK_ROWS, dim)


def scatter(blocks: BlockMatrix, n: int) -> np.ndarray:
    """Transpose times matrix; the shared dimension is split so that no task holds all blocks."""
    splits = max(1, -(-n // (BLOCK_ROWS * BLOCKS_A_TASK)))
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def project(blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """(index, array whitened): every row of the block matrix times a small local matrix."""
    sc = blocks.blocks.context
    small = BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(*matrix.shape, matrix.flatten(order="F")))], 1), *matrix.shape)
    product = blocks.multiply(small).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("whitened"))


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest entry of the covariance of the first k whitened columns minus the identity."""
    mean = rows.agg(*[F.avg(F.col("whitened")[i]) for i in range(k)]).first()
    centred = rows.select(*[(F.col("whitened")[i] - F.lit(mean[i])).alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = centred.agg(*[F.avg(F.col(f"w{i}") * F.col(f"w{j}")) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(cov, pairs))


def whiten(vectors: DataFrame, components: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per usable vector and component, as `RESULT` names them."""
    spark = vectors.sparkSession
    rows = stored(scaled(vectors, vector, key), "scaled")
    first = rows.select(F.size("x").alias("dim")).first()
    if first is None:
        return spark.createDataFrame([], RESULT)
    dim = first.dim
    n, *sums = rows.agg(F.count("*"), *[F.sum(F.col("x")[i]) for i in range(dim)]).first()
    rows = numbered(rows)
    mean = _numbers([s / n for s in sums], "double")
    blocks = _blocks(rows.select("index", F.zip_with("x", mean, lambda v, m: v - m).alias("v")), n, dim)
    covariance = scatter(blocks, n) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:components] > max(values[0], 0) * 1e-12).sum())
    if k == 0:
        return spark.createDataFrame([], RESULT)
    projected = project(blocks, axes[:, :k] / np.sqrt(values[:k]))
    wide = F.zip_with("x", _numbers(sums, "long"), lambda v, s: (v * n - s).cast("decimal(19,0)"))
    deviation = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d * d).cast("decimal(38,0)"))
    done = stored(rows.select("index", "vec_id", deviation.alias("deviation")).join(projected, "index").drop("index"), "whitened")
    explained = _numbers((values[:k] / values.sum()).tolist(), "double")
    error = identity_error(done, k)
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
