"""Whitening of embeddings with MLlib's BlockMatrix (operator 12).

Entries become integers, floor(256 c). The fit list, each different integer
vector once, is indexed, centred on its mean and dealt into distributed blocks;
the transpose times the matrix is the scatter, a local eigh of that (dimension
by dimension, independent of the number of rows) gives the components, and
the blocks of all rows times the whitening matrix are the projections.

MLlib's product sends all blocks that meet in one result block to one task unless the
middle dimension is split; it is split here so that a task adds up
a bounded number of row blocks.

Rows whose vector is null or holds a null or non-finite entry are dropped, and
empty vectors have no components. Vectors of each length are a table of their
own. Repeated rows count once in the fit and are all returned; rows without a
vec_id likewise. A component whose variance is zero (one different vector, or
fewer than four independent dimensions) has ``whitened`` null and no part in
``identity_error``, which is null where no component is left. ``deviation``
is null where it is beyond a long. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nutrilake.session import materialize

COMPONENTS, SCALE = 4, 256
#: Rows and columns of a block, and row blocks that one task adds up.
ROWS, COLUMNS, BLOCKS_A_TASK = 1024, 1024, 32


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` (longs) of the rows whose vector is whole."""
    def broken(c):
        return c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e")).where(F.col("e").isNotNull() & ~F.exists("e", broken))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``row`` (0, 1, ... without a gap) without a sort: the rows of the partitions before, and the place in its own. Also their number."""
    placed = materialize(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    upto = list(accumulate(counts[p] for p in sorted(counts)))
    starts = rows.sparkSession.createDataFrame(list(zip(sorted(counts), [0, *upto])), "_part long, _start long")
    numbered = placed.join(F.broadcast(starts), part == F.col("_part")).withColumn("row", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return numbered.drop("_at", "_part", "_start"), (upto or [0])[-1]


def totals(rows: DataFrame) -> list[int]:
    """The exact sum of each dimension."""
    found = rows.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast(T.DecimalType(38, 0))).alias("s"))
    return [int(r["s"]) for r in sorted(found.collect(), key=lambda r: r["d"])]  # one row a dimension


def block_matrix(rows: DataFrame, n: int, sums: list[int], n_rows: int) -> BlockMatrix:
    """The rows (``row``, ``x``) less the mean, as distributed blocks.

    Products read the blocks several times; they are kept while they are used, and made again from the checkpointed rows where an
    executor that held some is lost.
    """
    # x - S/n, rounded once: the whole parts cancel exactly before the fraction is taken off.
    whole, rest = F.array(*(F.lit(s // n) for s in sums)), F.array(*(F.lit(s % n / n) for s in sums))
    centred = F.zip_with(F.zip_with("x", whole, lambda c, w: (c - w).cast("double")), rest, lambda c, r: c - r)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n_rows, len(sums)).toBlockMatrix(ROWS, COLUMNS).persist(StorageLevel.MEMORY_AND_DISK)


def forget(blocks: BlockMatrix) -> None:
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)


def scatter(blocks: BlockMatrix, n_rows: int) -> np.ndarray:
    """The transpose times the matrix, added up in as many tasks as there are BLOCKS_A_TASK row blocks."""
    splits = max(1, -(-n_rows // (ROWS * BLOCKS_A_TASK)))
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, COLUMNS, COLUMNS).toLocalMatrix().toArray()


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit vectors (columns), those without variance left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    some = values > len(covariance) * np.finfo(float).eps * max(values[0], 0.0) if len(values) else np.zeros(0, bool)
    return values[some], vectors[:, some]


def project(spark: SparkSession, blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """``row`` and ``w``: the blocks times a small local matrix."""
    pieces = [((i, 0), DenseMatrix(len(p), p.shape[1], p.ravel(order="F"))) for i, lo in enumerate(range(0, len(matrix), COLUMNS))
              for p in [matrix[lo: lo + COLUMNS]]]
    right = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), COLUMNS, max(1, matrix.shape[1]), *matrix.shape)
    product = blocks.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model
    return callMLlibFunc("getIndexedRows", product).select(F.col("index").alias("row"), vector_to_array("vector").alias("w"))


def identity_error(whitened: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of ``w`` (over all its rows, centred) less the identity."""
    if not k:
        return None
    w = [F.element_at("w", i + 1) for i in range(k)]
    got = whitened.agg(*(F.covar_pop(w[i], w[j]) for i in range(k) for j in range(i, k))).first()
    want = [float(i == j) for i in range(k) for j in range(i, k)]
    return max(abs(a - b) for a, b in zip(got, want))


def whiten_length(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``whiten`` for the rows (``vec_id``, ``x``) of one length."""
    spark = rows.sparkSession
    fit, n = indexed(rows.select("x").distinct())
    sums = totals(fit)
    fit_blocks = block_matrix(fit, n, sums, n)
    covariance = scatter(fit_blocks, n) / n
    values, vectors = principal(covariance, components)
    matrix, trace = vectors / np.sqrt(values), float(np.trace(covariance))
    every, n_all = indexed(rows)
    exact = T.DecimalType(38, 0)
    apart = F.zip_with("x", F.array(*(F.lit(s).cast(exact) for s in sums)), lambda c, s: c.cast(exact) * F.lit(n).cast(exact) - s)
    squares = F.aggregate(apart, F.lit(0).cast(exact), lambda total, c: (total + c * c).cast(exact))
    every = every.withColumn("deviation", squares.try_cast("bigint"))
    if len(values):
        error = identity_error(project(spark, fit_blocks, matrix), len(values))
        blocks = block_matrix(every, n, sums, n_all)
        every = every.join(materialize(project(spark, blocks, matrix)), "row")
        forget(blocks)
    else:
        error = None
        every = every.withColumn("w", F.array().cast("array<double>"))
    forget(fit_blocks)
    kept = min(components, len(sums))
    explained = [float(v) / trace for v in values] + [0.0 if trace > 0 else None] * (kept - len(values))
    one = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("component"), F.get("w", F.lit(i)).alias("whitened"), F.lit(explained[i]).cast("double").alias("explained"))
                              for i in range(kept)))).alias("c")
    return every.select("vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", F.lit(error).cast("double").alias("identity_error"), one) \
        .select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", "identity_error")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each whole vector and component: the projection of its integers, whitened, and what the fit list says of the component."""
    rows = materialize(integer_vectors(vectors, vec_id, embedding).where(F.size("x") > 0))
    lengths = [r[0] for r in rows.groupBy(F.size("x")).count().collect()]  # one row a length; a table of embeddings has one
    parts = [whiten_length(rows.where(F.size("x") == length), components) for length in sorted(lengths)]
    if not parts:
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in [("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                                                                                 ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]))
    return reduce(DataFrame.unionByName, parts)
