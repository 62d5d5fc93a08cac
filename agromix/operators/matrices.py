"""Matrices as (row, col, value) DataFrames, and their small dense counterparts on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["MAX_ORDER", "dense", "from_dense", "hadamard", "inverse_triplet", "is_diagonal", "is_square", "nearest_pd", "trace", "triplet_to_matrix"]

#: Largest order of a matrix that may come to the driver.
MAX_ORDER = 3000


def triplet_to_matrix(df: DataFrame, row: str = "Row", col: str = "Column", value: str = "Ainverse") -> DataFrame:
    """A symmetric matrix from one triangle: both cells of each pair, duplicates off the diagonal not doubled."""
    cells = df.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col(value).cast("double").alias("value"))
    return cells.unionAll(cells.filter("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value")).distinct()


def trace(matrix: DataFrame) -> DataFrame:
    return matrix.filter("row = col").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("trace"))


def is_square(matrix: DataFrame) -> DataFrame:
    """Whether rows and columns have the same levels: one row (is_square)."""
    rows, cols = matrix.select(F.col("row").alias("l")).distinct(), matrix.select(F.col("col").alias("l")).distinct()
    apart = rows.join(cols, "l", "left_anti").unionAll(cols.join(rows, "l", "left_anti"))
    return apart.agg((F.count("*") == 0).alias("is_square"))


def is_diagonal(matrix: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Whether no cell off the diagonal exceeds ``tol`` in absolute value: one row (is_diagonal)."""
    return matrix.agg(F.coalesce(F.max(F.when((F.col("row") != F.col("col")) & (F.abs("value") > tol), 1)), F.lit(0)).alias("off")).select((F.col("off") == 0).alias("is_diagonal"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cellwise product of two matrices."""
    return a.join(b.withColumnRenamed("value", "_other"), ["row", "col"]).select("row", "col", (F.col("value") * F.col("_other")).alias("value"))


def dense(matrix: DataFrame, levels: Sequence[str] | None = None, most: int = MAX_ORDER) -> tuple[list[str], np.ndarray]:
    """The matrix on the driver with its sorted levels; refused beyond ``most`` levels. Absent cells are 0."""
    if levels is None:
        found = matrix.select(F.col("row").cast("string").alias("l")).union(matrix.select(F.col("col").cast("string"))).distinct().limit(most + 1).collect()
        levels = sorted(r["l"] for r in found)
    if len(levels) > most:
        raise ValueError(f"a matrix of order over {most} does not come to the driver")
    out = np.zeros((len(levels), len(levels)))
    cells = matrix.select(F.col("row").cast("string").alias("row"), F.col("col").cast("string").alias("col"), F.col("value").cast("double").alias("value")).toArrow()
    places = [pc.index_in(cells.column(x).combine_chunks(), pa.array(list(levels), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False) for x in ("row", "col")]
    known = (places[0] >= 0) & (places[1] >= 0)
    out[places[0][known], places[1][known]] = cells.column("value").to_numpy()[known]
    return list(levels), out


def from_dense(spark: SparkSession, levels: Sequence[str], values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(a, b, float(values[i, j])) for i, a in enumerate(levels) for j, b in enumerate(levels)], "row string, col string, value double")


def inverse_triplet(matrix: DataFrame, bend: float = 1e-6) -> DataFrame:
    """Inverse of a small symmetric matrix, ``bend`` added to its diagonal."""
    levels, values = dense(matrix)
    return from_dense(matrix.sparkSession, levels, np.linalg.inv(values + bend * np.eye(len(levels))))


def nearest_pd(a: np.ndarray, rounds: int = 100, floor: float = 1e-6, tol: float = 1e-7) -> np.ndarray:
    """The nearest positive definite matrix by alternating projections (Higham), the diagonal left free."""
    x, correction = (a + a.T) / 2, np.zeros_like(a)
    for _ in range(rounds):
        r = x - correction
        w, v = np.linalg.eigh(r)
        kept = (v * np.where(w > floor * max(w[-1], 0), w, 0)) @ v.T
        correction, last, x = kept - r, x, kept
        if np.abs(x - last).max() <= tol * max(np.abs(last).max(), 1e-300):
            break
    w, v = np.linalg.eigh((x + x.T) / 2)
    return (v * np.maximum(w, floor * max(w[-1], floor))) @ v.T
