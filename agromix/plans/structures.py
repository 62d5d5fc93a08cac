"""Constraint matrices, covariance vectors and loadings that model terms take."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agromix.operators.matrices import MAX_ORDER, dense, nearest_pd

__all__ = ["fcm", "fixm", "reduced_loadings", "reduced_rank", "transform_constraints", "unsm", "vector_to_symmetric"]

#: Codes of a covariance parameter.
LEFT_OUT, POSITIVE, FREE, FIXED = 0, 1, 2, 3


def unsm(n: int, reps: int | None = None):
    """Unstructured: positive on the diagonal, free off it; a list of ``reps`` if given."""
    one = np.where(np.eye(n, dtype=bool), POSITIVE, FREE)
    return one if reps is None else [one.copy() for _ in range(reps)]


def fixm(n: int) -> np.ndarray:
    """All parameters held at their start."""
    return np.full((n, n), FIXED)


def fcm(flags: Sequence[int], reps: int | None = None):
    """Selector of traits for a fixed effect: the identity's columns where the flag is not 0."""
    one = np.eye(len(flags))[:, [i for i, x in enumerate(flags) if x]]
    return one if reps is None else [one.copy() for _ in range(reps)]


def vector_to_symmetric(values: Sequence[float]) -> np.ndarray:
    """A symmetric matrix from its upper triangle by columns; the length must be triangular."""
    n = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
    if n * (n + 1) // 2 != len(values):
        raise ValueError(f"{len(values)} values do not fill a triangle")
    out, at = np.zeros((n, n)), 0
    for j in range(n):
        for i in range(j + 1):
            out[i, j] = out[j, i] = values[at]
            at += 1
    return out


def transform_constraints(codes: dict[str, np.ndarray], value: int = POSITIVE) -> dict[str, np.ndarray]:
    """All codes but 0 set to ``value``."""
    return {k: np.where(np.asarray(v) != LEFT_OUT, value, LEFT_OUT) for k, v in codes.items()}


def reduced_rank(table: DataFrame, row: str, column: str, value: str, n_pc: int = 2, cholesky: bool = True) -> tuple[list[str], np.ndarray]:
    """Loadings of the columns of a two-way table (long form), for rrc(): (levels of ``column``, levels x n_pc).

    The covariance of the scaled columns, gaps filled by their mean, is summed by Spark over pairs of columns of a row;
    its nearest positive definite matrix gives loadings from the Cholesky factor or the leading singular vectors.
    """
    stats = table.groupBy(column).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    names = [r[0] for r in stats.select(F.col(column).cast("string")).orderBy(column).limit(MAX_ORDER + 1).collect()]
    if len(names) > MAX_ORDER:
        raise ValueError(f"over {MAX_ORDER} columns")
    n_rows = table.select(row).distinct().count()
    z = table.join(F.broadcast(stats), column).select(F.col(row).alias("r"), F.col(column).cast("string").alias("c"), F.coalesce((F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0)), F.lit(0.0)).alias("z"))
    a, b = (z.select("r", F.col("c").alias(k), F.col("z").alias(f"z{k}")) for k in ("row", "col"))
    sums = a.join(b, "r").groupBy("row", "col").agg((F.sum(F.col("zrow") * F.col("zcol")) / max(n_rows - 1, 1)).alias("value"))
    _, cov = dense(sums, sorted(names))
    cov = nearest_pd(cov)
    if cholesky:
        gamma = np.linalg.cholesky(cov)[:, :n_pc]
    else:
        u, d, _ = np.linalg.svd(cov)
        gamma = (u * np.sqrt(d))[:, :n_pc]
        gamma = gamma * np.sign(gamma[np.abs(gamma).argmax(axis=0), np.arange(gamma.shape[1])])
    return sorted(names), gamma


def reduced_loadings(kernel: DataFrame, n_pc: int = 50) -> tuple[list[str], np.ndarray]:
    """Loadings L of individuals with L L' close to a kernel M M', for redmm(): its leading eigenvectors, scaled."""
    levels, k = dense(kernel)
    w, v = np.linalg.eigh(k)
    top = np.argsort(-w)[: n_pc or len(w)]
    gamma = v[:, top] * np.sqrt(np.maximum(w[top], 0))
    return levels, gamma * np.sign(gamma[np.abs(gamma).argmax(axis=0), np.arange(gamma.shape[1])])
