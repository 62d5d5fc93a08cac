"""Factors of wide genotype tables, for genomic prediction with more genotypes than a kernel on the driver may have.

A kernel K = WW'/c of n genotypes is never formed. Random combinations of W's columns span its range (Halko, Martinsson and
Tropp 2011): Y = W Omega, k wide. From the small cross-products Y'Y and (Y'W)(Y'W)' follow W's singular values and the
scores US of all genotypes, exactly where k is at least W's rank. With u = US z and independent z, a genomic model of any
number of genotypes has k coefficients. Cells travel as rows of a genotype and a block of markers; all sums are Spark
aggregates, and only k x k matrices come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agromix.operators.kernels import dealt
from agromix.operators.matrices import MAX_ORDER
from agromix.plans.model import Model, mmec
from agromix.sources.scratch import written

__all__ = ["Factors", "gblup", "genotype_factors"]

#: Markers of a block, on average: what a row holds of a genotype, and the height of a task's random matrix.
BLOCK = 2048


@dataclass
class Factors:
    """``scores``: (id, scores: array, US / sqrt(scale)); ``share``: of W's sum of squares that they keep, 1 if all."""

    scores: DataFrame
    singular: np.ndarray
    share: float


@lru_cache(maxsize=4)
def _random(seed: int, block: int, height: int, k: int) -> np.ndarray:
    return np.random.default_rng((seed, block)).standard_normal((height, k))


def _rows(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _mixed(seed: int, height: int, k: int):
    """A genotype's cells of a block times the block's random matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, k))
            for r, block in enumerate(batch.column("block").to_pylist()):
                q, v = (batch.column(x)[r].values.to_numpy(zero_copy_only=False) for x in ("q", "v"))
                out[r] = v @ _random(seed, block, height, k)[q]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(out)], names=["id", "y"])

    return run


def _dense(batch: pa.RecordBatch, height: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with their cells of the only block as matrices, of 16 MB at most."""
    step = max(1, (16 << 20) // (8 * height))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        q, v = part.column("q"), part.column("v")
        place = np.repeat(np.arange(part.num_rows) * height, np.diff(q.offsets.to_numpy())) + q.flatten().to_numpy(zero_copy_only=False)
        yield part, np.bincount(place, v.flatten().to_numpy(zero_copy_only=False), part.num_rows * height).reshape(part.num_rows, height)


def _spanned(seed: int, height: int, k: int):
    """Y'Y (kind 0), W'Y (kind 1) and the cells' sum of squares (kind 2) of what a task reads, where all markers are one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yy, yw, total = np.zeros((k, k)), np.zeros((height, k)), np.zeros((1, 1))
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            total += v @ v
            for _, x in _dense(batch, height):
                y = x @ _random(seed, 0, height, k)
                yy += y.T @ y
                yw += x.T @ y
        for number, m in enumerate((yy, yw, total)):
            i, j = (x.ravel() for x in np.indices(m.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, number), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m.ravel())], names=["kind", "i", "j", "v"])

    return run


def _by_marker(height: int, k: int):
    """Y'W: what a task has of each marker, given out when it holds several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for block, sums in held.items():
                some = np.flatnonzero(np.abs(sums).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block), pa.int32()), pa.array(some, pa.int32()), _lists(sums[some])], names=["block", "q", "b"])
            held.clear()

        for batch in batches:
            y = _rows(batch, "y", k)
            for r, block in enumerate(batch.column("block").to_pylist()):
                if block not in held:
                    if len(held) >= max(1, (64 << 20) // (8 * height * k)):
                        yield from given()
                    held[block] = np.zeros((height, k))
                q, v = (batch.column(x)[r].values.to_numpy(zero_copy_only=False) for x in ("q", "v"))
                np.add.at(held[block], q, v[:, None] * y[r])
        yield from given()

    return run


def _squares(df: DataFrame, name: str, k: int) -> np.ndarray:
    """The sum of x x' over the arrays of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = _rows(batch, name, k)
            total += x.T @ x
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((k, k))
    for r in df.select(name).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _summed(df: DataFrame, keys: list[str], name: str, k: int) -> DataFrame:
    """The sums of arrays by key, place by place, so that partial sums are made before the shuffle."""
    places = [F.sum(F.get(name, F.lit(i))).alias(f"_{i}") for i in range(k)]
    return df.groupBy(*keys).agg(*places).select(*keys, F.array(*(F.col(f"_{i}") for i in range(k))).alias(name))


def genotype_factors(cells: DataFrame, id_col: str = "id", marker: str = "marker", value: str = "w", rank: int = 100, oversample: int = 10, scale: float = 1.0, seed: int = 1) -> Factors:
    """The ``rank`` largest singular values of W (long cells, absent ones 0) and every genotype's scores.

    ``rank + oversample`` random combinations are taken. If W's rank is no more than that, nothing is lost; else ``share``
    says how much of W's sum of squares is kept.
    """
    k = rank + oversample
    if rank > MAX_ORDER:
        raise ValueError(f"over {MAX_ORDER} factors do not fit the driver")
    names = written(cells.select(marker).filter(F.col(marker).isNotNull()).distinct())  # found once, as each look at the cells makes them anew
    n_markers = names.count()
    blocks = -(-(n_markers or 1) // BLOCK)
    columns = written(dealt(names, marker, blocks, "_b", "_q"))
    height = (columns.agg(F.max("_q")).first()[0] or 0) + 1
    k = min(k, n_markers or 1)
    packed = cells.join(columns, marker).groupBy(F.col(id_col).alias("id"), F.col("_b").alias("block")).agg(F.collect_list(F.struct(F.col("_q").alias("q"), F.col(value).cast("double").alias("v"))).alias("c"))
    packed = written(packed.select("id", "block", "c.q", "c.v"))  # lists of numbers pass to the tasks faster than lists of pairs
    kind = packed.schema["id"].dataType.simpleString()
    if blocks == 1:  # a genotype's cells are one row: its combinations are made again wherever they are needed, and nothing is joined
        spans = packed.select("q", "v").mapInArrow(_spanned(seed, height, k), "kind int, i int, j int, v double").groupBy("kind", "i", "j").agg(F.sum("v").alias("v")).toArrow()
        kinds, i, j, v = (spans.column(x).to_numpy() for x in ("kind", "i", "j", "v"))
        yy, yw = np.zeros((k, k)), np.zeros((height, k))
        yy[i[kinds == 0], j[kinds == 0]], yw[i[kinds == 1], j[kinds == 1]] = v[kinds == 0], v[kinds == 1]
        bb, y, total = yw.T @ yw, None, float(v[kinds == 2].sum())
    else:
        mixed = packed.select("id", "block", "q", "v").mapInArrow(_mixed(seed, height, k), f"id {kind}, y array<double>")
        y = written(_summed(mixed, ["id"], "y", k))
        sums = packed.join(y, "id").select("block", "q", "v", "y").mapInArrow(_by_marker(height, k), "block int, q int, b array<double>")
        yy, bb = _squares(y, "y", k), _squares(written(_summed(sums, ["block", "q"], "b", k)), "b", k)
        total = packed.select(F.explode("v").alias("v")).agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    if not total:
        return Factors((packed if y is None else y).select("id", F.array().cast("array<double>").alias("scores")), np.zeros(0), 1.0)
    w, v = np.linalg.eigh(yy)
    good = w > 1e-11 * w[-1]
    turn = v[:, good] / np.sqrt(w[good])  # Y turn has orthonormal columns
    s2, p = np.linalg.eigh(turn.T @ bb @ turn)
    order = [i for i in np.argsort(-s2)[:rank] if s2[i] > 1e-9 * s2[-1]]
    singular = np.sqrt(s2[order])
    to_scores = turn @ p[:, order] * (singular / np.sqrt(scale))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(_rows(batch, "y", k) @ to_scores)], names=["id", "scores"])

    share = float((singular**2).sum() / total)
    if y is not None:
        return Factors(written(y.mapInArrow(scored, f"id {kind}, scores array<double>")), singular, share)
    pull = _random(seed, 0, height, k) @ to_scores

    def scored_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _dense(batch, height):
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(x @ pull)], names=["id", "scores"])

    return Factors(packed.select("id", "q", "v").mapInArrow(scored_cells, f"id {kind}, scores array<double>"), singular, share)


def gblup(df: DataFrame, fixed: str, factors: Factors, id_col: str, variance: float | None = None, residual: float | None = None, **options) -> tuple[Model, DataFrame]:
    """(the model, (id, blup) of every genotype that has scores): y = Xb + Zu + e with u's covariance in proportion to K.

    ``variance`` of u with ``residual`` holds these; else both are estimated by REML.
    """
    held = {} if variance is None else {"theta": {"basis(scores)": [[variance]]}, "codes": {"basis(scores)": [[3]]}, "residual": {"units": residual}, "fixed_residual": True}
    rows = df.join(factors.scores.select(F.col("id").cast("string").alias("_id"), "scores"), F.col(id_col).cast("string") == F.col("_id")).drop("_id")
    model = mmec(rows, fixed, "~ basis(scores)", **held, **options)
    t = model.design.random[0]
    z = F.lit([float(x) for x in model.fit.solution[t.start : t.start + t.size]])
    value = F.aggregate(F.zip_with("scores", z, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return model, factors.scores.select("id", value.alias("blup"))
