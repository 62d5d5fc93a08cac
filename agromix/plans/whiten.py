"""Residuals that are correlated within groups of records, by a weight matrix for each group.

A weight matrix is the inverse of the records' covariance up to the residual variance. With W = LL', the records L'y and
design L'X have independent residuals, so every fit goes on as before. Groups are bounded and whitened where their records
are, one group a call; only cross-products leave the tasks, as always.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agromix.plans.design import ENTRY, Design, Gram, gram_of

__all__ = ["Weights", "ar1_weights", "block_weights", "whitened_gram"]

#: Records of a group at most, as its weights are a dense matrix in a task.
MOST = 2000


@dataclass
class Weights:
    """``cells`` (group, row, col, value): the weight matrices' cells, both triangles; records are named by ``within`` in ``group``."""

    cells: DataFrame
    group: str
    within: str


def ar1_weights(df: DataFrame, group: str, order: str, rho: float) -> Weights:
    """Inverse first-order autoregressive correlations of the records of each group, taken in ``order`` (unique within a group)."""
    if not -1 < rho < 1:
        raise ValueError("rho lies between -1 and 1")
    run = Window.partitionBy(group).orderBy(order)
    rows = df.select(F.col(group).alias("group"), F.col(order).alias("row"), F.lag(order).over(run).alias("last"), F.lead(order).over(run).alias("next"))
    scale = 1 / (1 - rho * rho)
    inner = F.when(F.col("last").isNull() & F.col("next").isNull(), 1.0).when(F.col("last").isNull() | F.col("next").isNull(), scale).otherwise((1 + rho * rho) * scale)
    cell = lambda col, value: F.struct(F.col(col).alias("col"), value.cast("double").alias("value"))
    cells = rows.select("group", "row", F.inline(F.filter(F.array(cell("row", inner), cell("last", F.lit(-rho * scale)), cell("next", F.lit(-rho * scale))), lambda x: x["col"].isNotNull())))
    return Weights(cells, group, order)


def block_weights(df: DataFrame, group: str, within: str, value: Column) -> Weights:
    """One weight for each record, as a matrix: what a column of weights is."""
    return Weights(df.select(F.col(group).alias("group"), F.col(within).alias("row"), F.col(within).alias("col"), value.cast("double").alias("value")), group, within)


def _whitened(left: pa.Table, right: pa.Table) -> pa.Table:
    """The records of one group (key, entries, y, level) after L', with the logarithms that make up W's determinant."""
    shape = pa.schema([("_entries", pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())]))), ("_y", pa.float64()), ("_w", pa.float64()), ("_level", pa.string()), ("_log", pa.float64())])
    if not left.num_rows and not right.num_rows:
        return shape.empty_table()
    keys = left.column("key").to_pylist()
    place = {k: n for n, k in enumerate(keys)}
    if len(place) < len(keys):
        raise ValueError("records of a group are not told apart by their names")
    w = np.zeros((len(keys), len(keys)))
    for a, b, v in zip(*(right.column(c).to_pylist() for c in ("row", "col", "value")), strict=True):
        if a not in place or b not in place:
            raise ValueError("weights of records that are not in the data; leave these out of the weights' covariance first")
        w[place[a], place[b]] += v
    if len(keys) > MOST:
        raise ValueError(f"a group of over {MOST} records")
    if np.abs(w - w.T).max() > 1e-9 * max(np.abs(w).max(), 1e-300):
        raise ValueError("weight matrices are symmetric")
    try:
        factor = np.linalg.cholesky(w)
    except np.linalg.LinAlgError:
        raise ValueError("weight matrices are positive definite, with a weight for every record") from None
    entries = left.column("entries").to_pylist()
    used = sorted({e["i"] for row in entries for e in row})
    at = {i: n for n, i in enumerate(used)}
    x = np.zeros((len(keys), len(used)))
    for r, row in enumerate(entries):
        for e in row:
            x[r, at[e["i"]]] += e["v"]
    x, y = factor.T @ x, factor.T @ left.column("y").to_numpy()
    out = [[{"i": i, "v": float(v)} for i, v in zip(used, row, strict=True) if v] for row in x]
    return pa.Table.from_arrays([pa.array(out, shape.field(0).type), pa.array(y), pa.array(np.ones(len(keys))), left.column("level").combine_chunks(), pa.array(2 * np.log(np.diag(factor)))], schema=shape)


def whitened_gram(design: Design, weights: Weights) -> Gram:
    """gram_of() of the whitened records. Groups of over MOST records are refused before any is built."""
    if len(design.levels) != 1:
        raise ValueError("weight matrices go with one residual variance")
    rows = design.rows.filter("_y is not null").select(F.col(weights.group).alias("group"), F.col(weights.within).alias("key"), F.col("_entries").cast(ENTRY).alias("entries"), F.col("_y").alias("y"), F.col("_level").alias("level"))
    largest = rows.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    if largest > MOST:
        raise ValueError(f"a group of {largest} records; weights are matrices of {MOST} at most")
    made = rows.groupBy("group").cogroup(weights.cells.groupBy("group")).applyInArrow(_whitened, f"_entries {ENTRY}, _y double, _w double, _level string, _log double")
    gram = gram_of(replace(design, rows=made, numeric=True, plain=None))
    logs = made.agg(F.sum("_log")).first()[0] or 0.0
    return Gram(gram.sums, gram.records, {k: v + logs for k, v in gram.log_weights.items()})
