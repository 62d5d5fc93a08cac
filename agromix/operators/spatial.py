"""Two-dimensional penalised splines as mixed-model terms: B-spline bases, difference penalties, tensor products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["PARTS", "Margin", "bspline_basis", "margin", "margins", "spatial_design", "spatial_terms", "tensor_bases", "tps"]


def bspline_basis(x: np.ndarray, low: float, high: float, segments: int, degree: int) -> np.ndarray:
    """B-splines on equal segments of [low, high], by the recursion of Cox and de Boor: len(x) x (segments + degree)."""
    step = (high - low) / segments
    knots = low + step * np.arange(-degree, segments + degree + 1)
    x = np.asarray(x, float)
    last = np.clip(np.floor((x - low) / step).astype(int), 0, segments - 1) + degree
    basis = np.zeros((len(x), len(knots) - 1))
    basis[np.arange(len(x)), last] = 1.0
    for d in range(1, degree + 1):
        n = len(knots) - 1 - d
        left = (x[:, None] - knots[None, :n]) / (d * step)
        right = (knots[None, d + 1 : d + 1 + n] - x[:, None]) / (d * step)
        basis = left * basis[:, :n] + right * basis[:, 1 : n + 1]
    return basis


@dataclass
class Margin:
    """One dimension: what turns coordinates into unpenalised columns 1, x, .. and penalised columns."""

    low: float
    high: float
    segments: int
    degree: int
    order: int
    penalised: np.ndarray
    values: np.ndarray

    def evaluate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = bspline_basis(x, self.low, self.high, self.segments, self.degree)
        centre, half = (self.low + self.high) / 2, (self.high - self.low) / 2
        null = ((np.asarray(x, float) - centre) / half)[:, None] ** np.arange(self.order)
        return null, b @ self.penalised


def margin(low: float, high: float, segments: int, degree: int = 3, order: int = 2) -> Margin:
    """Eigenvectors of the penalty D'D with positive values, scaled by their roots: penalised effects have unit variance."""
    if not high > low:
        raise ValueError("a dimension needs two places at least")
    d = np.diff(np.eye(segments + degree), n=order, axis=0)
    w, v = np.linalg.eigh(d.T @ d)
    keep = w > 1e-10 * w[-1]
    w, v = w[keep][::-1], v[:, keep][:, ::-1]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return Margin(low, high, segments, degree, order, v / np.sqrt(w), w)


def tensor_bases(x: Margin, y: Margin, xs: np.ndarray, ys: np.ndarray, nested: tuple[Margin, Margin] | None = None, method: str = "wood") -> dict[str, np.ndarray]:
    """Columns at points: fixed part "base" (without 1) and the random parts fC, fR, fC.R, C.fR, fC.fR.

    The last may use coarser margins (``nested``). Its penalty is the product of the margins' (``wood``) or their sum (``lee``).
    """
    xn, xp = x.evaluate(xs)
    yn, yp = y.evaluate(ys)
    a, b = nested or (x, y)
    both = (a.evaluate(xs)[1], b.evaluate(ys)[1]) if nested else (xp, yp)
    wide = np.ones(len(a.values) * len(b.values)) if method == "wood" else np.sqrt(np.outer(a.values, b.values) / np.add.outer(a.values, b.values)).ravel()
    row = lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)
    return {"base": row(xn, yn)[:, 1:], "fC": xp, "fR": yp, "fC.R": row(xp, yn[:, 1:]), "C.fR": row(xn[:, 1:], yp), "fC.fR": row(*both) * wide}


def _evaluate(x: Margin, y: Margin, parts: list[str], at: int, nested: tuple[Margin, Margin] | None, method: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (at, at + 1))
            made = tensor_bases(x, y, xs, ys, nested, method)
            arrays = [pa.array(list(made[p]), pa.list_(pa.float64())) for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *arrays], names=[*batch.schema.names[:at], *parts])

    return run


#: The fixed part and the five penalised ones of a tensor-spline surface.
PARTS = ("base", "fC", "fR", "fC.R", "C.fR", "fC.fR")


def margins(df: DataFrame, x_col: str, y_col: str, segments: tuple[int, int] | None = None, degree: tuple[int, int] = (3, 3), order: tuple[int, int] = (2, 2), nest: tuple[int, int] = (1, 1)) -> tuple[Margin, Margin, tuple[Margin, Margin] | None]:
    """The margins that spatial_design() evaluates, and the coarser ones of its last part if ``nest`` asks for them."""
    seen = df.agg(*(f(c) for c in (x_col, y_col) for f in (F.min, F.max, F.count_distinct)), F.max(F.col(x_col).isNull() | F.col(y_col).isNull())).first()
    if seen[6]:
        raise ValueError("rows without coordinates")
    segments = segments or (max(1, seen[2] - 1), max(1, seen[5] - 1))
    x, y = margin(float(seen[0]), float(seen[1]), segments[0], degree[0], order[0]), margin(float(seen[3]), float(seen[4]), segments[1], degree[1], order[1])
    nested = None
    if max(nest) > 1:
        nested = tuple(margin(m.low, m.high, max(1, m.segments // k), m.degree, m.order) for m, k in zip((x, y), nest, strict=True))
    return x, y, nested


def spatial_design(df: DataFrame, x_col: str, y_col: str, segments: tuple[int, int] | None = None, degree: tuple[int, int] = (3, 3), order: tuple[int, int] = (2, 2), nest: tuple[int, int] = (1, 1), method: str = "wood") -> DataFrame:
    """``df`` with the bases as array columns base, fC, fR, fC_R, C_fR, fC_fR, evaluated in parallel.

    Segments default to one less than the distinct values in each dimension. Only the range and count of the coordinates
    come to the driver. Rows without coordinates are refused. ``nest`` divides the segments of the interaction fC_fR, and
    ``method`` is that of tensor_bases().
    """
    if method not in ("wood", "lee"):
        raise ValueError("method is wood or lee")
    x, y, nested = margins(df, x_col, y_col, segments, degree, order, nest)
    parts = list(PARTS)
    rows = df.withColumns({"_x": F.col(x_col).cast("double"), "_y": F.col(y_col).cast("double")})
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{p}` array<double>" for p in parts)])
    out = rows.mapInArrow(_evaluate(x, y, parts, len(df.columns), nested, method), schema)
    return out.withColumnsRenamed({p: p.replace(".", "_") for p in parts})


def tps(df: DataFrame, col: str, row: str, segments: tuple[int, int] | None = None, degree: tuple[int, int] = (3, 3), order: tuple[int, int] = (2, 2), nest: tuple[int, int] = (1, 1), method: str = "lee") -> DataFrame:
    """Tensor-product P-splines as model terms: spatial_design() with the column All, every basis in one array, for a model with one variance.

    Coordinates may repeat; segments are one less than the distinct places of each dimension unless given.
    """
    made = spatial_design(df, col, row, segments, degree, order, nest, method)
    return made.withColumn("All", F.concat("base", "fC", "fR", "fC_R", "C_fR", "fC_fR"))


def spatial_terms(at: str | None = None) -> tuple[str, str]:
    """Fixed and random formula parts for the columns of spatial_design(): five variance components, by level of ``at`` if given."""
    wrap = (lambda x: f"vsc(dsc({at}), isc(basis({x})))") if at else (lambda x: f"vsc(isc(basis({x})))")
    return "basis(base)", " + ".join(wrap(x) for x in ("fC", "fR", "fC_R", "C_fR", "fC_fR"))
