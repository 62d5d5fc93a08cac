"""Smooth surfaces whose coefficients have several penalties each: REML where a precision is a sum over variances.

The penalised columns of a tensor product are penalised along both dimensions at once. Such a coefficient's precision is
d_x / v_x + d_y / v_y, which no covariance of a mixed model with one variance a term can say. All penalties are diagonal
in the bases of spatial_design(), so the likelihood and its slopes follow from the cross-products of one job, and Newton
steps on the logarithms of the variances go on from there. SAP (Rodriguez-Alvarez et al. 2015) has one variance for each
direction, SAP.ANOVA separate ones for main effects and interactions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agromix.operators.spatial import PARTS, margins, spatial_design
from agromix.plans.design import Gram, build_design, gram_of
from agromix.plans.formula import parse_formula, parse_terms
from agromix.plans.reml import ascend, independent_columns

__all__ = ["PenalisedFit", "SmoothModel", "fit_penalised", "sap"]

#: Logarithms of variances, relative to the residual one, stay within these bounds.
BOUND = 25.0


@dataclass
class PenalisedFit:
    """Variances of the penalties and of the residuals, with what they came from; ``ed`` are effective dimensions."""

    variances: np.ndarray
    residual: float
    ed: np.ndarray
    loglik: float
    slope: np.ndarray
    converged: bool
    iterations: int
    kept: np.ndarray
    solution: np.ndarray


def fit_penalised(gram: Gram, n_fixed: int, weights: np.ndarray, iterations: int = 200, tol: float = 1e-7) -> PenalisedFit:
    """REML for y = Xb + Zu + e, where the precision of u_j is the sum over k of weights[j, k] / v_k.

    Cross-products are of X, then Z, then y; every u_j needs one positive weight at least.
    """
    sums, n = sum(gram.sums.values()), sum(gram.records.values())
    logs = sum(gram.log_weights.values())
    if (weights < 0).any() or not (weights.sum(axis=1) > 0).all():
        raise ValueError("a coefficient without a penalty is a fixed one")
    kept = independent_columns(sums[:n_fixed, :n_fixed])
    columns = np.append(kept, np.arange(n_fixed, len(sums) - 1)).astype(int)
    m, r, yy = sums[np.ix_(columns, columns)], sums[columns, -1], sums[-1, -1]
    at, k = len(kept), weights.shape[1]
    if n <= at:
        raise ValueError(f"{n} records do not tell {at} fixed coefficients apart from error")

    def state(par: np.ndarray) -> dict | None:
        """Likelihood and slopes at (log v_k / v_e, log v_e)."""
        left, tau = np.exp(par[-1]), np.exp(-par[:-1])
        p = weights @ tau
        c = m.copy()
        c[range(at, len(c)), range(at, len(c))] += p
        try:
            chol = np.linalg.cholesky(c)
        except np.linalg.LinAlgError:
            return None
        inverse = np.linalg.inv(c)
        b = inverse @ r
        rss = yy - r @ b  # y'Py times the residual variance
        logdet = 2 * np.log(np.diag(chol)).sum() - np.log(p).sum() + (n - at) * par[-1] - logs
        u, d = b[at:], np.diag(inverse)[at:]
        share = weights * tau  # of each coefficient's precision, by penalty
        ed = share.T @ (1 / p - d)
        slope = np.append(-0.5 * (ed - share.T @ u**2 / left), -0.5 * (n - at - rss / left))
        return {"loglik": float(-0.5 * (logdet + rss / left)), "slope": slope, "ed": ed, "b": b}

    rss0 = yy - r[:at] @ np.linalg.solve(m[:at, :at], r[:at]) if at else yy
    par = np.append(np.zeros(k), np.log(max(0.5 * rss0 / (n - at), 1e-300)))
    now, converged, cycle = state(par), False, 0
    if now is None or not np.isfinite(now["loglik"]):
        raise ValueError("the cross-products are not those of real columns")
    while cycle < iterations:
        cycle += 1
        held = np.append(((par[:-1] <= -BOUND) & (now["slope"][:-1] < 0)) | ((par[:-1] >= BOUND) & (now["slope"][:-1] > 0)), False)
        slope, curve, h = np.where(held, 0.0, now["slope"]), np.zeros((k + 1, k + 1)), 1e-4
        for i in range(k + 1):  # a few parameters: differences of exact slopes
            e = np.eye(k + 1)[i] * h
            curve[i] = -(state(par + e)["slope"] - state(par - e)["slope"]) / (2 * h)
        curve = (curve + curve.T) / 2
        curve[held], curve[:, held] = 0.0, 0.0
        curve[held, held] = 1.0
        step = np.where(held, 0.0, np.clip(ascend(slope, curve, np.ones(k + 1)), -3, 3))
        size, found = 1.0, None
        while size > 1e-8:
            new = par + size * step
            new[:-1] = np.clip(new[:-1], -BOUND, BOUND)
            other = state(new)
            if other is not None and other["loglik"] >= now["loglik"] - 1e-11 * (1 + abs(now["loglik"])):
                found = new, other
                break
            size /= 4
        if found is None:
            converged = float(slope @ step) < 1e-6
            break
        moved = float(np.abs(found[0] - par).max())
        par, now = found
        if moved < tol or float(slope @ step) < 1e-12:
            converged = True
            break
    solution = np.zeros(len(sums) - 1)
    solution[columns] = now["b"]
    left = float(np.exp(par[-1]))
    return PenalisedFit(np.exp(par[:-1]) * left, left, now["ed"], now["loglik"], now["slope"], converged, cycle, kept, solution)


@dataclass
class SmoothModel:
    """A fitted surface, or one for each level of ``at``."""

    rows: DataFrame
    fit: PenalisedFit
    names: list[str]
    columns: list[str]
    sizes: list[int]
    intercept: list[tuple[Column | None, float]]

    def summary(self) -> DataFrame:
        """Variances and effective dimensions: (component, var_comp, ed, converged)."""
        rows = [(n, float(v), float(e), self.fit.converged) for n, v, e in zip(self.names, self.fit.variances, self.fit.ed, strict=True)]
        return self.rows.sparkSession.createDataFrame([*rows, ("residual", self.fit.residual, None, self.fit.converged)], "component string, var_comp double, ed double, converged boolean")

    def fitted(self) -> DataFrame:
        """The rows with the surface and the level's mean (fitted), by native expressions."""
        total, at = F.lit(0.0), len(self.intercept)
        for level, value in self.intercept:
            total = total + (F.lit(value) if level is None else F.when(level, F.lit(value)).otherwise(0.0))
        for name, size in zip(self.columns, self.sizes, strict=True):
            coefficients = F.array(*[F.lit(float(x)) for x in self.fit.solution[at : at + size]])
            total = total + F.aggregate(F.zip_with(name, coefficients, lambda x, b: x * b), F.lit(0.0), lambda s, x: s + x)
            at += size
        return self.rows.withColumn("fitted", total).drop(*self.columns)


def sap(df: DataFrame, response: str, col: str, row: str, form: str = "SAP", at: str | None = None, segments: tuple[int, int] | None = None, degree: tuple[int, int] = (3, 3), order: tuple[int, int] = (2, 2), nest: tuple[int, int] = (1, 1)) -> SmoothModel:
    """A tensor-spline surface of ``response`` with overlapping penalties, one for each level of ``at`` if given.

    ``form`` is SAP (a variance for each direction) or SAP.ANOVA (for each main effect, and each direction of the
    interactions). Surfaces of different levels share the residual variance alone. Rows without a response or level don't
    count; rows without coordinates are refused. There is one job for the range, one for levels, one for cross-products.
    """
    if form not in ("SAP", "SAP.ANOVA"):
        raise ValueError("form is SAP or SAP.ANOVA")
    used = df.filter(F.col(response).isNotNull() & (F.col(at).isNotNull() if at else F.lit(True)))
    levels = [str(r[0]) for r in used.select(F.col(at).cast("string")).distinct().orderBy(at).limit(101).collect()] if at else [""]
    if len(levels) > 100:
        raise ValueError("over 100 levels of surfaces are not fitted at once")
    x, y, nested = margins(used, col, row, segments, degree, order, nest)
    rows = spatial_design(used, col, row, segments, degree, order, nest)
    a, b = nested or (x, y)
    wx, wy = np.repeat(a.values, len(b.values)), np.tile(b.values, len(a.values))
    one = lambda n: np.ones(n)
    nx, ny = len(x.values), len(y.values)
    # penalties of each part's columns along both directions; the last part's columns are scaled by the roots of both
    along = {"fC": (one(nx), 0 * one(nx)), "fR": (0 * one(ny), one(ny)), "fC_R": (one(nx * (y.order - 1)), 0 * one(nx * (y.order - 1))), "C_fR": (0 * one(ny * (x.order - 1)), one(ny * (x.order - 1))), "fC_fR": (1 / wy, 1 / wx)}
    kinds = ["x", "y"] if form == "SAP" else ["fC", "fR", "x", "y"]
    places = {p: (0, 1) if form == "SAP" or p in ("fC", "fR") else (2, 3) for p in along}
    made = [p.replace(".", "_") for p in PARTS]
    for k, level in enumerate(levels):
        for p in made:
            own = F.col(p) if not at else F.when(F.col(at).cast("string") == level, F.col(p)).otherwise(F.transform(p, lambda v: v * 0))
            rows = rows.withColumn(f"_{p}_{k}", own)
    rows = rows.drop(*made)
    if at:
        rows = rows.withColumn("_at", F.transform(F.array(*[F.lit(x) for x in levels]), lambda v: (v == F.col(at).cast("string")).cast("double")))
    fixed = " + ".join([*(["basis(_at)"] if at else []), *(f"basis(_base_{k})" for k in range(len(levels)))])
    random = [f"_{p}_{k}" for k in range(len(levels)) for p in made[1:]]
    formula = parse_formula(f"{response} ~ " + ("0 + " if at else "") + fixed)
    design = build_design(rows, response, formula.terms, formula.intercept, parse_terms("~ " + " + ".join(f"vsc(isc(basis({p})))" for p in random))[0])
    weights = np.zeros((sum(t.size for t in design.random), len(kinds) * len(levels)))
    start = 0
    for t, p in zip(design.random, random, strict=True):
        part, k = p[1:].rsplit("_", 1)
        for side in (0, 1):
            weights[start : start + t.size, int(k) * len(kinds) + places[part][side]] += along[part][side]
        start += t.size
    fit = fit_penalised(gram_of(design), sum(f.size for f in design.fixed), weights)
    names = [f"{n}" if not at else f"{level}:{n}" for level in levels for n in kinds]
    bases = [*(f"_base_{k}" for k in range(len(levels))), *random]
    sizes = [f.size for f in design.fixed[1:]] + [t.size for t in design.random]
    means = [(None if not at else F.col(at).cast("string") == level, float(fit.solution[k])) for k, level in enumerate(levels)]
    return SmoothModel(rows.drop("_at"), fit, names, bases, sizes, means)
