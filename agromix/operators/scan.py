"""Marker scans: generalised least squares of every marker at the variance components of one fit."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agromix.functions.numeric import log_beta_tail
from agromix.operators.kernels import a_matrix
from agromix.operators.matrices import MAX_ORDER, dense
from agromix.plans.absorb import AbsorbedModel
from agromix.plans.model import Model, mmec

__all__ = ["gwas", "kinship_components", "scan_absorbed", "scan_markers", "scan_refits"]


def _tested(markers: pa.Array, t: np.ndarray, s: np.ndarray, good: np.ndarray, ypy: float, df: int) -> pa.RecordBatch:
    """Effects and tests of markers from m'Pm and m'Py; null where not ``good``."""
    beta = np.where(good, s / np.where(good, t, 1), np.nan)
    rest = (ypy - np.where(good, s * beta, 0)) / (df - 1)
    se = np.sqrt(np.where(good, rest / np.where(good, t, 1), np.nan))
    f = np.where(good, (beta / se) ** 2, np.nan)
    score = [None if not np.isfinite(x) else -log_beta_tail((df - 1) / 2, 0.5, (df - 1) / (df - 1 + x)) / math.log(10) for x in f]
    nullable = lambda x: pa.array([None if not np.isfinite(v) else float(v) for v in x], pa.float64())
    return pa.RecordBatch.from_arrays([markers, nullable(beta), nullable(se), nullable(f), pa.array(score, pa.float64())], names=["marker", "effect", "std_error", "f_value", "score"])


def _scanner(shared, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zpz, zpy, ypy, df = shared.value
        for batch in batches:
            index, values, n = batch.column(1), batch.column(2), batch.num_rows
            m = np.zeros((n, order))
            for k in range(n):
                m[k, index[k].values.to_numpy(zero_copy_only=False)] = values[k].values.to_numpy(zero_copy_only=False)
            t, s = np.einsum("ij,jk,ik->i", m, zpz, m, optimize=True), m @ zpy
            yield _tested(batch.column(0), t, s, t > 1e-9 * max(float(np.trace(zpz)), 1e-300), ypy, df)

    return run


def _dosages(markers: DataFrame, levels: list[str], min_maf: float, ploidy: int) -> DataFrame:
    """(marker, i, v): of each marker over ``min_maf`` the places of the genotypes among ``levels`` and their dosages, the median where missing."""
    index = markers.sparkSession.createDataFrame(list(enumerate(levels)), "i int, id string")
    x = F.col("dosage").cast("double")
    cells = markers.select(F.col("id").cast("string").alias("id"), F.col("marker").cast("string").alias("marker"), x.alias("x")).join(F.broadcast(index), "id")
    stats = cells.groupBy("marker").agg(F.median("x").alias("mid"), (F.avg(F.col("x") + ploidy / 2) / ploidy).alias("p")).filter(F.least(F.col("p"), 1 - F.col("p")) > min_maf).select("marker", "mid")
    return cells.join(stats, "marker").groupBy("marker").agg(F.collect_list(F.struct("i", F.coalesce("x", "mid").alias("v"))).alias("c")).select("marker", "c.i", "c.v")


def scan_absorbed(model: AbsorbedModel, markers: DataFrame, min_maf: float = 0.05, ploidy: int = 2) -> DataFrame:
    """scan_markers() for one plain effect of any number of genotypes, from a table with a row for each of these.

    Without a kernel Z'V^-1 Z is diagonal, so a marker needs sums over its genotypes alone: of n x^2, of x y and of x by
    fixed coefficient, each genotype weighted by r / (n + r) at the ratio r of the variances. These are one join and one
    grouped sum; the coefficients' covariance travels with the tasks.
    """
    x, ratio = F.col("dosage").cast("double"), model.se / model.su if model.su > 0 else math.inf
    weight = (F.lit(1.0) if math.isinf(ratio) else ratio / (F.col("n") + ratio)) / model.se
    own = model.levels.select("level", *((F.col(c) * weight).alias(f"_{c}") for c in ("n", "my")), F.transform("m", lambda e: F.struct(e["i"].alias("i"), (e["v"] * weight).alias("v"))).alias("_m"))
    cells = markers.select(F.col("id").cast("string").alias("level"), F.col("marker").cast("string").alias("marker"), x.alias("x")).join(own, "level")
    stats = cells.groupBy("marker").agg(F.median("x").alias("mid"), (F.avg(F.col("x") + ploidy / 2) / ploidy).alias("p")).filter(F.least(F.col("p"), 1 - F.col("p")) > min_maf).select("marker", "mid")
    dosed = cells.join(F.broadcast(stats) if stats.limit(MAX_ORDER + 1).count() <= MAX_ORDER else stats, "marker").withColumn("x", F.coalesce("x", "mid"))
    part = lambda i, v: F.struct(F.lit(i).alias("i"), v.alias("v"))
    parts = F.concat(F.array(part(-1, F.col("_n") * F.col("x") * F.col("x")), part(-2, F.col("_my") * F.col("x"))), F.transform("_m", lambda e: F.struct(e["i"].alias("i"), (e["v"] * F.col("x")).alias("v"))))
    sums = dosed.select("marker", F.inline(parts)).groupBy("marker", "i").agg(F.sum("v").alias("v")).groupBy("marker").agg(F.collect_list(F.struct("i", "v")).alias("c"))
    kept, covariance, solution, ypy, df = model.kept, model.covariance, model.solution[model.kept], model.ypy, model.records - len(model.kept)
    width = model.design.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.zeros((batch.num_rows, width + 2))  # the last two places are those of -2 and -1
            for k in range(batch.num_rows):
                c = batch.column(1)[k].values
                m[k, c.field("i").to_numpy(zero_copy_only=False)] = c.field("v").to_numpy(zero_copy_only=False)
            a = m[:, kept]
            t, s = m[:, -1] - np.einsum("ij,jk,ik->i", a, covariance, a, optimize=True), m[:, -2] - a @ solution
            yield _tested(batch.column(0), t, s, t > 1e-9 * m[:, -1], ypy, df)

    return sums.mapInArrow(run, "marker string, effect double, std_error double, f_value double, score double")


def scan_markers(model: Model, term: str, markers: DataFrame, min_maf: float = 0.05, ploidy: int = 2) -> DataFrame:
    """(marker, effect, std_error, f_value, score = -log10 p) for each marker of (id, marker, dosage).

    P is absorbed once on the driver into Z'PZ and Z'Py of the genotype term (as wide as there are genotypes, bounded)
    and broadcast; markers are independent tasks. Markers under ``min_maf`` are left out before the scan; a marker the
    fixed effects explain has null results. Individuals without records don't enter; missing dosages get the median.
    """
    levels, zpz, zpy, ypy, df = model.projected(term)
    if len(levels) > MAX_ORDER:
        raise ValueError(f"over {MAX_ORDER} genotypes")
    rows = _dosages(markers, levels, min_maf, ploidy)
    shared = markers.sparkSession.sparkContext.broadcast((zpz, zpy, float(ypy), int(df)))
    return rows.mapInArrow(_scanner(shared, len(levels)), "marker string, effect double, std_error double, f_value double, score double")


class _Refits:
    """One-dimensional REML for many markers at once, in the rotation that makes the covariance of the records diagonal.

    With K = LL' and L'Z'ZL = U diag(d) U', a product a'inv(I + ZKZ'/r)b is a'b - sum t_a t_b / (d + r), where t_a = U'L'Z'a.
    So for X, y and a marker only these vectors are needed, at any ratio r of the variances.
    """

    def __init__(self, total: np.ndarray, at: np.ndarray, kept: np.ndarray, kernel: np.ndarray | None, records: int):
        q = len(at)
        self.zz, self.xz, self.zy = total[np.ix_(at, at)], total[np.ix_(kept, at)], total[at, -1]
        factor = np.eye(q) if kernel is None else np.linalg.cholesky(kernel)
        self.d, u = np.linalg.eigh(factor.T @ self.zz @ factor)
        self.d = np.maximum(self.d, 0.0)
        rotate = u.T @ factor.T
        own = [*kept, len(total) - 1]
        self.base, self.fixed = total[np.ix_(own, own)], rotate @ np.column_stack((self.xz.T, self.zy))
        self.turn, self.records, self.p = rotate @ self.zz, records, len(kept)

    def _sums(self, t: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """sum of w t t' over the rotated places, for X, y and each marker: (markers, p + 2, p + 2), the marker first."""
        n, p = len(t), self.p + 1
        out = np.empty((n, p + 1, p + 1))
        shared = np.einsum("qi,qj->qij", self.fixed, self.fixed).reshape(len(self.d), -1)
        out[:, 1:, 1:] = (weight @ shared).reshape(-1, p, p)
        out[:, 0, 1:] = out[:, 1:, 0] = (weight * t) @ self.fixed
        out[:, 0, 0] = (weight * t * t).sum(axis=1)
        return out

    def fit(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(effects, standard errors) of markers, a row of dosages each; NaN for one that X explains."""
        n, p = len(m), self.p
        t = m @ self.turn.T
        base = np.empty((n, p + 2, p + 2))
        base[:, 1:, 1:] = self.base
        base[:, 0, 1:] = base[:, 1:, 0] = m @ np.column_stack((self.xz.T, self.zy))
        base[:, 0, 0] = np.einsum("ij,jk,ik->i", m, self.zz, m, optimize=True)
        plain = self.base[:p, :p]
        left = base[:, 0, 0] - np.einsum("ni,ni->n", base[:, 0, 1 : p + 1] @ np.linalg.inv(plain), base[:, 0, 1 : p + 1]) if p else base[:, 0, 0]
        good = left > 1e-9 * np.maximum(base[:, 0, 0], 1e-300)
        effect, error = np.full(n, np.nan), np.full(n, np.nan)
        if not good.any():
            return effect, error
        t, base, free = t[good], base[good], self.records - p - 1

        def at(ratio: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(-2 profile log-likelihood, its slope by the log of the ratio, effect, its standard error) of each marker; None: no variance."""
            weight = np.zeros((len(t), len(self.d))) if ratio is None else 1 / (self.d + ratio[:, None])
            s = base - self._sums(t, weight)
            inverse = np.linalg.inv(s[:, :-1, :-1])
            b = np.einsum("nij,nj->ni", inverse, s[:, :-1, -1])
            rest = s[:, -1, -1] - np.einsum("ni,ni->n", b, s[:, :-1, -1])
            value = free * np.log(rest) + np.linalg.slogdet(s[:, :-1, :-1])[1]
            slope = np.zeros(len(t))
            if ratio is not None:
                value += np.log1p(self.d / ratio[:, None]).sum(axis=1)
                change = self._sums(t, weight**2)
                v = np.column_stack((-b, np.ones(len(t))))
                slope = ratio * (free * np.einsum("ni,nij,nj->n", v, change, v) / rest + np.einsum("nij,nij->n", inverse, change[:, :-1, :-1]) - (self.d / (ratio[:, None] * (ratio[:, None] + self.d))).sum(axis=1))
            return value, slope, b[:, 0], np.sqrt(inverse[:, 0, 0] * rest / free)

        grid = np.linspace(-20, 20, 81)
        values = np.stack([at(np.full(len(t), np.exp(g)))[0] for g in grid], axis=1)
        k = values.argmin(axis=1)
        low, high = grid[np.maximum(k - 1, 0)], grid[np.minimum(k + 1, len(grid) - 1)]
        for _ in range(60):  # the slope changes sign once between the neighbours of the best place
            mid = (low + high) / 2
            over = at(np.exp(mid))[1] > 0
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        none, best = at(None), at(np.exp((low + high) / 2))
        flat = none[0] <= values.min(axis=1) + 1e-12 * np.abs(values.min(axis=1))
        effect[good], error[good] = np.where(flat, none[2], best[2]), np.where(flat, none[3], best[3])
        return effect, error


def _refitter(shared, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refits = shared.value
        df = refits.records - refits.p - 1
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                m = np.zeros((batch.num_rows, order))
                for k in range(batch.num_rows):
                    m[k, batch.column(1)[k].values.to_numpy(zero_copy_only=False)] = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                effect, error = refits.fit(m)
                f = (effect / error) ** 2
                score = [None if not np.isfinite(x) else -log_beta_tail(df / 2, 0.5, df / (df + x)) / math.log(10) for x in f]
                nullable = lambda x: pa.array([None if not np.isfinite(v) else float(v) for v in x], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), nullable(effect), nullable(error), nullable(f), pa.array(score, pa.float64())], names=["marker", "effect", "std_error", "f_value", "score"])

    return run


def scan_refits(model: Model, term: str, markers: DataFrame, min_maf: float = 0.05, ploidy: int = 2) -> DataFrame:
    """As scan_markers(), but with the variances estimated anew with each marker among the fixed effects.

    For a model of one random effect with one variance, and one residual variance. The rotation (genotypes squared,
    bounded) is found once and broadcast; each marker is a search in one dimension, many markers at a time in a task.
    """
    if len(model.design.random) != 1 or len(model.design.random[0].inner) > 1 or len(model.design.levels) != 1:
        raise ValueError("one random effect and one residual variance")
    t = model.design.random[0]
    if term not in (t.label, *t.variables):
        raise ValueError(f"no random effect {term}")
    kernel = None if t.kernel_inverse is None else np.linalg.inv(t.kernel_inverse)
    refits = _Refits(model.gram.sums["units"], np.arange(t.start, t.start + t.size), model.fit.kept, kernel, model.gram.records["units"])
    shared = markers.sparkSession.sparkContext.broadcast(refits)
    return _dosages(markers, t.main, min_maf, ploidy).mapInArrow(_refitter(shared, len(t.main)), "marker string, effect double, std_error double, f_value double, score double")


def kinship_components(kernel: DataFrame, n: int) -> DataFrame:
    """The first n principal components of a kernel: (id, pc1, .., pcn). Signs make each one's largest loading positive."""
    levels, k = dense(kernel)
    w, v = np.linalg.eigh(k)
    top = v[:, np.argsort(-w)[:n]]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    rows = [(x, *(float(y) for y in top[i])) for i, x in enumerate(levels)]
    return kernel.sparkSession.createDataFrame(rows, "id string, " + ", ".join(f"pc{j + 1} double" for j in range(n)))


def gwas(df: DataFrame, fixed: str, random: str, markers: DataFrame, term: str, n_pc: int = 0, min_maf: float = 0.05, p3d: bool = True, kernels: dict | None = None, id_col: str | None = None, **options) -> DataFrame:
    """A scan at the components of one REML fit (``p3d``) or refitted with each marker as a fixed covariate.

    A plain effect of more genotypes than a driver's matrix may have is scanned where they are (scan_absorbed()).

    Refits of a model with one random effect are made in the tasks (scan_refits()); with more variances, or covariances,
    each is a whole fit of its own, for a few markers. ``n_pc`` adds that many principal components of the additive kernel as fixed covariates.
    """
    key = id_col or term
    if n_pc:
        pcs = kinship_components(a_matrix(markers), n_pc).withColumnRenamed("id", key)
        df = df.join(F.broadcast(pcs), key)  # as wide as the kernel, which is bounded
        fixed = fixed + "".join(f" + pc{j + 1}" for j in range(n_pc))
    model = mmec(df, fixed, random, kernels=kernels, **options)
    if isinstance(model, AbsorbedModel):
        if not p3d or term != model.term:
            raise ValueError(f"with over {MAX_ORDER} genotypes a scan keeps the variances of one effect, that of the genotypes")
        return scan_absorbed(model, markers, min_maf)
    if p3d:
        return scan_markers(model, term, markers, min_maf)
    if len(model.design.random) == 1 and len(model.design.random[0].inner) == 1 and len(model.design.levels) == 1:
        return scan_refits(model, term, markers, min_maf)
    rows = []
    stats = markers.groupBy("marker").agg((F.avg(F.col("dosage") + 1) / 2).alias("p")).filter(F.least(F.col("p"), 1 - F.col("p")) > min_maf)
    for (name,) in stats.select(F.col("marker").cast("string")).orderBy("marker").toLocalIterator():  # one fit each: for a few markers
        one = markers.filter(F.col("marker").cast("string") == name).select(F.col("id").alias(key), F.col("dosage").cast("double").alias("_marker"))
        model = mmec(df.join(one, key), f"{fixed} + _marker", random, kernels=kernels, **options)
        found = model.blues().filter("term = '_marker'").first()
        if found is not None:
            n = sum(model.gram.records.values()) - len(model.fit.kept)
            f = found["t_value"] ** 2
            rows.append((name, found["estimate"], found["std_error"], f, -log_beta_tail(n / 2, 0.5, n / (n + f)) / math.log(10)))
    return markers.sparkSession.createDataFrame(rows, "marker string, effect double, std_error double, f_value double, score double")
