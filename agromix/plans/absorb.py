"""Models with one random effect of any number of levels, which never come to the driver.

For y = Xb + Zu + e with u ~ N(0, su I) and e ~ N(0, se / w), a level enters the equations of b only through its sum of
weights n and its sums m = [X y]'w. At the ratio r = se / su, absorbing u leaves A - sum of m m' / (n + r). Levels with
equal n share that factor, so one grouped sum of m m' by n serves every r: a fit is a few Spark jobs, whatever the number
of levels, and the likelihood's slope in r has its root found on the driver. A held r needs one sum over all levels. Effects come back by one join with a
broadcast row of coefficients. Absorption as in Henderson (1975); the profile likelihood as in Patterson and Thompson (1971).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from agromix.plans.design import DRIVER_BYTES, ENTRY, PLAIN, Design, gram_of
from agromix.plans.reml import independent_columns
from agromix.sources.scratch import written

__all__ = ["AbsorbedModel", "fit_absorbed"]


@dataclass
class AbsorbedModel:
    """Estimates; ``su`` is 0 and ``constraint`` boundary where the likelihood rises all the way to no variance."""

    term: str
    design: Design
    levels: DataFrame
    su: float
    se: float
    constraint: str
    loglik: float
    kept: np.ndarray
    solution: np.ndarray
    covariance: np.ndarray
    #: The effect is a fixed one (variance without end): its levels are among the estimates.
    as_fixed: bool = False
    #: y'Py and the records, for scans.
    ypy: float = 0.0
    records: int = 0

    def summary(self) -> DataFrame:
        rows = [(self.term, self.su, self.constraint, True), ("residual.units", self.se, "fixed" if self.constraint == "fixed" else "positive", True)]
        return self.levels.sparkSession.createDataFrame(rows, "component string, var_comp double, constraint string, converged boolean")

    def blues(self) -> DataFrame:
        names = [(b.label, x) for b in self.design.fixed for x in b.names]
        error = np.sqrt(np.diag(self.covariance))
        rows = [(*names[i], float(self.solution[i]), float(e), float(self.solution[i] / e)) for i, e in zip(self.kept, error, strict=True)]
        out = self.levels.sparkSession.createDataFrame(rows, "term string, level string, estimate double, std_error double, t_value double")
        if not self.as_fixed:
            return out
        own = self.blups().select(F.lit(self.term).alias("term"), "level", F.col("blup").alias("estimate"), F.sqrt("pev").alias("std_error"))
        return out.unionByName(own.withColumn("t_value", F.col("estimate") / F.col("std_error")))

    def predict(self, target: str) -> DataFrame:
        """(level, predicted, std_error) of every level: its effect and the fixed terms, each spread evenly over its levels.

        The error is that of k'b + u: with V the covariance of b, it is k'Vk - 2 k'Vm / (n + r) beside the effect's own.
        """
        if target != self.term:
            raise ValueError(f"no term holds {target}; an absorbed model predicts {self.term}")
        contrast = bool(self.design.fixed) and self.design.fixed[0].label == "(Intercept)"
        k = np.zeros(self.design.width)
        for block in self.design.fixed:
            first = block.label == "(Intercept)"
            k[block.start : block.start + block.size] = 1 if first else 1 / (block.size + (1 if contrast and len(block.variables) == 1 else 0))
        whole = np.zeros((self.design.width, self.design.width))
        whole[np.ix_(self.kept, self.kept)] = self.covariance
        pull = F.lit((whole @ k).tolist()) if len(k) else F.array().cast("array<double>")
        ratio = self.se / self.su if self.su > 0 else float("inf")
        mixed = F.aggregate("m", F.lit(0.0), lambda a, e: a + e["v"] * F.get(pull, e["i"])) / (F.col("n") + ratio)
        rows = self.levels.select(F.col("level").alias("_level"), mixed.alias("_mixed"))
        both = self.blups().join(rows, F.col("level") == F.col("_level"))
        error = F.greatest(F.col("pev") + float(k @ whole @ k) - 2 * F.col("_mixed"), F.lit(0.0))
        return both.select("level", (F.col("blup") + float(k @ self.solution)).alias("predicted"), F.sqrt(error).alias("std_error"))

    def fitted(self) -> DataFrame:
        """The records with fitted and residual: one join with the levels."""
        b = F.lit(self.solution.tolist()) if len(self.solution) else F.array().cast("array<double>")
        own = self.blups().select(F.col("level").alias("_own"), F.col("blup").alias("_u"))
        rows = self.design.rows.join(own, F.col(self.term).cast("string") == F.col("_own"), "left")
        value = F.aggregate("_entries", F.lit(0.0), lambda a, e: a + e["v"] * F.get(b, e["i"])) + F.coalesce("_u", F.lit(0.0))
        made = rows.withColumn("fitted", value).withColumn("residual", F.col("_y") - F.col("fitted"))
        return made.drop(*(c for c in made.columns if c.startswith("_")))

    def blups(self) -> DataFrame:
        """(level, blup, pev, reliability) of every level, computed where the levels are."""
        spark, w = self.levels.sparkSession, self.design.width
        whole = np.zeros((w, w))
        whole[np.ix_(self.kept, self.kept)] = self.covariance
        if self.su <= 0:
            return self.levels.select("level", F.lit(0.0).alias("blup"), F.lit(0.0).alias("pev"), F.lit(None).cast("double").alias("reliability"))
        ratio = self.se / self.su
        if _few(self.design):  # plain arithmetic, which Spark compiles
            m = [F.get("m", F.lit(i))["v"] for i in range(w)]
            pull = sum((m[i] * float(self.solution[i]) for i in range(w)), F.lit(0.0))
            spread = sum((m[i] * m[j] * float(whole[i, j]) for i in range(w) for j in range(w)), F.lit(0.0))
            return self._effects(self.levels, pull, spread, ratio)
        one = spark.createDataFrame([([float(x) for x in self.solution], [[float(x) for x in r] for r in whole])], "_b array<double>, _v array<array<double>>")
        pull = F.aggregate("m", F.lit(0.0), lambda a, e: a + e["v"] * F.get("_b", e["i"]))
        spread = F.aggregate("m", F.lit(0.0), lambda a, e: a + F.aggregate("m", F.lit(0.0), lambda c, d: c + e["v"] * d["v"] * F.get(F.get("_v", e["i"]), d["i"])))
        return self._effects(self.levels.crossJoin(F.broadcast(one)), pull, spread, ratio)  # one row

    def _effects(self, rows: DataFrame, pull: Column, spread: Column, ratio: float) -> DataFrame:
        pev = self.se / (F.col("n") + ratio) + spread / F.pow(F.col("n") + ratio, 2)
        made = rows.select("level", ((F.col("my") - pull) / (F.col("n") + ratio)).alias("blup"), pev.alias("pev"))
        return made.withColumn("reliability", 1 - F.col("pev") / self.su)


def _few(design: Design) -> bool:
    """Whether the coefficients are a few covariates: each level has all of them then, in order."""
    return design.plain is not None and len(design.plain) == design.width <= PLAIN


def _by_level(design: Design, level: str) -> DataFrame:
    """(level, n, my, m: the entries of X'w by coefficient), a row for each level.

    A few covariates are plain sums in one aggregation; only designs of factors, or wider ones, are taken apart by entry.
    """
    whole = isinstance(design.rows.schema[level].dataType, IntegralType)  # these are grouped faster than their texts, and into the same levels
    key = F.col(level) if whole else F.col(level).cast("string")
    rows, w = design.rows.filter("_y is not null").withColumn("_own", key).filter("_own is not null"), F.col("_w")
    name = F.col("_own").cast("string").alias("level")
    if _few(design):
        sums = rows.groupBy("_own").agg(F.sum(w).alias("n"), F.sum(w * F.col("_y")).alias("my"), *(F.sum(w * x).alias(f"_m{i}") for i, x in enumerate(design.plain)))
        entries = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_m{i}").alias("v")) for i in range(design.width))).cast(ENTRY)
        return sums.select(name, "n", "my", entries.alias("m"))
    cells = rows.select("_own", F.inline(F.concat(
        F.transform("_entries", lambda e: F.struct(e["i"].alias("i"), (e["v"] * w).alias("v"))),
        F.array(F.struct(F.lit(-1).alias("i"), w.alias("v")), F.struct(F.lit(-2).alias("i"), (w * F.col("_y")).alias("v"))))))
    sums = cells.groupBy("_own", "i").agg(F.sum("v").alias("v"))
    some = lambda at: F.sum(F.when(F.col("i") == at, F.col("v")))
    return sums.groupBy("_own").agg(some(-1).alias("n"), some(-2).alias("my"), F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "v"))).alias("m")).select(name, "n", "my", "m")


def _at_ratio(by_level: DataFrame, pairs: DataFrame, ratio: float, order: int, few: bool) -> tuple[np.ndarray, float]:
    """Sums over all levels of m m' / (n + ratio) and of log(1 + n / ratio): what a held ratio needs, whatever the levels' sums of weights.

    Of a few covariates both are one aggregation of plain products; else m is taken apart by pairs of entries.
    """
    out, n = np.zeros((order, order)), F.col("n")
    logs = F.sum(F.log1p(n / ratio)).alias("logs") if ratio > 0 else F.lit(None).cast("double").alias("logs")
    if few:
        m = [*(F.get("m", F.lit(i))["v"] for i in range(order - 1)), F.col("my")]
        places = [(i, j) for j in range(order) for i in range(j + 1)]
        found = by_level.agg(logs, *(F.sum(m[i] * m[j] / (n + ratio)).alias(f"s{i}_{j}") for i, j in places)).first()
        for i, j in places:
            out[i, j] = out[j, i] = found[f"s{i}_{j}"] or 0.0
        return out, float(found["logs"] or 0.0)
    for r in pairs.groupBy("p.i", "p.j").agg(F.sum(F.col("p.v") / (n + ratio)).alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out, float(by_level.agg(logs).first()[0] or 0.0)


def fit_absorbed(design: Design, level: str, variances: tuple[float, float | None] | None = None) -> AbsorbedModel:
    """REML for a design of fixed effects and one more random effect, the levels of column ``level``; or, at given (su, se), its solutions.

    An infinite su makes the effect a fixed one; beside a su of 0, se may be None, and is estimated.
    """
    if design.random or len(design.levels) != 1:
        raise ValueError("absorption takes one random effect and one residual variance")
    if design.rows.filter(F.col(level).isNull() & F.col("_y").isNotNull()).limit(1).count():
        raise ValueError(f"null levels in {level}")
    gram, c = gram_of(design), design.width
    a = gram.sums["units"]
    records = gram.records["units"]
    kept = independent_columns(a[:c, :c]) if c else np.array([], int)
    by_level = written(_by_level(design, level))  # summed once: another run might add the weights in another order, to other sums
    entries = F.concat("m", F.array(F.struct(F.lit(c).alias("i"), F.col("my").alias("v"))))
    pairs = by_level.select("n", entries.alias("m")).select("n", F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y["i"] >= x["i"]), lambda y: F.struct(x["i"].alias("i"), y["i"].alias("j"), (x["v"] * y["v"]).alias("v")))))).alias("p"))
    own, p = np.append(kept, c), len(kept)
    a = a[np.ix_(own, own)]
    if variances is not None:
        su, se = variances
        if se is None and su != 0:
            raise ValueError("a residual variance is estimated beside no variance of the effect, or both are")
        constraint, ratio = "fixed", se / su if su > 0 else np.inf
        left, logs = _at_ratio(by_level, pairs, ratio, c + 1, _few(design)) if np.isfinite(ratio) else (np.zeros((c + 1, c + 1)), 0.0)
        s = a - left[np.ix_(own, own)]
        inverse = np.linalg.inv(s[:p, :p]) if p else np.zeros((0, 0))
        beta = inverse @ s[:p, p]
        rest = float(s[p, p] - s[:p, p] @ beta)
        se = rest / (records - p) if se is None else float(se)
        value = (records - p) * np.log(se) + rest / se + (np.linalg.slogdet(s[:p, :p])[1] if p else 0.0) + logs
        return _model(design, level, by_level, float(su), se, constraint, -0.5 * (value - gram.log_weights["units"]), kept, beta, inverse, rest / se, records)
    sizes = by_level.groupBy("n").agg(F.count("*").alias("q"))
    most = max(1, DRIVER_BYTES // (8 * (c + 1) ** 2))
    counts = sizes.limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError("too many different sums of weights to keep their cross-products on the driver")
    n = np.array(sorted(r["n"] for r in counts))
    q = np.array([x for _, x in sorted((r["n"], r["q"]) for r in counts)], dtype=float)
    place, b = {x: i for i, x in enumerate(n)}, np.zeros((len(n), c + 1, c + 1))
    for r in pairs.groupBy("n", "p.i", "p.j").agg(F.sum("p.v").alias("v")).collect():
        b[place[r["n"]], r["i"], r["j"]] = b[place[r["n"]], r["j"], r["i"]] = r["v"]
    b = b[:, own][:, :, own]

    def at(ratio: float) -> tuple:
        """(-2 profile log-likelihood, its slope, sum of squares, coefficients, inverse) at se / su = ratio."""
        weight = 1 / (n + ratio) if np.isfinite(ratio) else np.zeros(len(n))
        s = a - np.tensordot(weight, b, 1)
        inverse = np.linalg.inv(s[:p, :p]) if p else np.zeros((0, 0))
        beta = inverse @ s[:p, p]
        rest = float(s[p, p] - s[:p, p] @ beta)
        value = (records - p) * np.log(rest) + (np.linalg.slogdet(s[:p, :p])[1] if p else 0.0) + (float(q @ np.log1p(n / ratio)) if 0 < ratio < np.inf else 0.0)
        change = np.tensordot(weight**2, b, 1)
        v = np.append(-beta, 1.0)
        slope = (records - p) * float(v @ change @ v) / rest + float(np.sum(inverse * change[:p, :p])) - (float(q @ (n / (ratio * (ratio + n)))) if 0 < ratio < np.inf else 0.0)
        return value, slope, rest, beta, inverse

    grid = np.exp(np.linspace(-25, 25, 201))
    values = [at(r)[0] for r in grid]
    k = int(np.argmin(values))
    if at(np.inf)[0] <= values[k] + 1e-12 * abs(values[k]):
        ratio, constraint = np.inf, "boundary"
    else:
        low, high, constraint = np.log(grid[max(k - 1, 0)]), np.log(grid[min(k + 1, 200)]), "positive"
        for _ in range(200):  # the slope changes sign once between the neighbours of the best place
            mid = (low + high) / 2
            low, high = (low, mid) if at(np.exp(mid))[1] > 0 else (mid, high)
        ratio = float(np.exp((low + high) / 2))
    se = at(ratio)[2] / (records - p)
    su = se / ratio if np.isfinite(ratio) else 0.0
    value, _, rest, beta, inverse = at(ratio)
    scaled = -0.5 * (value - (records - p) * np.log(rest) + (records - p) * np.log(se) + rest / se - gram.log_weights["units"])
    return _model(design, level, by_level, su, se, constraint, scaled, kept, beta, inverse, rest / se, records)


def _model(design: Design, level: str, by_level: DataFrame, su: float, se: float, constraint: str, loglik: float, kept: np.ndarray, beta: np.ndarray, inverse: np.ndarray, ypy: float, records: int) -> AbsorbedModel:
    solution = np.zeros(design.width)
    solution[kept] = beta
    return AbsorbedModel(level, design, by_level, su, se, constraint, float(loglik), kept, solution, inverse * se, bool(np.isinf(su)), ypy, records)
