"""Models with several random effects of any number of levels, whose equations never come to the driver.

For y = Xb + sum Z_k u_k + e with u_k ~ N(0, s_k I) and e ~ N(0, se / w), the fixed effects are absorbed: what is left is
S u = Z'My with S = Z'MZ + diag(se / s_k) and M = W - WX inv(X'WX) X'W. Z'WZ is a table of its cells, X'WZ a few numbers
beside each level; only matrices as wide as X are on the driver. S u = g is solved by conjugate gradients, preconditioned
by the diagonal, in the form of Chronopoulos and Gear (1989) that needs one reduction a step: a step is one Spark job. It joins
the cells with the vector, sums by row and returns its dot products as observed metrics. All right-hand sides
share the steps: the data, and random signs whose solutions estimate the traces of inv(S) by effect (Hutchinson 1990).

REML: se = y'(y - Xb - Zu) / (n - p) and s_k = u_k'u_k / (q_k - tr_k se / s_k) (Harville 1977), repeated on the logarithms of
the ratios with one step of Anderson's acceleration until they stand still. The signs are fixed by the levels' names, so
the estimates are reproducible; their error comes from the traces alone and falls with the levels and with ``probes``.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from agromix.plans.design import ENTRY, Design, gram_of, joined_key
from agromix.plans.reml import independent_columns
from agromix.sources.scratch import written

__all__ = ["LargeModel", "fit_large"]

#: Fixed coefficients whose sums are observed with the steps; wider designs take a job more for each step.
OBSERVED = 16
#: An effect with less than this share of the residual variance counts as having none.
LEAST = 1e-7


@dataclass
class LargeModel:
    """Estimates. ``constraint`` says of each variance: positive, fixed, or boundary where the likelihood ends at 0."""

    design: Design
    terms: list[str]
    keys: list[Column]
    solutions: DataFrame
    variances: dict[str, float]
    constraint: dict[str, str]
    se: float
    kept: np.ndarray
    solution: np.ndarray
    converged: bool
    steps: int
    rounds: int
    system: _System

    def summary(self) -> DataFrame:
        rows = [*((t, self.variances[t], self.constraint[t], self.converged) for t in self.terms), ("residual.units", self.se, self.constraint["residual.units"], self.converged)]
        return self.solutions.sparkSession.createDataFrame(rows, "component string, var_comp double, constraint string, converged boolean")

    def blups(self) -> DataFrame:
        """(term, level, blup) of every level."""
        name = F.element_at(F.array(*(F.lit(t) for t in self.terms)), F.col("t") + 1)
        return self.solutions.select(name.alias("term"), "level", F.col("u").alias("blup"))

    def blues(self) -> DataFrame:
        """Fixed coefficients. Their errors need solutions of as many systems as there are coefficients: blues_with_errors()."""
        names = [(b.label, x) for b in self.design.fixed for x in b.names]
        return self.solutions.sparkSession.createDataFrame([(*names[i], float(self.solution[i])) for i in self.kept], "term string, level string, estimate double")

    def blues_with_errors(self) -> DataFrame:
        """Fixed coefficients with standard errors, from one solution for each that shares the steps of all."""
        cross = self.system.fixed_solutions(self._ratios())
        covariance = (self.system.xx_inverse + self.system.xx_inverse @ cross @ self.system.xx_inverse) * self.se
        errors = dict(zip(self.kept.tolist(), np.sqrt(np.diag(covariance)).tolist(), strict=True))
        names = [(b.label, x) for b in self.design.fixed for x in b.names]
        rows = [(*names[i], float(self.solution[i]), errors[i], float(self.solution[i]) / errors[i]) for i in self.kept.tolist()]
        return self.solutions.sparkSession.createDataFrame(rows, "term string, level string, estimate double, std_error double, t_value double")

    def pev(self, term: str, levels: Sequence[str]) -> DataFrame:
        """(term, level, pev, reliability) of some levels of an effect: one more right-hand side for each, solved together."""
        t = self.terms.index(term)
        found = self.system.inverse_diagonal([f"{t}|{x}" for x in levels], self._ratios())
        s = self.variances[term]
        rows = [(term, x, v * self.se if s > 0 else 0.0, 1 - v * self.se / s if s > 0 else None) for x, v in zip(levels, found, strict=True)]
        return self.solutions.sparkSession.createDataFrame(rows, "term string, level string, pev double, reliability double")

    def _ratios(self) -> list[float]:
        return [self.se / max(self.variances[t], LEAST * self.se) for t in self.terms]

    def fitted(self) -> DataFrame:
        """The records with fitted and residual: a join with the levels for each effect."""
        rows = self.design.rows
        b = F.array(*(F.lit(float(x)) for x in self.solution)) if len(self.solution) else F.array().cast("array<double>")
        value = F.aggregate("_entries", F.lit(0.0), lambda a, e: a + e["v"] * F.get(b, e["i"]))
        rows = rows.withColumn("_fitted", value)
        for t, key in enumerate(self.keys):
            own = self.solutions.filter(F.col("t") == t).select(F.col("level").alias(f"_l{t}"), F.col("u").alias(f"_u{t}"))
            rows = rows.withColumn(f"_q{t}", key).join(own, F.col(f"_q{t}") == F.col(f"_l{t}"), "left")
            rows = rows.withColumn("_fitted", F.col("_fitted") + F.coalesce(F.col(f"_u{t}"), F.lit(0.0)))
        made = rows.withColumn("fitted", F.col("_fitted")).withColumn("residual", F.col("_y") - F.col("_fitted"))
        return made.drop(*(c for c in made.columns if c.startswith("_")))


class _System:
    """S and what solves it. ``levels``: (id, t, level, n, zy, x0.. or m); ``cells``: (row, col, v) off the diagonal."""

    def __init__(self, design: Design, keys: list[Column], terms: list[str]):
        gram = gram_of(design)
        a, c = gram.sums["units"], design.width
        self.records = gram.records["units"]
        self.kept = independent_columns(a[:c, :c]) if c else np.array([], int)
        self.p = len(self.kept)
        if self.records <= self.p:
            raise ValueError(f"{self.records} records do not tell {self.p} fixed coefficients apart from error")
        own = a[np.ix_(self.kept, self.kept)]
        self.xx_inverse = np.linalg.inv(own) if self.p else np.zeros((0, 0))
        self.xy, self.spark, self.terms = a[self.kept, -1], design.rows.sparkSession, terms
        self.beta0 = self.xx_inverse @ self.xy
        self.rest = float(a[-1, -1] - self.xy @ self.beta0)
        self.wide = self.p > OBSERVED
        ident = [F.concat(F.lit(f"{t}|"), k) for t, k in enumerate(keys)]
        rows = design.rows.filter("_y is not null").select("_entries", "_y", "_w", *(k.alias(f"_q{t}") for t, k in enumerate(ident)))
        names = [f"_q{t}" for t in range(len(keys))]
        self.place, self.width = {int(k): i for i, k in enumerate(self.kept)}, c
        entries = F.transform("_entries", lambda e: F.struct(e["i"].alias("i"), (e["v"] * F.col("_w")).alias("v")))
        each = rows.select(F.explode(F.array(*names)).alias("id"), F.concat(entries.cast(ENTRY), F.array(F.struct(F.lit(-1).alias("i"), F.col("_w").alias("v")), F.struct(F.lit(-2).alias("i"), (F.col("_w") * F.col("_y")).alias("v"))).cast(ENTRY)).alias("m")).filter("id is not null")
        sums = each.select("id", F.inline("m")).groupBy("id", "i").agg(F.sum("v").alias("v"))
        at = lambda i: F.coalesce(F.sum(F.when(F.col("i") == i, F.col("v"))), F.lit(0.0))
        x = [F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "v"))).alias("m")] if self.wide else [at(int(i)).alias(f"x{j}") for j, i in enumerate(self.kept)]
        by_level = sums.groupBy("id").agg(at(-1).alias("n"), at(-2).alias("zy"), *x)
        split = F.instr("id", "|")
        by_level = by_level.withColumn("t", F.expr("int(substring_index(id, '|', 1))")).withColumn("level", F.substr("id", split + 1))
        # g = Z'M y
        by_level = by_level.withColumn("o", F.lit(0))
        self.levels = written(by_level.withColumn("g", F.col("zy") - self._times_x(self.beta0)))
        self.size = {r["t"]: r["q"] for r in self.levels.groupBy("t").agg(F.count("*").alias("q")).collect()}
        cells = None
        for a_ in range(len(names)):
            for b_ in range(a_ + 1, len(names)):
                pair = rows.filter(F.col(names[a_]).isNotNull() & F.col(names[b_]).isNotNull()).groupBy(F.col(names[a_]).alias("row"), F.col(names[b_]).alias("col")).agg(F.sum("_w").alias("v"))
                cells = pair if cells is None else cells.unionByName(pair)
        self.cells = None
        if cells is not None:
            half = written(cells)
            self.cells = half.unionByName(half.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")).repartition("col").persist(StorageLevel.MEMORY_AND_DISK)
        self.steps = 0

    def close(self) -> None:
        if self.cells is not None:
            self.cells.unpersist()

    def _times_x(self, b: np.ndarray) -> Column:
        """x'b of each level."""
        if not self.p:
            return F.lit(0.0)
        if self.wide:
            whole = np.zeros(self.width)
            whole[self.kept] = b
            return F.aggregate("m", F.lit(0.0), lambda a, e: a + e["v"] * F.get(F.lit(whole.tolist()), e["i"]))
        return sum((F.col(f"x{i}") * v for i, v in enumerate(self._numbers(b))), F.lit(0.0))

    @staticmethod
    def _numbers(values: Sequence[float]) -> list[Column]:
        """Numbers looked up by a column that is always 0, so that the code Spark makes of a step holds none of them and is compiled once."""
        table = F.lit([float(v) for v in values])
        return [F.get(table, F.col("o") + i) for i in range(len(values))]

    def _ridge(self, ratios: Sequence[float]) -> Column:
        return F.get(F.lit([float(r) for r in ratios]), F.col("t"))

    def _product(self, state: DataFrame, vectors: list[str], ratios: Sequence[float], also: list[Column]) -> tuple[DataFrame, dict, np.ndarray]:
        """``state`` written with w_j = (Z'WZ + ridge) v_j for each of the ``vectors``; what was observed; X'WZ v."""
        m = len(vectors)
        out = [F.col(v) * (F.col("n") + self._ridge(ratios)) for v in vectors]
        if self.cells is not None:
            right = state.select(F.col("id").alias("col"), *vectors)
            sums = self.cells.join(right, "col").groupBy(F.col("row").alias("id")).agg(*(F.sum(F.col("v") * F.col(v)).alias(f"_s{j}") for j, v in enumerate(vectors)))
            state = state.join(sums, "id", "left")
            out = [o + F.coalesce(F.col(f"_s{j}"), F.lit(0.0)) for j, o in enumerate(out)]
        state = state.withColumns({f"w{j}": o for j, o in enumerate(out)}).drop(*(f"_s{j}" for j in range(m)))
        watch = Observation()
        over_x = [] if self.wide else [F.sum(F.col(f"x{i}") * F.col(v)).alias(f"x{i}_{j}") for j, v in enumerate(vectors) for i in range(self.p)]
        done = written(state.observe(watch, F.count("*").alias("rows"), *over_x, *also))
        seen = watch.get
        t = np.zeros((self.p, m))
        if self.wide:
            for r in done.select(F.explode("m").alias("e"), *vectors).groupBy("e.i").agg(*(F.sum(F.col("e.v") * F.col(v)).alias(f"s{j}") for j, v in enumerate(vectors))).collect():
                if r["i"] in self.place:
                    t[self.place[r["i"]]] = [r[f"s{j}"] for j in range(m)]
        else:
            for i in range(self.p):
                t[i] = [seen[f"x{i}_{j}"] or 0.0 for j in range(m)]
        self.steps += 1
        return done, seen, t

    def _fixed(self) -> list[str]:
        return ["id", "t", "level", "o", "n", "g", *(["m"] if self.wide else [f"x{i}" for i in range(self.p)])]

    def solve(self, rhs: list[Column], ratios: Sequence[float], start: tuple[DataFrame, Sequence[float]] | None = None, tol: float = 1e-9, most: int = 500) -> tuple[DataFrame, bool]:
        """(levels with x_j where S x_j = rhs_j, whether all residuals fell below ``tol`` of their right-hand sides).

        ``start``: what solve() gave for the same right-hand sides at other ratios, and these. The residuals there differ
        by the change of the ridge alone. Each vector has its own step lengths; those that are done stand still.
        """
        m, every = len(rhs), range(len(rhs))
        dot = lambda a, b, name: [F.sum(F.col(f"{a}{j}") * F.col(f"{b}{j}")).alias(f"{name}{j}") for j in every]
        seen_of = lambda seen, name: np.array([seen[f"{name}{j}"] or 0.0 for j in every])
        state = self.levels.select(*self._fixed(), *(c.alias(f"b{j}") for j, c in enumerate(rhs)))
        if start is None:
            state = state.withColumns({f"x{j}_": F.lit(0.0) for j in every} | {f"r{j}": F.col(f"b{j}") for j in every})
        else:
            state, moved = start[0], self._ridge(ratios) - self._ridge(start[1])
            state = state.withColumns({f"r{j}": F.col(f"r{j}") - moved * F.col(f"x{j}_") for j in every}).drop(*(f"{v}{j}" for v in "wps" for j in every))
        inner = self._ridge(ratios) + F.col("n")
        state = state.withColumns({f"p{j}": F.lit(0.0) for j in every} | {f"s{j}": F.lit(0.0) for j in every} | {f"u{j}": F.col(f"r{j}") / inner for j in every})
        gamma_before, alpha = np.ones(m), np.ones(m)
        done, first = np.zeros(m, bool), True
        for _ in range(most):
            state, seen, t = self._product(state, [f"u{j}" for j in every], ratios, [*dot("r", "u", "ru"), *dot("w", "u", "wu"), *dot("r", "r", "rr"), *dot("b", "b", "bb")])
            done |= seen_of(seen, "rr") <= tol**2 * np.maximum(seen_of(seen, "bb"), 1e-300)
            if done.all():
                return state, True
            h = self.xx_inverse @ t
            gamma = seen_of(seen, "ru")
            delta = seen_of(seen, "wu") - np.einsum("ij,ij->j", t, h)
            beta = np.zeros(m) if first else np.where(done, 0.0, gamma / np.where(gamma_before > 0, gamma_before, 1))
            below = delta - (0 if first else beta * gamma / alpha)
            done |= ~(below > 0) | ~(gamma > 0)
            alpha = np.where(done, 1.0, gamma / np.where(done, 1.0, below))
            gamma_before, first = gamma, False
            if done.all():
                return state, True
            keep, go = self._numbers(beta), self._numbers(np.where(done, 0.0, alpha))
            state = state.withColumns({f"p{j}": F.col(f"u{j}") + keep[j] * F.col(f"p{j}") for j in every} | {f"s{j}": F.col(f"w{j}") - self._times_x(h[:, j]) + keep[j] * F.col(f"s{j}") for j in every})
            state = state.withColumns({f"x{j}_": F.col(f"x{j}_") + go[j] * F.col(f"p{j}") for j in every} | {f"r{j}": F.col(f"r{j}") - go[j] * F.col(f"s{j}") for j in every})
            state = state.withColumns({f"u{j}": F.col(f"r{j}") / inner for j in every}).drop(*(f"w{j}" for j in every))
        return state, False

    def signs(self, probes: int) -> list[Column]:
        """Random signs that depend on the names of levels alone."""
        return [F.when(F.pmod(F.xxhash64("id", F.lit(7919 * (j + 1))), F.lit(2)) == 0, 1.0).otherwise(-1.0) for j in range(probes)]

    def inverse_diagonal(self, ids: list[str], ratios: Sequence[float], together: int = 16) -> list[float]:
        """Elements of the diagonal of inv(S)."""
        out: dict[str, float] = {}
        for at in range(0, len(ids), together):
            some = ids[at : at + together]
            state, good = self.solve([F.when(F.col("id") == i, 1.0).otherwise(0.0) for i in some], ratios)
            if not good:
                warnings.warn("the equations have not been solved to the tolerance", stacklevel=2)
            for r in state.filter(F.col("id").isin(some)).select("id", *(f"x{j}_" for j in range(len(some)))).collect():
                out[r["id"]] = r[f"x{some.index(r['id'])}_"]
        missing = [i for i in ids if i not in out]
        if missing:
            raise ValueError(f"no level {missing[0].partition('|')[2]}")
        return [out[i] for i in ids]

    def fixed_solutions(self, ratios: Sequence[float]) -> np.ndarray:
        """X'WZ inv(S) Z'WX."""
        unit = np.eye(self.p)
        out = np.zeros((self.p, self.p))
        for at in range(0, self.p, 16):
            own = range(at, min(at + 16, self.p))
            state, _ = self.solve([self._times_x(unit[i]) for i in own], ratios)
            sums = state.agg(*(F.sum(self._times_x(unit[i]) * F.col(f"x{j - at}_")).alias(f"v{i}_{j}") for j in own for i in range(self.p))).first()
            for j in own:
                out[:, j] = [sums[f"v{i}_{j}"] for i in range(self.p)]
        return (out + out.T) / 2


def fit_large(design: Design, terms: Sequence, variances: dict[str, float] | None = None, residual: float | None = None, probes: int = 8, tol: float = 1e-4, rounds: int = 60) -> LargeModel:
    """REML for the fixed effects of ``design`` and random ``terms`` (lists of columns whose levels, joined, are one effect's).

    ``variances`` (by term) with ``residual`` holds these. Records with a null level are without that effect.
    """
    if design.random or len(design.levels) != 1:
        raise ValueError("the fixed part comes as a design; one residual variance")
    names = [":".join(t) for t in terms]
    keys = [joined_key(list(t)) for t in terms]
    system = _System(design, keys, names)
    spare = system.records - system.p
    absent = [n for t, n in enumerate(names) if t not in system.size]
    if absent:
        raise ValueError(f"no level of {absent[0]} in the records")
    k = len(names)
    constraint = dict.fromkeys([*names, "residual.units"], "positive")
    converged, done_rounds, state = True, 0, None
    if variances is not None:
        if residual is None or residual <= 0:
            raise ValueError("held variances need a residual variance above 0")
        constraint = dict.fromkeys(constraint, "fixed")
        se = float(residual)
        ratios = [se / max(float(variances[n]), LEAST * se) for n in names]
        state, converged = system.solve([F.col("g")], ratios, tol=1e-12)
        found = {n: float(variances[n]) for n in names}
    else:
        log_ratio, converged = np.log(np.full(k, float(k))), False
        before: tuple[np.ndarray, np.ndarray] | None = None
        last = None
        held = np.zeros(k, bool)
        for done_rounds in range(1, rounds + 1):
            ratios = np.exp(log_ratio).tolist()
            state, good = system.solve([F.col("g"), *system.signs(probes)], ratios, (state, last) if last else None, tol=tol / 10)
            last = ratios
            sums = state.groupBy("t").agg(F.sum(F.col("x0_") * F.col("x0_")).alias("uu"), F.sum(F.col("x0_") * F.col("g")).alias("ug"), *(F.sum(F.col(f"b{j}") * F.col(f"x{j}_")).alias(f"z{j}") for j in range(1, probes + 1))).collect()
            by = {r["t"]: r for r in sums}
            se = max((system.rest - sum(r["ug"] for r in sums)) / spare, 1e-300)
            trace = np.array([np.mean([by[t][f"z{j}"] for j in range(1, probes + 1)]) for t in range(k)])
            size = np.array([system.size[t] for t in range(k)])
            free = np.maximum(size - np.exp(log_ratio) * trace, 1e-9 * size)
            s = np.array([by[t]["uu"] for t in range(k)]) / free
            goal = np.where(held, log_ratio, np.log(se) - np.log(np.maximum(s, 1e-300)))
            at_end = goal > -np.log(LEAST)
            step = np.where(at_end, 0.0, goal - log_ratio)
            held |= at_end
            far = float(np.abs(step[~held]).max(initial=0.0))
            if good and far < tol:
                converged = True
                break
            new = log_ratio + step
            if before is not None:
                moved, turned = log_ratio - before[0], step - before[1]
                if (size_ := float(turned @ turned)) > 0:
                    ahead = new - (moved + turned) * float(step @ turned) / size_
                    if np.abs(ahead - log_ratio).max() < 4:
                        new = ahead
            before = (log_ratio, step)
            log_ratio = np.where(held, -np.log(LEAST), new)
        ratios = np.exp(log_ratio).tolist()
        found = {n: 0.0 if held[t] else float(s[t]) for t, n in enumerate(names)}
        constraint |= {n: "boundary" for t, n in enumerate(names) if held[t]}
        if not converged:
            warnings.warn(f"the variances have not settled in {rounds} rounds", stacklevel=2)
    if k and not system.wide and system.p:
        pulls = state.agg(*(F.sum(F.col(f"x{i}") * F.col("x0_")).alias(f"v{i}") for i in range(system.p))).first()
        pull = np.array([pulls[f"v{i}"] for i in range(system.p)])
    else:
        pull = np.zeros(system.p)
        for r in state.select(F.explode("m").alias("e"), "x0_").groupBy("e.i").agg(F.sum(F.col("e.v") * F.col("x0_")).alias("v")).collect() if system.p else ():
            if r["i"] in system.place:
                pull[system.place[r["i"]]] = r["v"]
    solution = np.zeros(design.width)
    solution[system.kept] = system.beta0 - system.xx_inverse @ pull
    zero = F.element_at(F.array(*(F.lit(0.0 if found[n] <= 0 else 1.0) for n in names)), F.col("t") + 1)
    return LargeModel(design, names, keys, written(state.select("t", "level", (F.col("x0_") * zero).alias("u"))), found, constraint, se, system.kept, solution, converged, system.steps, done_rounds, system)
