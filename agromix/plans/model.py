"""Fitting and what follows a fit: summaries, predictions, tests, functions of variance components."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agromix.functions.numeric import chi2_sf, f_sf
from agromix.operators.matrices import MAX_ORDER
from agromix.operators.records import na_policy
from agromix.plans.absorb import AbsorbedModel, fit_absorbed
from agromix.plans.design import STRUCTURES, Design, Gram, TooManyLevels, assembled, build_design, gram_cells, gram_of, join_levels, joined_key, split_level
from agromix.plans.formula import Call, Formula, Interaction, Name, parse_formula, parse_terms
from agromix.plans.large import LargeModel, fit_large
from agromix.plans.multitrait import MultiFit, fit_pairs, fit_traits
from agromix.plans.reml import Fit, fit_reml, psd_factor, scaled_columns
from agromix.plans.whiten import Weights, whitened_gram
from agromix.sources.scratch import written

__all__ = ["Model", "absorbed", "crossed", "lrt", "mmec", "mmer", "mmer_pairs", "two_stage", "two_stage_models", "vpredict", "wald_test"]


@dataclass
class Model:
    spark: SparkSession
    response: str
    design: Design
    gram: Gram
    fit: Fit

    # summaries

    def components(self) -> list[tuple[str, float]]:
        """(name, value) of every variance parameter, covariances by column of the upper triangle."""
        out = []
        for t, theta in zip(self.design.random, self.fit.theta, strict=True):
            for j in range(len(theta)):
                for i in range(j + 1):
                    out.append((t.label if len(theta) == 1 else f"{t.label}.{t.inner[i]}:{t.inner[j]}", float(theta[i, j])))
        return out + [(f"residual.{x}", float(v)) for x, v in self.fit.residual.items()]

    def covariance_of_components(self) -> np.ndarray:
        """Inverse average information, with zero rows for parameters that were not estimated."""
        free = {p: i for i, p in enumerate(self.fit.parameters)}
        order = [("theta", k, i, j) for k, theta in enumerate(self.fit.theta) for j in range(len(theta)) for i in range(j + 1)] + [("residual", x) for x in self.fit.residual]
        inverse = np.linalg.pinv(self.fit.information) if len(free) else np.zeros((0, 0))
        out = np.zeros((len(order), len(order)))
        at = [(a, free[p]) for a, p in enumerate(order) if p in free]
        for a, i in at:
            for b, j in at:
                out[a, b] = inverse[i, j]
        return out

    def summary(self) -> DataFrame:
        """Variance components with standard errors, their ratio, how each is constrained, and whether the fit has converged."""
        se = np.sqrt(np.abs(np.diag(self.covariance_of_components())))
        rows = [(n, v, float(s), float(v / s) if s > 0 else None, c, self.fit.converged) for (n, v), s, c in zip(self.components(), se, self.constraints(), strict=True)]
        return self.spark.createDataFrame(rows, "component string, var_comp double, var_comp_se double, z_ratio double, constraint string, converged boolean")

    def constraints(self) -> list[str]:
        """Of every variance parameter: positive, unconstrained, fixed or, where the likelihood ends there, boundary."""
        free, out = set(self.fit.parameters), []
        for k, (t, theta) in enumerate(zip(self.design.random, self.fit.theta, strict=True)):
            for j in range(len(theta)):
                for i in range(j + 1):
                    edge = t.label in self.fit.boundary
                    out.append("boundary" if edge else "fixed" if ("theta", k, i, j) not in free else "positive" if i == j else "unconstrained")
        return out + ["boundary" if f"residual.{x}" in self.fit.boundary else "positive" if ("residual", x) in free else "fixed" for x in self.fit.residual]

    def __repr__(self) -> str:
        rows = [f"  {n:<40} {v:14.6g}  {c}" for (n, v), c in zip(self.components(), self.constraints(), strict=True)]
        state = "converged" if self.fit.converged else "NOT converged"
        return "\n".join([f"Mixed model of {self.response}: logLik {self.fit.loglik:.6g}, {state} after {self.fit.iterations} iterations", *rows])

    def criteria(self) -> dict[str, float]:
        """logLik, AIC and BIC; these count the fixed coefficients only, as REML likelihoods of equal fixed parts compare."""
        p, n = len(self.fit.kept), sum(self.gram.records.values())
        return {"loglik": self.fit.loglik, "aic": -2 * self.fit.loglik + 2 * p, "bic": -2 * self.fit.loglik + math.log(n) * p}

    def blues(self) -> DataFrame:
        """Fixed coefficients that can be told apart, with standard errors and t."""
        names = [(b.label, x) for b in self.design.fixed for x in b.names]
        se = np.sqrt(np.diag(self.fit.c_inverse))
        rows = [(*names[i], float(self.fit.solution[i]), float(se[i]), float(self.fit.solution[i] / se[i])) for i in self.fit.kept]
        return self.spark.createDataFrame(rows, "term string, level string, estimate double, std_error double, t_value double")

    def blups(self) -> DataFrame:
        """Random effects with prediction error variance and reliability 1 - PEV / variance (null without variance)."""
        rows = []
        for t, theta in zip(self.design.random, self.fit.theta, strict=True):
            q = len(t.main)
            scale = np.ones(q) if t.kernel_inverse is None else np.diag(np.linalg.inv(t.kernel_inverse))
            for s, inner in enumerate(t.inner):
                for k, level in enumerate(t.main):
                    i = t.start + s * q + k
                    pev, v = float(self.fit.c_inverse[i, i]), float(theta[s, s] * scale[k])
                    rows.append((t.label, inner, level, float(self.fit.solution[i]), pev, 1 - pev / v if v > 0 else None))
        return self.spark.createDataFrame(rows, "term string, inner string, level string, blup double, pev double, reliability double")

    def extended_blups(self, term: str, kernel: DataFrame) -> DataFrame:
        """(level, blup) of every level of a kernel of any order, from the effects of the levels in the model.

        u of all = K(all, model) inv(K(model, model)) u(model): one join with a table as long as the model's levels.
        """
        t, theta = next((t, th) for t, th in zip(self.design.random, self.fit.theta, strict=True) if term in (t.label, *t.variables))
        if len(theta) != 1 or t.kernel_inverse is None:
            raise ValueError(f"{term} is no single effect with a kernel")
        pull = t.kernel_inverse @ self.fit.solution[t.start : t.start + t.size]
        small = self.spark.createDataFrame([(x, float(v)) for x, v in zip(t.main, pull, strict=True)], "_l string, _a double")
        rows = kernel.join(F.broadcast(small), F.col("col").cast("string") == F.col("_l"))
        return rows.groupBy(F.col("row").cast("string").alias("level")).agg(F.sum(F.col("value") * F.col("_a")).alias("blup"))

    def monitor(self) -> DataFrame:
        return self.spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(self.fit.monitor)], "iteration int, loglik double, largest_score double")

    def fitted(self) -> DataFrame:
        """The records with fitted and residual; the coefficients travel as one broadcast row."""
        one = self.spark.createDataFrame([([float(x) for x in self.fit.solution],)], "_b array<double>")
        rows = self.design.rows.crossJoin(F.broadcast(one))
        value = F.aggregate("_entries", F.lit(0.0), lambda a, e: a + e["v"] * F.get("_b", e["i"]))
        made = rows.withColumn("fitted", value).withColumn("residual", F.col("_y") - F.col("fitted"))
        return made.drop(*(c for c in made.columns if c.startswith("_")))

    # predictions

    def dtable(self, target: str, include: Sequence[str] = (), average: Sequence[str] = ()) -> dict[str, tuple[bool, bool]]:
        """What predict() does with each term: (include, average).

        The target's own terms are included; those that hold further factors are averaged over them as well, and if the
        target is a random effect, fixed terms without it are averaged. ``include`` and ``average`` add to that.
        """
        factors = set(target.split(":"))
        blocks = [b for b in (*self.design.fixed, *self.design.random) if b.label != "(Intercept)"]
        own = [b for b in blocks if set(b.variables) & factors]
        if not own:
            raise ValueError(f"no term holds {target}")
        unknown = {*include, *average} - {b.label for b in blocks}
        if unknown:
            raise ValueError(f"no term {sorted(unknown)[0]}")
        random = all(b in self.design.random for b in own)
        out = {}
        for b in blocks:
            included = b.label in include or b in own
            averaged = b.label in average or (included and not set(b.variables) <= factors) or (random and b in self.design.fixed and b not in own)
            out[b.label] = (included, averaged)
        return out

    def predict(self, target: str, include: Sequence[str] = (), average: Sequence[str] = (), dtable: dict[str, tuple[bool, bool]] | None = None) -> DataFrame:
        """Marginal means of ``target`` (a factor or an interaction a:b): (level, predicted, std_error).

        ``dtable`` (by default dtable()'s) says of every term whether it is included and averaged. Included: 1 in the
        columns whose factors agree with the target's level. Both: 1 spread evenly over those. Averaged only: 1 spread
        evenly over all levels, a level that contrasts leave out among them. Neither: 0. The intercept is always in.
        """
        factors = target.split(":")
        rules = self.dtable(target, include, average) if dtable is None else dtable
        dictionary: dict[str, list[str]] = {}
        for f in factors:
            single = [r[0] for r in self.design.rows.select(F.col(f).cast("string")).filter(F.col(f).isNotNull()).distinct().limit(MAX_ORDER + 1).collect()]
            if len(single) > MAX_ORDER:
                raise ValueError(f"{f} has over {MAX_ORDER} levels to predict")
            dictionary[f] = sorted(single)
        combos = [()]
        for f in factors:
            combos = [(*c, x) for c in combos for x in dictionary[f]]
        d, contrast = np.zeros((len(combos), self.design.width)), self.design.fixed and self.design.fixed[0].label == "(Intercept)"
        for block in (*self.design.fixed, *self.design.random):
            if block.label == "(Intercept)":
                d[:, block.start] = 1
                continue
            included, averaged = rules.get(block.label, (False, False))
            dropped = 1 if contrast and block in self.design.fixed and len(block.variables) == 1 else 0
            for r, combo in enumerate(combos) if included or averaged else ():
                level = dict(zip(factors, combo, strict=True))
                matching = [k for k, name in enumerate(block.names) if not included or self._agrees(block, name, level)]
                spread = (len(matching) if included else block.size + dropped) if averaged else 1
                d[r, [block.start + k for k in matching]] = 1 / max(spread, 1)
        return self.predict_rows([join_levels(c) for c in combos], d)

    def predict_rows(self, names: Sequence[str], d: np.ndarray) -> DataFrame:
        """Given rows of weights on all coefficients: (level, predicted, std_error)."""
        value = d @ self.fit.solution
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, self.fit.c_inverse, d, optimize=True), 0))
        return self.spark.createDataFrame([(x, float(v), float(s)) for x, v, s in zip(names, value, se, strict=True)], "level string, predicted double, std_error double")

    @staticmethod
    def _agrees(block, name: str, level: dict[str, str]) -> bool:
        parts = split_level(name) if len(block.variables) > 1 else [name]
        if len(parts) != len(block.variables):
            return parts[-1] in level.values()
        return all(level.get(v, x) == x for v, x in zip(block.variables, parts, strict=True))

    # tests

    def anova(self, sequential: bool = True) -> DataFrame:
        """Sums of squares of the fixed terms at the fitted covariances, in sequence or each after all others, with F."""
        s = self._fixed_information()
        n, p = sum(self.gram.records.values()), len(self.fit.kept)
        blocks = [(b.label, [i for i, k in enumerate(self.fit.kept) if b.start <= k < b.start + b.size]) for b in self.design.fixed]
        full, rhs = s[:-1, :-1], s[:-1, -1]
        explained = lambda c: float(rhs[c] @ np.linalg.solve(full[np.ix_(c, c)], rhs[c])) if len(c) else 0.0
        every, rows, so_far = list(range(p)), [], []
        for label, own in blocks:
            ss = explained(so_far + own) - explained(so_far) if sequential else explained(every) - explained([i for i in every if i not in own])
            so_far = so_far + own
            if own:
                f = ss / len(own)
                rows.append((label, len(own), ss, f, f_sf(f, len(own), n - p)))
        return self.spark.createDataFrame(rows, "term string, df int, sum_sq double, f_value double, p_value double")

    def _fixed_information(self) -> np.ndarray:
        """[X y]' V^-1 [X y] by absorbing the random effects."""
        total = sum(m / self.fit.residual[x] for x, m in self.gram.sums.items() if self.gram.records[x])
        n_fixed = sum(b.size for b in self.design.fixed)
        random = []
        for t, theta in zip(self.design.random, self.fit.theta, strict=True):
            at, factor = slice(t.start, t.start + t.size), psd_factor(theta)
            total[:, at] = scaled_columns(total[:, at], factor, len(t.main))
            total[at] = scaled_columns(total[at].T, factor, len(t.main)).T
            total[at, at] += np.kron(np.eye(len(theta)), np.eye(len(t.main)) if t.kernel_inverse is None else t.kernel_inverse)
            random += range(t.start, t.start + t.size)
        own = [*self.fit.kept, len(total) - 1]
        assert all(k < n_fixed for k in self.fit.kept)
        top = total[np.ix_(own, own)]
        if random:
            cross = total[np.ix_(random, own)]
            top = top - cross.T @ np.linalg.solve(total[np.ix_(random, random)], cross)
        return top

    def projected(self, term: str) -> tuple[list[str], np.ndarray, np.ndarray, float, int]:
        """Z'PZ, Z'Py of one random term, y'Py and degrees of freedom: what a marker scan needs."""
        t = next(x for x in self.design.random if x.label == term or x.variables == (term,))
        total = sum(m / self.fit.residual[x] for x, m in self.gram.sums.items() if self.gram.records[x])
        at = np.arange(t.start, t.start + t.size)
        left = total[at, :-1] @ self.fit.c_inverse
        zpz = total[np.ix_(at, at)] - left @ total[:-1][:, at]
        zpy = total[at, -1] - left @ total[:-1, -1]
        return t.main, zpz, zpy, self.fit.ypy, sum(self.gram.records.values()) - len(self.fit.kept)


def mmec(df: DataFrame, fixed: str, random: str | None = None, rcov: str | None = None, weights: str | None = None, kernels: dict | None = None, covariances: dict | None = None, theta: dict | None = None, codes: dict | None = None, residual: dict | None = None, fixed_residual: bool = False, na_y: str = "exclude", na_x: str = "exclude", iterations: int = 100, em_only: bool = False, weight_matrix: Weights | None = None, ties: Sequence[dict[str, float]] = ()) -> Model | AbsorbedModel | LargeModel:
    """Fits y = Xb + sum Z u + e by REML. ``rcov``: "~ units" or "~ vsc(dsc(level), isc(units))"; ``kernels`` are covariances.

    Random factors with more levels than a driver's matrix may have are absorbed (one) or solved for by conjugate
    gradients (several); what comes back then has fewer methods. ``weight_matrix`` (instead of ``weights``) takes residuals
    that are correlated within groups of records. ``ties`` is a list of {component: multiple}: variances, named as in the
    summary, that are these multiples of one parameter.
    """
    formula = parse_formula(fixed)
    if len(formula.responses) != 1:
        raise ValueError("one response; mmer() takes several")
    if formula.responses[0] not in df.columns:
        raise ValueError(f"no column {formula.responses[0]}")
    terms = parse_terms(random)[0] if random else ()
    held = [t for t in terms if isinstance(t, Call) and str(t.named.get("isFixed", "")).upper() in ("TRUE", "T", "1")]
    if held:  # vsc(.., isFixed=TRUE) states a fixed effect in the language of random ones
        bare = lambda x: x.args[0] if isinstance(x, Call) and x.name in STRUCTURES else x
        parts = [[bare(a) for a in t.args] for t in held]
        formula = Formula(formula.responses, (*formula.terms, *(Interaction(tuple(p)) if len(p) > 1 else p[0] for p in parts)), formula.intercept)
        terms = tuple(t for t in terms if t not in held)
    level = None
    for t in parse_terms(rcov)[0] if rcov else ():
        structured = [a for a in getattr(t, "args", ()) if isinstance(a, Call) and a.name in ("dsc", "dsr")]
        level = str(structured[0].args[0]) if structured else level
    used: set[str] = set()

    def names(x) -> None:
        if isinstance(x, Name):
            used.add(x.name)
        for y in (*getattr(x, "args", ()), *getattr(x, "parts", ())):
            names(y)

    for t in (*formula.terms, *terms):
        names(t)
    if level:
        used.add(level)
    covariates = [c for c in df.columns if c in used]
    rows = na_policy(df, [formula.responses[0]], covariates, na_y, na_x)
    try:
        design = build_design(rows, formula.responses[0], formula.terms, formula.intercept, terms, level, weights, kernels, covariances)
    except TooManyLevels:
        parts = [_plain_factor(rows, t) for t in terms]
        if level or em_only or weight_matrix or ties or not parts or not all(parts):
            raise
        return _beyond_driver(rows, formula, parts, weights, theta, codes, residual, fixed_residual)
    if weight_matrix and weights:
        raise ValueError("a column of weights or weight matrices")
    gram = whitened_gram(design, weight_matrix) if weight_matrix else gram_of(design)
    fit = fit_reml(design, gram, theta, codes, residual, fixed_residual, iterations, em_only=em_only, ties=ties)
    if not fit.converged:
        warnings.warn(f"the fit of {fixed} has not converged in {fit.iterations} iterations", stacklevel=2)
    return Model(df.sparkSession, formula.responses[0], design, gram, fit)


def _plain_factor(df: DataFrame, term) -> list[str] | None:
    """The columns of a random factor or an interaction of factors; None for any other term."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    names = [p.name for p in (term.parts if isinstance(term, Interaction) else (term,)) if isinstance(p, Name)]
    kinds = dict(df.dtypes)
    whole = len(names) == (len(term.parts) if isinstance(term, Interaction) else 1)
    return names if whole and all(n in kinds and kinds[n] not in numeric and not kinds[n].startswith("decimal") for n in names) else None


def _beyond_driver(rows: DataFrame, formula: Formula, parts: list[list[str]], weights: str | None, theta: dict | None, codes: dict | None, residual: dict | None, fixed_residual: bool) -> AbsorbedModel | LargeModel:
    labels = [":".join(p) for p in parts]
    held = [int(np.asarray((codes or {}).get(x, 1)).item()) == 3 for x in labels]
    zero = len(parts) == 1 and held[0] and not fixed_residual and float(np.asarray((theta or {}).get(labels[0], 1.0)).item()) == 0.0
    if (any(held) != all(held) or any(held) != fixed_residual) and not zero:
        raise ValueError("beyond a driver's matrix, variances are held all or none")
    given = {x: float(np.asarray(theta[x]).item()) for x in labels} if fixed_residual else None
    if len(parts) > 1:
        design = build_design(rows, formula.responses[0], formula.terms, formula.intercept, (), None, weights)
        return fit_large(design, parts, given, float(residual["units"]) if given else None)
    if len(parts[0]) > 1:
        rows = rows.withColumn(labels[0], joined_key(parts[0]))
    design = build_design(rows, formula.responses[0], formula.terms, formula.intercept, (), None, weights)
    return fit_absorbed(design, labels[0], (0.0, None) if zero else (given[labels[0]], float(residual["units"])) if given else None)


def crossed(df: DataFrame, fixed: str, terms: Sequence[str], weights: str | None = None, variances: dict[str, float] | None = None, residual: float | None = None, na_y: str = "exclude", na_x: str = "exclude", **options) -> LargeModel:
    """y = Xb + sum Z u + e with several random ``terms`` (columns, or interactions a:b) of any number of levels each.

    ``variances`` by term with ``residual`` holds these. ``options`` go to fit_large(): probes, tol, rounds.
    """
    formula = parse_formula(fixed)
    parts = [t.split(":") for t in terms]
    if len(formula.responses) != 1 or any(c not in df.columns for p in parts for c in p):
        raise ValueError("crossed effects take one response and columns of levels")
    used = {c for c in df.columns if any(c in str(t).split(":") for t in formula.terms)} | {c for p in parts for c in p}
    rows = na_policy(df, [formula.responses[0]], sorted(used), na_y, na_x)
    return fit_large(build_design(rows, formula.responses[0], formula.terms, formula.intercept, (), None, weights), parts, variances, residual, **options)


def absorbed(df: DataFrame, fixed: str, term: str, weights: str | None = None, variances: tuple[float, float] | None = None, na_y: str = "exclude", na_x: str = "exclude") -> AbsorbedModel:
    """y = Xb + Zu + e with one random effect ``term`` of any number of levels; ``variances`` (of u, of e) holds these."""
    formula = parse_formula(fixed)
    if len(formula.responses) != 1 or term not in df.columns:
        raise ValueError("absorption takes one response and a column of levels")
    covariates = [c for c in df.columns if any(c in str(t).split(":") for t in formula.terms)]
    rows = na_policy(df, [formula.responses[0]], [*covariates, term], na_y, na_x)
    return fit_absorbed(build_design(rows, formula.responses[0], formula.terms, formula.intercept, (), None, weights), term, variances)


def mmer(df: DataFrame, fixed: str, random: str | None = None, stacked: bool = False, **options):
    """Several responses, cbind(y1, y2) ~ ...; with one response this is mmec().

    fit_traits() estimates unstructured covariances of the traits for every random effect and the residual, from records
    that have all traits. ``stacked`` takes records that lack some: traits are unpivoted into columns trait and value, the
    random term t becomes vsc(usc(trait), isc(t)), and residuals differ by trait but are independent between traits.
    """
    formula = parse_formula(fixed)
    if len(formula.responses) == 1:
        return mmec(df, fixed, random, **options)
    if not stacked:
        return fit_traits(df, fixed, random, **options)
    keep = [c for c in df.columns if c not in formula.responses]
    long = df.select(*keep, *(F.col(r).cast("double").alias(r) for r in formula.responses)).unpivot(keep, list(formula.responses), "trait", "value")
    by_trait = ["trait", *(str(Interaction((Name("trait"), *(t.parts if isinstance(t, Interaction) else (t,))))) for t in formula.terms)]
    terms = [t if isinstance(t, Call) else f"vsc(usc(trait), isc({t}))" for t in (parse_terms(random)[0] if random else ())]
    return mmec(long, f"value ~ 0 + {' + '.join(by_trait)}", "~ " + " + ".join(map(str, terms)) if terms else None, "~ vsc(dsc(trait), isc(units))", **options)


def mmer_pairs(df: DataFrame, traits: Sequence[str], fixed: str = "1", random: str | None = None, **options) -> dict[tuple[str, str], MultiFit]:
    """All two-trait models, after one pass over the records (fit_pairs()); merged_pairs() joins their covariances."""
    return fit_pairs(df, traits, fixed, random, **options)


def two_stage_models(df: DataFrame, value: str, entry: str, env: str, first: str | None = None, random: bool = False, **options) -> Model:
    """A mixed model for each environment, then one of all entries' estimates with their whole covariances as weights.

    The first stage is value ~ 0 + entry with the random terms ``first`` ("~ block"); its cross-products are summed by
    environment, of which there may be any number, and each one's fit is a task of its own, from these alone. The second stage is estimate ~ 0 +
    entry, or ~ env with random entries, whitened by the inverse covariance of each environment's estimates and with the
    residual held at 1. Entries that an environment can't tell apart are left out there.
    """
    terms = parse_terms(first)[0] if first else ()
    rows = na_policy(df, [value], [entry, env])
    design = build_design(rows, value, (Name(entry),), False, terms, env, apart=True)
    if any(len(t.inner) > 1 for t in design.random):
        raise ValueError("the first stage takes random effects of one variance each")
    c, names = design.width, design.fixed[0].names
    light = SimpleNamespace(fixed=design.fixed, random=design.random, levels=["units"], width=c)
    shape = pa.schema([("env", pa.string()), ("row", pa.string()), ("col", pa.string()), ("mean", pa.float64()), ("weight", pa.float64())])

    def fit(cells: pa.Table) -> pa.Table:
        if not cells.num_rows:
            return shape.empty_table()
        where = cells.column("_level")[0].as_py()
        sums, records, logs = assembled(c, *(cells.column(x).to_numpy() for x in ("i", "j", "v")))
        found = fit_reml(light, Gram({"units": sums}, {"units": records}, {"units": logs}))
        kept = [k for k in found.kept if k < len(names)]
        weight = np.linalg.inv(found.c_inverse[np.ix_(kept, kept)])
        weight = (weight + weight.T) / 2
        own = [names[k] for k in kept]
        out = [(where, x, x, float(found.solution[k]), None) for x, k in zip(own, kept, strict=True)]
        out += [(where, a, b, None, float(weight[i, j])) for i, a in enumerate(own) for j, b in enumerate(own)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), shape.types, strict=True)], schema=shape)

    stage = written(gram_cells(design).groupBy("_level").applyInArrow(fit, "env string, row string, col string, mean double, weight double"))
    means = stage.filter("mean is not null").select(F.col("env").alias(env), F.col("row").alias(entry), "mean")
    cells = stage.filter("weight is not null").select(F.col("env").alias("group"), "row", "col", F.col("weight").alias("value"))
    fixed = f"mean ~ {env}" if random else f"mean ~ 0 + {entry}"
    return mmec(means, fixed, f"~ {entry}" if random else None, residual={"units": 1.0}, fixed_residual=True, weight_matrix=Weights(cells, env, entry), **options)


def two_stage(df: DataFrame, value: str, entry: str, env: str, random: bool = False, **options) -> Model | AbsorbedModel:
    """Entry means by environment, then a model of these means weighted by n / residual variance of the environment.

    The first stage is two grouped sums; the second holds the residual at 1, so the weights are the precision.
    """
    y = F.col(value).cast("double")
    cells = df.filter(F.col(value).isNotNull()).groupBy(env, entry).agg(F.count("*").alias("_n"), F.avg(y).alias("_mean"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("_v"))
    spread = cells.groupBy(env).agg((F.sum(F.col("_v") * (F.col("_n") - 1)) / F.sum(F.col("_n") - 1)).alias("_s2"))
    means = cells.join(spread, env).filter("_s2 > 0").select(F.col(env).cast("string").alias(env), F.col(entry).cast("string").alias(entry), F.col("_mean").alias("mean"), (F.col("_n") / F.col("_s2")).alias("weight"))
    fixed = f"mean ~ {env}" if random else f"mean ~ 0 + {entry}"
    if not random and means.select(entry).distinct().limit(MAX_ORDER + 1).count() > MAX_ORDER:
        return fit_absorbed(build_design(means, "mean", (), False, (), None, "weight"), entry, (math.inf, 1.0))
    return mmec(means, fixed, f"~ {entry}" if random else None, weights="weight", residual={"units": 1.0}, fixed_residual=True, **options)


def lrt(full: Model, reduced: Model) -> dict[str, float]:
    """Likelihood-ratio test; degrees of freedom are the difference in estimated variance parameters and fixed coefficients."""
    size = lambda m: len(m.fit.kept) + sum(int(((t.codes > 0) & (t.codes < 3))[np.triu_indices(len(t.codes))].sum()) for t in m.design.random) + len(m.fit.residual) - m.fit.shared
    df, ratio = size(full) - size(reduced), max(0.0, 2 * (full.fit.loglik - reduced.fit.loglik))
    return {"ratio": ratio, "df": df, "p_value": chi2_sf(ratio, df) if df > 0 else 1.0}


def wald_test(covariance: np.ndarray, b: np.ndarray, contrast: np.ndarray | None = None, h0: np.ndarray | None = None, df: float | None = None) -> dict[str, float]:
    """Wald chi-squared of L b = h0, and F if residual degrees of freedom are given."""
    contrast = np.eye(len(b)) if contrast is None else np.atleast_2d(contrast)
    gap = contrast @ b - (0 if h0 is None else h0)
    chi2 = float(gap @ np.linalg.solve(contrast @ covariance @ contrast.T, gap))
    out = {"chi2": chi2, "df": len(contrast), "p_value": chi2_sf(chi2, len(contrast))}
    if df is not None:
        out |= {"f_value": chi2 / len(contrast), "f_p_value": f_sf(chi2 / len(contrast), len(contrast), df)}
    return out


class _Dual:
    """A value with its gradient."""

    def __init__(self, value: float, grad: np.ndarray):
        self.value, self.grad = value, grad


def _arithmetic(text: str, values: dict[str, _Dual], n: int) -> _Dual:
    """+ - * / ^ and exp, log, sqrt over V1..Vn, with derivatives carried along."""
    import re

    tokens = re.findall(r"\d+\.?\d*(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|\*\*|[-+*/^()]", text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"cannot read {text!r}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def total() -> _Dual:
        x = product()
        while peek() in ("+", "-"):
            sign, y = (1 if take() == "+" else -1), product()
            x = _Dual(x.value + sign * y.value, x.grad + sign * y.grad)
        return x

    def product() -> _Dual:
        x = signed()
        while peek() in ("*", "/"):
            op, y = take(), signed()
            x = _Dual(x.value * y.value, x.grad * y.value + y.grad * x.value) if op == "*" else _Dual(x.value / y.value, (x.grad * y.value - y.grad * x.value) / y.value**2)
        return x

    def signed() -> _Dual:
        if peek() == "-":
            take()
            x = signed()
            return _Dual(-x.value, -x.grad)
        return power()

    def power() -> _Dual:
        x = atom()
        if peek() in ("^", "**"):
            take()
            y = signed()
            value = x.value**y.value
            grad = y.value * x.value ** (y.value - 1) * x.grad
            if np.any(y.grad):
                grad = grad + value * math.log(x.value) * y.grad
            return _Dual(value, grad)
        return x

    def atom() -> _Dual:
        token = take() if peek() else ""
        if token == "(":
            x = total()
            if not peek() or take() != ")":
                raise ValueError(f"unclosed bracket in {text!r}")
            return x
        if token in ("exp", "log", "sqrt") and peek() == "(":
            x = atom()
            value = getattr(math, token)(x.value)
            slope = {"exp": value, "log": 1 / x.value, "sqrt": 0.5 / value if token == "sqrt" else 0}[token]
            return _Dual(value, slope * x.grad)
        if token in values:
            return values[token]
        try:
            return _Dual(float(token), np.zeros(n))
        except ValueError:
            raise ValueError(f"unknown {token!r} in {text!r}") from None

    out = total()
    if at != len(tokens):
        raise ValueError(f"cannot read {text!r} beyond {tokens[at]!r}")
    return out


def vpredict(model: Model, expression: str) -> tuple[float, float]:
    """Estimate and standard error (delta method) of a function of the variance components, V1..Vn in summary() order."""
    parts = model.components()
    unit = np.eye(len(parts))
    found = _arithmetic(expression, {f"V{i + 1}": _Dual(v, unit[i]) for i, (_, v) in enumerate(parts)}, len(parts))
    return found.value, math.sqrt(abs(float(found.grad @ model.covariance_of_components() @ found.grad)))


