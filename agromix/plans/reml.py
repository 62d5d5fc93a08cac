"""Restricted maximum likelihood on cross-products alone, by damped Newton steps on factors of the covariances.

Everything here is small and dense: Henderson's (1975) mixed-model equations from the sums of gram_of(). Random effects
are written as u = (F (x) I) v with F F' the covariance between inner levels, so the equations stay regular when a
variance is zero or a covariance is singular, and the edge of the parameter space needs no special case. The curvature is
the average information (Gilmour et al. 1995, Jensen et al. 1997) along the factors plus the exact second-order term of
the factors themselves; directions of negative curvature are turned round. Residual variances are stepped on a log scale
with a floor: a perfect fit ends there and is reported. The working variates of random effects lie in the span of W and
those of residual variances follow from the residual sums of squares, so no iteration touches the records again.

Covariances with entries held at values or at zero have no free factor; these step on the entries, inside the cone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from agromix.plans.design import Design, Gram, RandomTerm

__all__ = ["Chart", "Fit", "ascend", "fit_reml", "from_free", "independent_columns", "psd_factor", "scaled_columns"]

#: Residual variances stay above this share of the variance that the fixed effects leave.
FLOOR = 1e-10


@dataclass
class Fit:
    """A final state: all parts belong to the same parameters. ``boundary`` names what lies at the edge of its space."""

    theta: list[np.ndarray]
    residual: dict[str, float]
    loglik: float
    converged: bool
    iterations: int
    kept: np.ndarray
    solution: np.ndarray
    c_inverse: np.ndarray
    ypy: float
    parameters: list[tuple]
    information: np.ndarray
    score: np.ndarray
    monitor: list[tuple[float, float]] = field(default_factory=list)
    boundary: list[str] = field(default_factory=list)
    shared: int = 0


def independent_columns(a: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Indexes of columns that do not depend on earlier ones, from a cross-product matrix, by sweeping in order."""
    left, kept = a.astype(float).copy(), []
    scale = np.maximum(np.diag(a), 1e-300)
    for j in range(len(a)):
        if left[j, j] > tol * scale[j]:
            kept.append(j)
            left -= np.outer(left[:, j], left[j]) / left[j, j]
    return np.array(kept, dtype=int)


def psd_factor(theta: np.ndarray) -> np.ndarray:
    """A square F with F F' = theta, for any positive semidefinite theta; its eigenvalues under zero count as zero."""
    values, vectors = np.linalg.eigh(theta)
    return vectors * np.sqrt(np.maximum(values, 0))


def scaled_columns(m: np.ndarray, factor: np.ndarray, q: int) -> np.ndarray:
    """m (F (x) I): the columns of one effect, inner levels outermost, times its factor."""
    return np.einsum("rsk,st->rtk", m.reshape(len(m), len(factor), q), factor).reshape(len(m), -1)


class Chart:
    """How one effect's covariance is parametrised: by a lower factor, by its diagonal, by free entries, or not at all."""

    def __init__(self, start: np.ndarray, codes: np.ndarray):
        n = len(start)
        free, off = np.isin(codes, (1, 2)), ~np.eye(n, dtype=bool)
        lower = [(i, j) for j in range(n) for i in range(j, n)]
        self.theta = start
        if not free.any():
            self.kind, self.places = "held", []
        elif free.all():
            self.kind, self.places = "factor", lower
        elif not codes[off].any():
            self.kind, self.places = "factor", [(i, i) for i in range(n) if free[i, i]]
        else:
            self.kind, self.places = "entries", [(i, j) for i, j in lower if free[i, j]]
        if self.kind == "factor" and len(self.places) < n * (n + 1) // 2:
            self.value = np.diag(np.sqrt(np.maximum(start.diagonal(), 0)))
        elif self.kind == "factor":
            try:
                self.value = np.linalg.cholesky(start)
            except np.linalg.LinAlgError:
                raise ValueError("the starting covariances are not positive definite") from None
        else:
            self.value = start

    def covariance(self, value: np.ndarray) -> np.ndarray:
        return value @ value.T if self.kind == "factor" else value

    def factor(self, value: np.ndarray) -> np.ndarray | None:
        if self.kind == "factor":
            return value
        if self.kind == "held":
            return psd_factor(value)
        values = np.linalg.eigvalsh(value)
        return psd_factor(value) if values[0] >= -1e-12 * max(values[-1], 0) and values[-1] > 0 else None

    def directions(self) -> list[np.ndarray]:
        """What the covariance changes by as each parameter does."""
        out = []
        for i, j in self.places:
            unit = np.zeros_like(self.theta)
            unit[i, j] = 1.0
            if self.kind == "factor":
                out.append(unit @ self.value.T + self.value @ unit.T)
            else:
                out.append(np.maximum(unit, unit.T))
        return out

    def bend(self, slope: np.ndarray) -> np.ndarray:
        """The second-order part of the curvature: -sum of slope and the second derivatives of F F'."""
        if self.kind != "factor":
            return np.zeros((len(self.places), len(self.places)))
        return np.array([[-2 * slope[a, c] if b == d else 0.0 for c, d in self.places] for a, b in self.places])

    def moved(self, step: np.ndarray) -> np.ndarray:
        out = self.value.copy()
        for (i, j), s in zip(self.places, step, strict=True):
            out[i, j] += s
            if self.kind == "entries" and i != j:
                out[j, i] += s
        return out


def from_free(factor: np.ndarray, v: np.ndarray, spread: np.ndarray, kernel_inverse: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(slope, K Z'Py) of an effect from its scale-free form, or None where the records say too little of it for that.

    Where records tell an effect well, Z'PZ is a small difference of large numbers, and this form keeps the digits; near
    zero variance it is the other way round.
    """
    q = v.shape[1]
    if (1 - np.diag(spread) / q).min() < 0.1:
        return None
    back = np.linalg.inv(factor.T)
    inner = 0.5 * (v @ (v.T if kernel_inverse is None else kernel_inverse @ v.T) - q * np.eye(len(v)) + (spread + spread.T) / 2)
    return back @ inner @ back.T, back @ v


class _Equations:
    """The mixed-model equations of a design, solved at given parameters."""

    def __init__(self, gram: Gram, terms: list[RandomTerm], kept: np.ndarray):
        self.gram, self.terms = gram, terms
        self.columns = np.concatenate([kept, *(np.arange(t.start, t.start + t.size) for t in terms)]).astype(int)
        self.places, at = [], len(kept)
        for t in terms:
            self.places.append(slice(at, at + t.size))
            at += t.size
        take = np.append(self.columns, len(next(iter(gram.sums.values()))) - 1)
        self.sums = {x: m[np.ix_(take, take)] for x, m in gram.sums.items() if gram.records[x]}
        self.kernels = [None if t.kernel_inverse is None else np.linalg.inv(t.kernel_inverse) for t in terms]

    def solve(self, factors: list[np.ndarray], residual: dict[str, float]) -> dict | None:
        m = sum(s / residual[x] for x, s in self.sums.items())
        c, logdet = m[:-1, :-1].copy(), 0.0
        for t, at, f in zip(self.terms, self.places, factors, strict=True):
            c[:, at] = scaled_columns(c[:, at], f, len(t.main))
        for t, at, f in zip(self.terms, self.places, factors, strict=True):
            q = len(t.main)
            c[at] = scaled_columns(c[at].T, f, q).T
            own = c[at, at]
            for s in range(len(f)):
                one = slice(s * q, (s + 1) * q)
                own[one, one] += np.eye(q) if t.kernel_inverse is None else t.kernel_inverse
            logdet += len(f) * t.kernel_logdet
        try:
            chol = np.linalg.cholesky((c + c.T) / 2)
        except np.linalg.LinAlgError:
            return None
        c_inverse = np.linalg.inv(c)
        rhs = m[:-1, -1].copy()
        for t, at, f in zip(self.terms, self.places, factors, strict=True):
            rhs[at] = scaled_columns(rhs[None, at], f, len(t.main))[0]
        free, spreads = c_inverse @ rhs, []  # effects free of scale, and their traces with inv(K)
        free = free + c_inverse @ (rhs - c @ free)
        # y'Py by a form in which errors of the effects are of second order: it is a small difference of large numbers
        ypy = float(m[-1, -1] - rhs @ free - free @ (rhs - c @ free))
        for t, at, f in zip(self.terms, self.places, factors, strict=True):
            q, n = len(t.main), len(f)
            own = c_inverse[at, at].reshape(n, q, n, q)
            spreads.append(np.einsum("ikjk->ij", own) if t.kernel_inverse is None else np.einsum("ikjl,kl->ij", own, t.kernel_inverse))
        for t, at, f in zip(self.terms, self.places, factors, strict=True):  # back to u
            c_inverse[:, at] = scaled_columns(c_inverse[:, at], f.T, len(t.main))
        for t, at, f in zip(self.terms, self.places, factors, strict=True):
            c_inverse[at] = scaled_columns(c_inverse[at].T, f.T, len(t.main)).T
        solution = free.copy()
        for t, at, f in zip(self.terms, self.places, factors, strict=True):
            solution[at] = scaled_columns(free[None, at], f.T, len(t.main))[0]
        log_r = sum(self.gram.records[x] * np.log(residual[x]) - self.gram.log_weights[x] for x in self.sums)
        loglik = -0.5 * (logdet + 2 * np.log(np.diag(chol)).sum() + log_r + ypy)
        return {"m": m, "c_inverse": c_inverse, "solution": solution, "ypy": ypy, "loglik": float(loglik), "free": free, "spreads": spreads, "factors": factors} if np.isfinite(loglik) else None

    def slopes(self, state: dict, residual: dict[str, float], wanted: list[int]) -> tuple[dict, dict, dict]:
        """Slopes of the likelihood: for effects a matrix over inner levels, and K Z'Py; for residual levels (slope, sum of squares)."""
        m, ci, b = state["m"][:-1, :-1], state["c_inverse"], state["solution"]
        gap, effects, pulls = state["m"][:-1, -1] - m @ b, {}, {}
        for k in wanted:
            t, at, kernel = self.terms[k], self.places[k], self.kernels[k]
            q, n = len(t.main), t.size // len(t.main)
            if (found := from_free(state["factors"][k], state["free"][at].reshape(n, q), state["spreads"][k], t.kernel_inverse)) is not None:
                effects[k], pulls[k] = found
                continue
            g = gap[at].reshape(n, q)
            pulled = g if kernel is None else g @ kernel
            left = ci @ m[:, at]
            trace = np.empty((n, n))
            for i in range(n):
                for j in range(i + 1):
                    a, c = slice(at.start + i * q, at.start + (i + 1) * q), slice(j * q, (j + 1) * q)
                    own = slice(at.start + j * q, at.start + (j + 1) * q)
                    if kernel is None:
                        trace[i, j] = trace[j, i] = np.trace(m[a, own]) - np.einsum("rc,cr->", m[a], left[:, c])
                    else:
                        trace[i, j] = trace[j, i] = np.sum(kernel * (m[a, own] - m[a] @ left[:, c]))
            effects[k], pulls[k] = 0.5 * (g @ pulled.T - trace), pulled
        levels = {}
        for x, s in self.sums.items():
            ss = float(s[-1, -1] - 2 * b @ s[:-1, -1] + b @ s[:-1, :-1] @ b)
            v = residual[x]
            levels[x] = (-0.5 * (self.gram.records[x] / v - np.sum(ci * s[:-1, :-1]) / v**2 - ss / v**2), ss)
        return effects, pulls, levels

    def information(self, state: dict, residual: dict[str, float], pulls: dict, levels: dict, along: list[tuple]) -> np.ndarray:
        """Average information along directions: ("theta", k, matrix) or ("residual", level)."""
        m, ci, b = state["m"][:-1, :-1], state["c_inverse"], state["solution"]
        columns, ss = [], {}
        for p in along:
            if p[0] == "theta":
                d = np.zeros(len(b))
                d[self.places[p[1]]] = (p[2] @ pulls[p[1]]).ravel()
                columns.append((d, m @ d))
            else:
                s = self.sums[p[1]]
                ss[p[1]] = levels[p[1]][1]
                columns.append((None, (s[:-1, -1] - s[:-1, :-1] @ b) / residual[p[1]] ** 2))
        right = np.array([w for _, w in columns])
        info = -right @ ci @ right.T
        for a, (da, wa) in enumerate(columns):
            for c, (dc, wc) in enumerate(columns):
                if da is not None:
                    info[a, c] += da @ wc
                elif dc is not None:
                    info[a, c] += dc @ wa
                elif a == c:
                    info[a, c] += ss[along[a][1]] / residual[along[a][1]] ** 3
        return 0.25 * (info + info.T)

    def em(self, theta: list[np.ndarray], residual: dict[str, float], state: dict, codes: list[np.ndarray], held: set) -> tuple[list[np.ndarray], dict[str, float]]:
        """One step of expectation and maximisation."""
        ci, u, new = state["c_inverse"], state["solution"], []
        for k, (t, at) in enumerate(zip(self.terms, self.places, strict=True)):
            q, n = len(t.main), t.size // len(t.main)
            a = np.eye(q) if t.kernel_inverse is None else t.kernel_inverse
            ui, own = u[at].reshape(n, q), ci[at, at].reshape(n, q, n, q)
            moment = ui @ a @ ui.T + np.einsum("ikjl,kl->ij", own, a)
            new.append(np.where(np.isin(codes[k], (1, 2)), moment / q, theta[k]))
        out = dict(residual)
        for x, s in self.sums.items():
            if x not in held:
                ss = float(s[-1, -1] - 2 * u @ s[:-1, -1] + u @ s[:-1, :-1] @ u)
                out[x] = (ss + float(np.sum(ci * s[:-1, :-1]))) / self.gram.records[x]
        return new, out


def ascend(slope: np.ndarray, curvature: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The Newton step up, in units of ``scale``; directions that curve the wrong way are taken by the size of their curve."""
    g, h = slope * scale, curvature * np.outer(scale, scale)
    size = np.sqrt(np.maximum(np.abs(np.diag(h)), 1e-12 * max(np.abs(h).max(), 1e-300)))
    values, vectors = np.linalg.eigh(h / np.outer(size, size))
    values = np.maximum(np.abs(values), 1e-9 * np.abs(values).max())
    return vectors @ ((vectors.T @ (g / size)) / values) / size


def _name(term: RandomTerm, i: int) -> str:
    """What summaries call the variance of an effect's inner level."""
    return term.label if len(term.theta) == 1 else f"{term.label}.{term.inner[i]}:{term.inner[i]}"


def _shared(groups: Sequence[dict[str, float]], names: list[str], multiples: dict) -> np.ndarray:
    """The map from free parameters to all of them, where those of a group are fixed multiples of one.

    Variances of effects are stepped by their roots, so the roots' ratios stay; residual ones by their logarithms.
    """
    column, roots = list(range(len(names))), np.ones(len(names))
    for group in groups:
        at = []
        for name, c in group.items():
            if name not in names or not c > 0:
                raise ValueError(f"{name} is no free variance that can be tied, or its multiple isn't positive")
            at.append(names.index(name))
        sides = {names[i].startswith("residual.") for i in at}
        if len(sides) != 1 or len(at) < 2 or any(column[i] != i or column.count(i) > 1 for i in at):
            raise ValueError("a tie holds two or more variances of effects, or of residuals, each in one tie")
        for i, c in zip(at, group.values(), strict=True):
            column[i], multiples[names[i]] = at[0], (names[at[0]], float(c) / float(group[names[at[0]]]))
            if True not in sides:
                roots[i] = np.sqrt(float(c) / float(group[names[at[0]]]))
    tie = np.zeros((len(names), len(names)))
    tie[np.arange(len(names)), column] = roots
    return tie[:, sorted(set(column))]


def fit_reml(design: Design, gram: Gram, theta: dict[str, np.ndarray] | None = None, codes: dict[str, np.ndarray] | None = None, residual: dict[str, float] | None = None, fixed_residual: bool = False, iterations: int = 100, tol: float = 1e-8, em_only: bool = False, ties: Sequence[dict[str, float]] = ()) -> Fit:
    """Estimates all parameters whose code is 1 (positive) or 2 (free); 0 leaves out, 3 keeps the start.

    ``ties``: variances, by the names of summaries, that are the given multiples of one common parameter.

    It has converged when a full step would move no parameter by more than ``tol`` of its scale, or when rounding of the
    likelihood hides any gain. ``iterations`` bounds the work; a fit that it ends says so (``converged``).
    """
    terms = design.random
    n_fixed = sum(b.size for b in design.fixed)
    total = sum(gram.sums.values())
    kept = independent_columns(total[:n_fixed, :n_fixed]) if n_fixed else np.array([], int)
    records = sum(gram.records.values())
    if records <= len(kept):
        raise ValueError(f"{records} records do not tell {len(kept)} fixed coefficients apart from error")
    weight = total[:n_fixed, :n_fixed][np.ix_(kept, kept)]
    rss = total[-1, -1] - (total[kept, -1] @ np.linalg.solve(weight, total[kept, -1]) if len(kept) else 0.0)
    vy = max(rss / (records - len(kept)), 1e-13 * total[-1, -1] / records, 1e-300)
    floor = FLOOR * vy
    codes_ = [np.asarray((codes or {}).get(t.label, t.codes), int) for t in terms]
    starts = [np.array((theta or {}).get(t.label, t.theta * vy), float) for t in terms]
    charts = [Chart(np.where(c == 0, 0.0, v), c) for c, v in zip(codes_, starts, strict=True)]
    levels = [x for x in design.levels if gram.records[x]]
    left = {x: float((residual or {}).get(x, 0.75 * vy)) for x in levels}
    held = set(levels) if fixed_residual else set()
    eq = _Equations(gram, terms, kept)
    wanted = [k for k, c in enumerate(charts) if c.places]
    free_levels = [x for x in levels if x not in held]
    multiples: dict = {}
    tie = np.eye(sum(len(charts[k].places) for k in wanted) + len(free_levels))
    if ties:
        if em_only:
            raise ValueError("ties are stepped by Newton's method alone")
        diagonal = lambda k, i, j: i == j and charts[k].kind == "factor" and all(a == b for a, b in charts[k].places)
        names = [_name(terms[k], i) if diagonal(k, i, j) else "" for k in wanted for i, j in charts[k].places] + [f"residual.{x}" for x in free_levels]
        tie = _shared(ties, names, multiples)
        at = {_name(terms[k], i): (k, i) for k in wanted for i, j in charts[k].places if diagonal(k, i, j)}
        for name, (first, c) in multiples.items():
            if name in at:
                (k, i), (m, j) = at[name], at[first]
                charts[k].value[i, i] = charts[m].value[j, j] * np.sqrt(c)
            else:
                left[name.removeprefix("residual.")] = left[first.removeprefix("residual.")] * c
    factors = [c.factor(c.value) for c in charts]
    state = eq.solve(factors, left) if all(f is not None for f in factors) else None
    if state is None:
        raise ValueError("the starting covariances are not positive definite")
    scale = np.array([np.sqrt(vy) if charts[k].kind == "factor" else vy for k in wanted for _ in charts[k].places] + [1.0] * len(free_levels))
    scale = scale[[int(np.flatnonzero(c)[0]) for c in tie.T]]
    monitor, converged, cycle, quiet = [], False, 0, 0
    while cycle < iterations:
        cycle += 1
        if not len(scale):
            converged = True
            break
        effects, pulls, by_level = eq.slopes(state, left, wanted)
        along = [("theta", k, d) for k in wanted for d in charts[k].directions()] + [("residual", x) for x in free_levels]
        slope = np.array([np.sum(effects[p[1]] * p[2]) if p[0] == "theta" else by_level[p[1]][0] * left[p[1]] for p in along])
        curve = eq.information(state, left, pulls, by_level, along)
        stretch = np.array([1.0 if p[0] == "theta" else left[p[1]] for p in along])
        curve = curve * np.outer(stretch, stretch)
        at = 0
        for k in wanted:
            n = len(charts[k].places)
            curve[at : at + n, at : at + n] += charts[k].bend(effects[k])
            at += n
        for i in range(at, len(along)):
            curve[i, i] -= slope[i]
        pinned = [at + i for i, x in enumerate(free_levels) if left[x] <= 1.01 * floor and slope[at + i] < 0]
        slope, curve = tie.T @ slope, tie.T @ curve @ tie
        pinned = [f for f, c in enumerate(tie.T) if set(np.flatnonzero(c)) <= set(pinned)]
        slope[pinned] = 0.0
        monitor.append((state["loglik"], float(np.abs(slope * scale).max())))
        step = ascend(slope, curve, scale)
        step[pinned] = 0.0
        if em_only:
            theta_new, left_new = eq.em([c.covariance(c.value) for c in charts], left, state, codes_, held)
            candidate = eq.solve([psd_factor(x) for x in theta_new], left_new)
            if candidate is None:
                break
            change = max([0.0, *(float(np.abs(a - c.covariance(c.value)).max()) / vy for a, c in zip(theta_new, charts, strict=True)), *(abs(left_new[x] - left[x]) / vy for x in levels)])
            for c, x in zip(charts, theta_new, strict=True):
                c.value = psd_factor(x) if c.kind == "factor" else x
            left, state = left_new, candidate
            if change < tol:
                converged = True
                break
            continue
        longest = float(np.abs(step).max())
        slack = 1e-9 if longest < 1e-2 else 1e-13  # near the top, rounding hides what a step gains
        blur = 4 * np.finfo(float).eps * state["m"][-1, -1]  # of y'Py, which is a difference from y'R^-1 y
        found, size = None, min(1.0, 3.0 / longest) if longest > 3 else 1.0
        while size > 1e-9:
            move, at = tie @ (size * step * scale), 0
            values = [c.value for c in charts]
            for k in wanted:
                n = len(charts[k].places)
                values[k] = charts[k].moved(move[at : at + n])
                at += n
            left_new = left | {x: max(left[x] * float(np.exp(np.clip(s, -30, 30))), floor) for x, s in zip(free_levels, move[at:], strict=True)}
            factors = [c.factor(v) for c, v in zip(charts, values, strict=True)]
            candidate = eq.solve(factors, left_new) if all(f is not None for f in factors) else None
            if candidate is not None and candidate["loglik"] >= state["loglik"] - slack * (1 + abs(state["loglik"])) - blur:
                found = values, left_new, candidate
                break
            size /= 4
        gain = float(slope * scale @ step)
        if found is None:  # no step goes up: at the top but for rounding, or stuck
            converged = gain < 1e-6
            break
        for c, v in zip(charts, found[0], strict=True):
            c.value = v
        left, state = found[1], found[2]
        quiet = quiet + 1 if gain < 1e-13 * (1 + abs(state["loglik"])) else 0
        if longest < tol or quiet == 3:
            converged = True
            break
    now, boundary = [], []
    for t, c in zip(terms, charts, strict=True):
        theta_ = c.covariance(c.value)
        if c.places:
            small = np.diag(theta_) < 1e-12 * vy
            theta_[small] = 0.0
            theta_[:, small] = 0.0
            if small.any() or np.linalg.eigvalsh(theta_)[0] < 1e-9 * max(np.trace(theta_), floor):
                boundary.append(t.label)
        now.append(theta_)
    boundary += [f"residual.{x}" for x in free_levels if left[x] <= 1.01 * floor]
    state = eq.solve([psd_factor(x) for x in now], left) or state
    inside = [k for k in wanted if np.diag(now[k]).any()]
    effects, pulls, by_level = eq.slopes(state, left, inside)
    parameters, along, score = [], [], []
    for k in inside:
        for j in range(len(now[k])):
            for i in range(j + 1):
                if codes_[k][i, j] in (1, 2) and now[k][i, i] > 0 and now[k][j, j] > 0:
                    unit = np.zeros_like(now[k])
                    unit[i, j] = unit[j, i] = 1.0
                    parameters.append(("theta", k, i, j))
                    along.append(("theta", k, unit))
                    score.append(float(np.sum(effects[k] * unit)))
    for x in free_levels:
        parameters.append(("residual", x))
        along.append(("residual", x))
        score.append(by_level[x][0])
    info = eq.information(state, left, pulls, by_level, along) if along else np.zeros((0, 0))
    if multiples and len(along):
        called = [_name(terms[p[1]], p[2]) if p[0] == "theta" and p[2] == p[3] else f"residual.{p[1]}" if p[0] == "residual" else "" for p in parameters]
        first = [multiples.get(n, (n, 1.0))[0] if n else i for i, n in enumerate(called)]
        spread = np.array([[multiples.get(n, (n, 1.0))[1] if f == g else 0.0 for g in dict.fromkeys(first)] for n, f in zip(called, first, strict=True)])
        # an information whose generalised inverse is the covariance of all, the tied ones moving together
        info = np.linalg.pinv(spread @ np.linalg.pinv(spread.T @ info @ spread) @ spread.T)
    solution, inverse = np.zeros(design.width), np.zeros((design.width, design.width))
    solution[eq.columns] = state["solution"]
    inverse[np.ix_(eq.columns, eq.columns)] = state["c_inverse"]
    return Fit(now, left, state["loglik"], converged, cycle, kept, solution, inverse, state["ypy"], parameters, info, np.array(score), monitor, boundary, tie.shape[0] - tie.shape[1])
