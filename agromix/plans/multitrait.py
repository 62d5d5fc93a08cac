"""Several traits at once: unstructured covariances of traits for every random effect and for the residual.

Records with all traits share one design W, so the mixed-model equations are inv(S) (x) W'W plus inv(T) (x) inv(A) for
each random effect, and only W'W, W'Y and Y'Y are needed: one grouped sum over the records however many traits there
are. REML by damped Newton steps on lower factors of the covariances, as in reml.py, so singular ones are no special case.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agromix.operators.matrices import nearest_pd
from agromix.operators.records import na_policy
from agromix.plans.design import Design, build_design, gram_of
from agromix.plans.formula import Call, parse_formula, parse_terms
from agromix.plans.reml import Chart, ascend, from_free, independent_columns

__all__ = ["MultiFit", "fit_pairs", "fit_traits", "merged_pairs"]


@dataclass
class MultiFit:
    spark: SparkSession
    traits: list[str]
    design: Design
    theta: list[np.ndarray]
    residual: np.ndarray
    loglik: float
    converged: bool
    iterations: int
    solution: np.ndarray

    def summary(self) -> DataFrame:
        """(term, trait1, trait2, covariance, correlation, converged) of every random effect and the residual."""
        rows = []
        for label, m in [*((t.label, m) for t, m in zip(self.design.random, self.theta, strict=True)), ("units", self.residual)]:
            for j, b in enumerate(self.traits):
                for i, a in enumerate(self.traits[: j + 1]):
                    scale = float(np.sqrt(m[i, i] * m[j, j]))
                    rows.append((label, a, b, float(m[i, j]), float(m[i, j]) / scale if scale > 0 else None, self.converged))
        return self.spark.createDataFrame(rows, "term string, trait1 string, trait2 string, covariance double, correlation double, converged boolean")

    def effects(self) -> DataFrame:
        """(term, level, trait, value): fixed coefficients and predicted random effects."""
        names = [(b.label, x) for b in (*self.design.fixed, *self.design.random) for x in b.names]
        rows = [(*names[i], t, float(self.solution[i, k])) for i in range(len(names)) for k, t in enumerate(self.traits)]
        return self.spark.createDataFrame(rows, "term string, level string, trait string, value double")


def _sums(df: DataFrame, design: Design, traits: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """W'W, W'Y, Y'Y and the number of records; each trait adds a pair of entries to the grouped sum."""
    c = design.width
    ys = [F.struct(F.lit(c + k).cast("int").alias("i"), F.col(t).cast("double").alias("v")) for k, t in enumerate(traits)]
    wide = design.rows.withColumn("_entries", F.concat("_entries", F.array(*ys)))
    full = Design(wide.withColumn("_y", F.lit(0.0)), design.fixed, [*design.random], design.levels, True)
    grown = type("Grown", (), {"width": c + len(traits), "rows": full.rows, "numeric": True, "levels": design.levels})()
    gram = gram_of(grown)
    total = sum(gram.sums.values())
    return total[:c, :c], total[:c, c : c + len(traits)], total[c : c + len(traits), c : c + len(traits)], sum(gram.records.values())


def fit_traits(df: DataFrame, fixed: str, random: str | None = None, kernels: dict | None = None, covariances: dict | None = None, residual: dict | None = None, iterations: int = 200, tol: float = 1e-8) -> MultiFit:
    """cbind(y1, y2, ..) ~ fixed; every random term gets an unstructured covariance of the traits. Records lacking a trait are left out.

    vsr(x, Gti=A, Gtc=C) starts a random term's covariance of traits at A (in units of the records) and constrains it by
    the codes C; a fixed vsr(x, Gtc=F) holds for the traits that fcm() selects in F only. The names stand for matrices in
    ``covariances``. ``residual`` may hold Gti and Gtc of the residual.
    """
    formula = parse_formula(fixed)
    traits, t = list(formula.responses), len(formula.responses)
    terms = parse_terms(random)[0] if random else ()
    rows = na_policy(df, traits)
    named = lambda x, key: np.asarray(covariances[str(x.named[key])], float) if isinstance(x, Call) and key in x.named else None
    selected = {str(x.args[-1]): np.asarray(named(x, "Gtc")).any(axis=1) for x in formula.terms if named(x, "Gtc") is not None}
    fixed_terms = tuple(x.args[-1] if isinstance(x, Call) and x.name in ("vs", "vsr", "vsc") else x for x in formula.terms)
    design = build_design(rows, traits[0], fixed_terms, formula.intercept, terms, kernels=kernels, covariances=covariances)
    starts = [(named(x, "Gti"), named(x, "Gtc")) for x in terms] + [((residual or {}).get("Gti"), (residual or {}).get("Gtc"))]
    found = _maximise(design, *_sums(rows, design, traits), starts, selected, iterations, tol)
    if not found[3]:
        warnings.warn(f"the fit of {fixed} has not converged in {found[4]} iterations", stacklevel=2)
    return MultiFit(df.sparkSession, traits, design, *found)


def _told(ww: np.ndarray, wy: np.ndarray, yy: np.ndarray, common: np.ndarray, use: np.ndarray, blocks: list[slice], random: list) -> tuple:
    """W'W, W'Y and Y'Y of the columns ``use`` with ``common`` absorbed, the way back of their coefficients, log |X'X|.

    Coefficients of a random effect are along the axes of its own part of W'W, in which they are independent with variance
    one. What the records don't tell (a shift of all levels, the mean being fixed) is an axis of exact zeros then; in
    levels it would be a difference of large numbers, of which rounding leaves nothing where there are many records.
    """
    level = np.linalg.solve(ww[np.ix_(common, common)], np.hstack([ww[np.ix_(common, use)], wy[common]]))
    on, level = level[:, : len(use)], level[:, len(use) :]
    yy = yy - wy[common].T @ level - level.T @ wy[common] + level.T @ ww[np.ix_(common, common)] @ level
    whole, cross = ww[np.ix_(use, use)], ww[np.ix_(use, common)]
    left, turn, zero = whole - cross @ on, np.eye(len(use)), np.zeros(len(use), bool)
    for at, r in zip(blocks, random, strict=True):
        root = np.eye(r.size) if r.kernel_inverse is None else np.linalg.cholesky(np.linalg.inv(r.kernel_inverse))
        values, vectors = np.linalg.eigh(root.T @ left[at, at] @ root)
        zero[at] = values <= 10 * r.size * np.finfo(float).eps * np.trace(root.T @ whole[at, at] @ root) / max(r.size, 1)
        turn[at, at] = root @ vectors
    made, right = turn.T @ left @ turn, turn.T @ (wy[use] - cross @ level)
    for at in blocks:
        made[at, at] = np.diag(np.diag(made[at, at]))
    made[zero], made[:, zero], right[zero] = 0.0, 0.0, 0.0
    return made, right, yy, lambda b: (level - on @ (turn @ b), turn @ b), np.linalg.slogdet(ww[np.ix_(common, common)])[1]


def _maximise(design, ww: np.ndarray, wy: np.ndarray, yy: np.ndarray, n: int, starts: list[tuple], selected: dict[str, np.ndarray], iterations: int, tol: float) -> tuple:
    """(covariances of the random effects, of the residual, log-likelihood, converged, iterations, solution) from the sums alone.

    Of the design only its blocks are used; ``starts``: start and codes of each random effect and the residual.
    """
    t = len(yy)
    n_fixed = sum(b.size for b in design.fixed)
    kept = independent_columns(ww[:n_fixed, :n_fixed])
    lacking = np.zeros((t, len(kept)), bool)  # which fixed coefficients which trait lacks
    for b in design.fixed:
        if b.label in selected:
            lacking[np.ix_(~selected[b.label], np.isin(kept, np.arange(b.start, b.start + b.size)).nonzero()[0])] = True
    common, own = kept[~lacking.any(axis=0)], kept[lacking.any(axis=0)]
    use = np.concatenate([own, np.arange(n_fixed, design.width)]).astype(int)
    c, blocks = len(use), [slice(len(own) + r.start - n_fixed, len(own) + r.start - n_fixed + r.size) for r in design.random]
    ww, wy, yy, back, base_logdet = _told(ww, wy, yy, common, use, blocks, design.random)
    n -= len(common)
    vy = yy / max(n, 1)
    # sums of squares are taken about all effects' least squares: the likelihood is a sum of positive parts then, not a
    # small difference of large numbers, whose rounding would hide what a step gains
    told, least = independent_columns(ww), np.zeros((c, t))
    for _ in range(2):  # the second time for what rounding left
        least[told] += np.linalg.solve(ww[np.ix_(told, told)], (wy - ww @ least)[told])
    rest = wy - ww @ least  # rounding alone, but for columns that nearly depend on others
    within = yy - wy.T @ least - least.T @ wy + least.T @ ww @ least
    free = np.where(np.eye(t, dtype=bool), 1, 2)

    def chart(start: np.ndarray | None, codes: np.ndarray | None, default: np.ndarray) -> Chart:
        codes = free if codes is None else np.asarray(codes, int)
        return Chart(np.where(codes == 0, 0.0, default if start is None else start), codes)

    charts = [chart(*x, 0.2 * np.diag(np.diag(vy))) for x in starts[:-1]]
    charts.append(chart(*starts[-1], 0.6 * vy + 0.2 * np.diag(np.diag(vy))))
    there = np.hstack([~lacking[:, lacking.any(axis=0)], np.ones((t, c - len(own)), bool)]).ravel()  # which coefficients which trait has

    def solve(factors: list[np.ndarray]) -> dict | None:
        """The equations for all traits, trait outermost, in effects free of scale."""
        s = factors[-1] @ factors[-1].T if factors[-1] is not None else np.zeros((t, t))
        if any(f is None for f in factors) or np.linalg.eigvalsh(s / np.sqrt(np.outer(np.diag(vy), np.diag(vy))))[0] < 1e-13:  # the residual covariance must stay regular
            return None
        si = np.linalg.inv(s)
        m = np.kron(si, ww).reshape(t, c, t, c)
        left, logdet = m.copy(), n * np.linalg.slogdet(s)[1] + t * base_logdet
        for at, f in zip(blocks, factors, strict=False):
            left[:, :, :, at] = np.einsum("icjk,jl->iclk", left[:, :, :, at], f)
        for at, f in zip(blocks, factors, strict=False):
            left[:, at] = np.einsum("ikjc,il->lkjc", left[:, at], f)
            for i in range(t):
                left[i, at, i, at] += np.eye(at.stop - at.start)
        flat = left.reshape(t * c, t * c)
        try:
            flat = flat[np.ix_(there, there)]
            logdet += 2 * np.log(np.diag(np.linalg.cholesky((flat + flat.T) / 2))).sum()
        except np.linalg.LinAlgError:
            return None
        ci = np.zeros((t * c, t * c))
        ci[np.ix_(there, there)] = np.linalg.inv(flat)
        ci = ci.reshape(t, c, t, c)
        scaled = (wy @ si).T.copy()  # right-hand sides, traits in rows
        for at, f in zip(blocks, factors, strict=False):
            scaled[:, at] = f.T @ scaled[:, at]
        free = np.einsum("icjk,jk->ic", ci, scaled)
        free += np.einsum("icjk,jk->ic", ci, np.where(there.reshape(t, c), scaled - np.einsum("icjk,jk->ic", left, free), 0.0))
        spreads = [np.einsum("ikjk->ij", ci[:, at][:, :, :, at]) for at in blocks]
        for at, f in zip(blocks, factors, strict=False):
            ci[:, :, :, at] = np.einsum("iclk,jl->icjk", ci[:, :, :, at], f)
        for at, f in zip(blocks, factors, strict=False):
            ci[:, at] = np.einsum("lkjc,il->ikjc", ci[:, at], f)
        flat = ci.reshape(t * c, t * c)
        coef = free.T.copy()
        for at, f in zip(blocks, factors, strict=False):
            coef[at] = coef[at] @ f.T
        off = least - coef
        gap = ww @ off + rest  # W'E
        ee = within + off.T @ gap + rest.T @ off
        loglik = -0.5 * (logdet + float(np.sum(si * ee) + np.sum(free[:, len(own) :] ** 2)))
        return {"ci": ci, "flat": flat, "m": m.reshape(t * c, t * c), "b": coef, "gap": gap, "loglik": loglik, "ee": ee, "si": si, "free": free, "spreads": spreads, "factors": factors} if np.isfinite(loglik) else None

    state, converged, cycle, quiet = solve([x.factor(x.value) for x in charts]), False, 0, 0
    if state is None:
        raise ValueError("the starting covariances are not positive definite")
    scale = np.array([np.sqrt(vy[i, i]) if x.kind == "factor" else np.sqrt(vy[i, i] * vy[j, j]) for x in charts for i, j in x.places])
    while cycle < iterations:
        cycle += 1
        si, gap = state["si"], state["gap"]
        slopes, pulls = [], []
        for k, at in enumerate(blocks):
            if (found := from_free(state["factors"][k], state["free"][:, at], state["spreads"][k], None)) is not None:
                slopes.append(found[0])
                pulls.append(found[1].T)
                continue
            pulls.append((gap @ si)[at])
            places = np.concatenate([np.arange(i * c + at.start, i * c + at.stop) for i in range(t)])
            q = at.stop - at.start
            zpz = (state["m"][np.ix_(places, places)] - state["m"][places] @ (state["flat"] @ state["m"][:, places])).reshape(t, q, t, q)
            slopes.append(0.5 * (pulls[-1].T @ pulls[-1] - np.einsum("ikjk->ij", zpz)))
        trace = np.einsum("ikjl,kl->ij", state["ci"], ww)
        slopes.append(-0.5 * (n * si - si @ (trace + state["ee"]) @ si))
        columns, slope = [], []
        for k, chart in enumerate(charts):
            for dot in chart.directions():
                slope.append(float(np.sum(slopes[k] * dot)))
                if k < len(blocks):
                    d = np.zeros((c, t))
                    d[blocks[k]] = pulls[k] @ dot
                    columns.append(("w", d, ww @ d @ si))
                else:
                    columns.append(("e", dot, gap @ si @ dot @ si))
        size_ = len(columns)
        info = np.zeros((size_, size_))
        right = np.array([w.T.ravel() for _, _, w in columns])
        taken = right @ state["flat"] @ right.T
        for a in range(size_):
            for b in range(a, size_):
                (ka, da, wa), (kb, db, wb) = columns[a], columns[b]
                if ka == kb == "e":
                    inner = float(np.sum((si @ da @ si @ db @ si) * state["ee"]))
                else:
                    inner = float(np.sum(da * wb)) if ka == "w" else float(np.sum(db * wa))
                info[a, b] = info[b, a] = 0.5 * (inner - taken[a, b])
        at = 0
        for k, chart in enumerate(charts):
            width = len(chart.places)
            info[at : at + width, at : at + width] += chart.bend(slopes[k])
            at += width
        step = ascend(np.array(slope), info, scale)
        longest, found = float(np.abs(step).max()), None
        size, gain = min(1.0, 3.0 / longest) if longest > 3 else 1.0, float(np.array(slope) * scale @ step)
        slack = 1e-9 if longest < 1e-2 else 1e-13  # near the top, rounding hides what a step gains
        while size > 1e-9:
            move, at, values = size * step * scale, 0, []
            for chart in charts:
                values.append(chart.moved(move[at : at + len(chart.places)]))
                at += len(chart.places)
            candidate = solve([x.factor(v) for x, v in zip(charts, values, strict=True)])
            if candidate is not None and candidate["loglik"] >= state["loglik"] - slack * (1 + abs(state["loglik"])):
                found = values, candidate
                break
            size /= 4
        if found is None:  # no step goes up: at the top but for rounding, or stuck
            converged = gain < 1e-6
            break
        for chart, value in zip(charts, found[0], strict=True):
            chart.value = value
        state = found[1]
        quiet = quiet + 1 if gain < 1e-13 * (1 + abs(state["loglik"])) else 0
        if longest < tol or quiet == 3:
            converged = True
            break
    theta, residual = [x.covariance(x.value) for x in charts[:-1]], charts[-1].covariance(charts[-1].value)
    for th in theta:
        small = np.diag(th) < 1e-12 * np.diag(vy)
        th[small] = 0.0
        th[:, small] = 0.0
    solution = np.zeros((design.width, t))
    solution[common], solution[use] = back(state["b"])
    return theta, residual, state["loglik"], converged, cycle, solution


def fit_pairs(df: DataFrame, traits: Sequence[str], fixed: str = "1", random: str | None = None, kernels: dict | None = None, covariances: dict | None = None, iterations: int = 200, tol: float = 1e-8) -> dict[tuple[str, str], MultiFit]:
    """All two-trait models, each from the records that have both, after one pass over the records.

    Records are told apart by which traits they have; of each such pattern the cross-products of the design and all traits
    are kept, and a pair adds up those of the patterns that have both. The fits are Spark tasks that slice these sums,
    which are broadcast (256 MB at most, checked).
    """
    traits = list(traits)
    if len(set(traits)) < max(len(traits), 2):
        raise ValueError("two or more different traits")
    fixed_terms, intercept = parse_terms(fixed)
    terms = parse_terms(random)[0] if random else ()
    there = [F.col(t).isNotNull() for t in traits]
    rows = df.filter(sum((x.cast("int") for x in there), F.lit(0)) >= 2).withColumn("_pattern", F.concat(*(F.when(x, "1").otherwise("0") for x in there)))
    design = build_design(rows.withColumn("_zero", F.lit(0.0)), "_zero", fixed_terms, intercept, terms, "_pattern", kernels=kernels, covariances=covariances)
    c, k = design.width, len(traits)
    if 8 * len(design.levels) * (c + k + 1) ** 2 > 256 << 20:
        raise ValueError(f"{len(design.levels)} patterns of {c + k} columns; their cross-products are too large to broadcast")
    ys = [F.struct(F.lit(c + i).cast("int").alias("i"), F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias("v")) for i, t in enumerate(traits)]
    wide = design.rows.withColumn("_entries", F.concat("_entries", F.array(*ys)))
    gram = gram_of(type("Grown", (), {"width": c + k, "rows": wide, "numeric": True, "levels": design.levels})())
    spark, blocks = df.sparkSession, SimpleNamespace(fixed=design.fixed, random=design.random, width=c)
    shared = spark.sparkContext.broadcast((gram.sums, gram.records, blocks))
    at = [(i, j) for i in range(k) for j in range(i + 1, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, records, own = shared.value
        for batch in batches:
            for i, j in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
                use = [p for p in sums if p[i] == p[j] == "1"]
                total, n = sum((sums[p] for p in use), np.zeros((c + k + 1, c + k + 1))), sum(records[p] for p in use)
                y = [c + i, c + j]
                found = _maximise(own, total[:c, :c], total[:c][:, y], total[np.ix_(y, y)], n, [(None, None)] * (len(own.random) + 1), {}, iterations, tol)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], names=["i", "j", "fit"])

    pairs = spark.createDataFrame(at, "i int, j int").repartition(len(at), "i", "j")
    out = {}
    for r in pairs.mapInArrow(run, "i int, j int, fit binary").collect():
        found = pickle.loads(r["fit"])
        if not found[3]:
            warnings.warn(f"the fit of {traits[r['i']]} and {traits[r['j']]} has not converged in {found[4]} iterations", stacklevel=2)
        out[traits[r["i"]], traits[r["j"]]] = MultiFit(spark, [traits[r["i"]], traits[r["j"]]], design, *found)
    return {(traits[i], traits[j]): out[traits[i], traits[j]] for i, j in at}


def merged_pairs(fits: dict[tuple[str, str], MultiFit]) -> DataFrame:
    """(term, trait1, trait2, covariance) of all traits from the models of pairs, as one positive matrix for each term.

    A trait's variance is the mean over its pairs; the nearest positive definite matrix is taken where these don't fit together.
    """
    traits = list(dict.fromkeys(x for pair in fits for x in pair))
    one = next(iter(fits.values()))
    labels, rows = [*(t.label for t in one.design.random), "units"], []
    for n, label in enumerate(labels):
        m, seen = np.zeros((len(traits), len(traits))), np.zeros(len(traits))
        for (a, b), fit in fits.items():
            v, i, j = (fit.theta[n] if n < len(fit.theta) else fit.residual), traits.index(a), traits.index(b)
            m[i, j] = m[j, i] = v[0, 1]
            m[i, i] += v[0, 0]
            m[j, j] += v[1, 1]
            seen[[i, j]] += 1
        m[np.diag_indices(len(traits))] /= np.maximum(seen, 1)
        scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
        if np.linalg.eigvalsh(m / np.outer(scale, scale))[0] <= 0:
            m = nearest_pd(m / np.outer(scale, scale)) * np.outer(scale, scale)
        rows += [(label, a, b, float(m[i, j])) for j, b in enumerate(traits) for i, a in enumerate(traits[: j + 1])]
    return one.spark.createDataFrame(rows, "term string, trait1 string, trait2 string, covariance double")
