import numpy as np
import pytest

from agromix.plans.model import mmec
from agromix.plans.multitrait import fit_traits


@pytest.fixture(scope="module")
def trial(spark):
    rng = np.random.default_rng(11)
    u = rng.normal(size=(40, 2)) @ np.linalg.cholesky(np.array([[3, 1.5], [1.5, 2.0]])).T
    e = np.linalg.cholesky(np.array([[1, 0.4], [0.4, 1.5]]))
    rows = []
    for i in range(40):
        for k in range(2 + i % 5):
            y = u[i] + e @ rng.normal(size=2) + [5, 8]
            rows.append((f"g{i:02d}", f"b{k}", float(y[0]), float(y[1])))
    return spark.createDataFrame(rows, "g string, b string, y1 double, y2 double")


def test_two_traits_are_at_a_maximum_of_the_full_likelihood(trial):
    fit = fit_traits(trial, "cbind(y1, y2) ~ b", "~ g")
    assert fit.converged
    pdf = trial.toPandas()
    levels = sorted(pdf.b.unique())
    x = np.column_stack([np.ones(len(pdf)), *(pdf.b == v for v in levels[1:])]).astype(float)
    z = np.array([[float(g == f"g{i:02d}") for i in range(40)] for g in pdf.g])
    y = np.concatenate([pdf.y1, pdf.y2])

    def at(theta, residual):
        v = np.kron(theta, z @ z.T) + np.kron(residual, np.eye(len(pdf)))
        xx = np.kron(np.eye(2), x)
        vi = np.linalg.inv(v)
        xvx = xx.T @ vi @ xx
        p = vi - vi @ xx @ np.linalg.solve(xvx, xx.T @ vi)
        return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + y @ p @ y)

    top = at(fit.theta[0], fit.residual)
    assert fit.loglik == pytest.approx(top, abs=1e-6)
    for i, j in ((0, 0), (0, 1), (1, 1)):
        move = np.zeros((2, 2))
        move[i, j] = move[j, i] = 0.03
        assert max(at(fit.theta[0] + move, fit.residual), at(fit.theta[0] - move, fit.residual), at(fit.theta[0], fit.residual + move), at(fit.theta[0], fit.residual - move)) < top
    assert fit.effects().count() == 2 * fit.design.width


def test_one_trait_equals_the_univariate_fit(trial):
    a, b = fit_traits(trial, "cbind(y1) ~ 1", "~ g"), mmec(trial, "y1 ~ 1", "~ g")
    assert a.theta[0][0, 0] == pytest.approx(b.fit.theta[0][0, 0], rel=1e-4)
    assert a.residual[0, 0] == pytest.approx(b.fit.residual["units"], rel=1e-4)


def test_pairs_from_one_pass_equal_models_of_their_own(spark, trial):
    from pyspark.sql import functions as F

    from agromix.plans.model import mmer_pairs
    from agromix.plans.multitrait import fit_pairs, merged_pairs

    rows = trial.select("*", (F.col("y1") - 0.5 * F.col("y2") + F.hash("g", "b") / 2.0e9).alias("y3"))
    # records that lack a trait enter the pairs without it
    rows = rows.withColumn("y3", F.when(F.col("b") != "b4", F.col("y3"))).withColumn("y1", F.when(F.pmod(F.hash("g", "b"), F.lit(9)) != 0, F.col("y1")))
    found = mmer_pairs(rows, ["y1", "y2", "y3"], "b", "~ g")
    assert list(found) == [("y1", "y2"), ("y1", "y3"), ("y2", "y3")]
    for (a, b), fit in found.items():
        own = fit_traits(rows, f"cbind({a}, {b}) ~ b", "~ g")
        assert fit.converged and fit.loglik == pytest.approx(own.loglik, abs=1e-5)
        assert np.allclose(fit.theta[0], own.theta[0], rtol=1e-3, atol=1e-4) and np.allclose(fit.residual, own.residual, rtol=1e-3, atol=1e-4)
    joined = {(r["term"], r["trait1"], r["trait2"]): r["covariance"] for r in merged_pairs(found).collect()}
    for term in ("g", "units"):
        m = np.array([[joined[(term, *sorted((a, b)))] for b in ("y1", "y2", "y3")] for a in ("y1", "y2", "y3")])
        assert np.linalg.eigvalsh(m)[0] > -1e-9 and m[0, 0] == pytest.approx((found["y1", "y2"].theta[0] if term == "g" else found["y1", "y2"].residual)[0, 0], rel=0.3)
    with pytest.raises(ValueError, match="different traits"):
        fit_pairs(rows, ["y1", "y1"])


def test_many_records_of_two_traits_converge():
    """Cross-products as of millions of records whose traits vary little within places: the closed form of a balanced layout, to all digits."""
    from types import SimpleNamespace

    from agromix.plans.design import Block, RandomTerm
    from agromix.plans.multitrait import _maximise

    q, place = 64, np.arange(1, 65)
    term = RandomTerm("place", 1, [str(i) for i in place], ("place",), [""], [str(i) for i in place])
    design = SimpleNamespace(fixed=[Block("(Intercept)", 0, ["(Intercept)"])], random=[term], width=1 + q)
    for n in (2000, 120_000, 720_000):
        rng = np.random.default_rng(n)
        factor = np.diag([0.022, 0.075]) @ np.linalg.cholesky(np.array([[1, 0.9], [0.9, 1]]))
        means = np.stack([0.02 * (place * 7 % 64), 0.03 * (place * 5 % 64)], 1) + rng.normal(size=(q, 2)) @ factor.T / np.sqrt(n)
        x = np.hstack([np.ones((q, 1)), np.eye(q)])
        ww, wy, yy = n * x.T @ x, n * x.T @ means, n * means.T @ means + q * (n - 1) * factor @ factor.T
        theta, residual, _, converged, _, solution = _maximise(design, ww, wy, yy, q * n, [(None, None)] * 2, {}, 200, 1e-8)
        assert converged and np.allclose(residual, factor @ factor.T, rtol=1e-9, atol=0)
        assert np.allclose(theta[0], np.cov(means.T) - residual / n, rtol=1e-9, atol=0)
        assert np.allclose(solution[0], means.mean(axis=0)) and np.allclose(solution[0] + solution[1:], means, atol=1e-3)
