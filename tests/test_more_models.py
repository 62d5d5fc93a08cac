"""Structures, solvers on arrays, constraints of traits, kernels beyond the driver's, and spatial terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agromix.operators import matrices, ranking, records, spatial
from agromix.plans import arrays, design
from agromix.plans.model import mmec, mmer
from agromix.plans.structures import fcm, unsm


@pytest.fixture(scope="module")
def plots():
    rng = np.random.default_rng(8)
    u = rng.normal(size=(25, 2)) @ np.linalg.cholesky(np.array([[3.0, 1.0], [1.0, 2.0]])).T
    return [(f"g{i:02d}", f"e{e}", f"g{(i * 7 + e) % 25:02d}", float(5 + e + u[i, 0] + rng.normal()), float(1 + u[i, 1] + rng.normal() * 0.7), float(rng.normal())) for i in range(25) for e in range(3) for _ in range(1 + (i + e) % 3)]


@pytest.fixture(scope="module")
def table(spark, plots):
    return spark.createDataFrame(plots, "g string, env string, h string, y double, z double, x double")


def incidence(values):
    levels = sorted(set(values))
    return np.array([[float(v == x) for x in levels] for v in values])


def test_solvers_on_arrays(table, plots):
    model = mmec(table, "y ~ env", "~ g")
    y, z = np.array([r[3] for r in plots]), incidence([r[0] for r in plots])
    x = np.column_stack([np.ones(len(y)), incidence([r[1] for r in plots])[:, 1:]])
    for found, rel in ((arrays.ai(y, x, [{"Z": z}]), 1e-6), (arrays.em(y, x, [{"Z": z, "K": np.eye(25)}]), 1e-3)):
        assert (found.variances[0], found.residual) == pytest.approx(tuple(v for _, v in model.components()), rel=rel)
        assert found.effects[0] == pytest.approx(model.fit.solution[3:], rel=10 * rel, abs=1e-4)
    held = arrays.em(y, x, [{"Z": z}], forced=[2.0, 1.5])
    assert (held.variances, held.residual) == ([2.0], 1.5)
    one, two = np.diag(np.full(len(y), 2.0)), arrays.ai(y, x, [{"Z": z}])
    weighed = arrays.ai(y, x, [{"Z": z}], weights=one)
    assert weighed.residual == pytest.approx(2 * two.residual, rel=1e-6) and weighed.variances == pytest.approx(two.variances, rel=1e-6)


def test_several_traits_by_diagonal_form(plots):
    y, z = np.array([[r[3], r[4]] for r in plots]), incidence([r[0] for r in plots])
    found = arrays.memma(y, None, z)
    v = np.kron(z @ z.T, found["Vu"]) + np.kron(np.eye(len(y)), found["Ve"])
    x = np.kron(np.ones((len(y), 1)), np.eye(2))

    def loglik(v):
        vi = np.linalg.inv(v)
        b = np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y.ravel())
        r = y.ravel() - x @ b
        return -0.5 * (np.linalg.slogdet(v)[1] + r @ vi @ r)

    best = loglik(v)
    assert best == pytest.approx(float(found["loglik"]), rel=1e-8)
    for k in range(2):
        for s in (0.9, 1.1):
            d = np.ones(2)
            d[k] = s
            assert loglik(np.kron(z @ z.T, found["Vu"] * np.outer(d, d)) + np.kron(np.eye(len(y)), found["Ve"])) < best + 1e-6
    expected = np.kron(z.T, found["Vu"]) @ np.linalg.inv(v) @ (y - found["beta"][0]).ravel()
    assert found["u"].ravel() == pytest.approx(expected, abs=1e-5)


def test_constraints_of_traits(spark, table):
    whole = mmer(table, "cbind(y, z) ~ env", "~ g")
    same = mmer(table, "cbind(y, z) ~ vsr(env, Gtc=F)", "~ vsr(g, Gti=A, Gtc=C)", covariances={"F": fcm([1, 1]), "A": np.array([[1.0, 0.2], [0.2, 1.0]]), "C": unsm(2)})
    assert same.theta[0] == pytest.approx(whole.theta[0], rel=1e-4) and same.loglik == pytest.approx(whole.loglik, rel=1e-8)
    apart = mmer(table, "cbind(y, z) ~ env", "~ vsr(g, Gtc=D)", covariances={"D": np.eye(2, dtype=int)}, residual={"Gtc": np.eye(2, dtype=int)})
    for k, trait in enumerate(("y", "z")):
        alone = dict(mmec(table, f"{trait} ~ env", "~ g").components())
        assert apart.theta[0][k, k] == pytest.approx(alone["g"], rel=1e-5) and apart.residual[k, k] == pytest.approx(alone["residual.units"], rel=1e-5)
    assert apart.theta[0][0, 1] == apart.residual[0, 1] == 0
    held = mmer(table, "cbind(y, z) ~ env", "~ vsr(g, Gti=A, Gtc=H)", covariances={"A": np.array([[2.0, 0.5], [0.5, 1.0]]), "H": np.full((2, 2), 3)})
    assert held.theta[0] == pytest.approx(np.array([[2.0, 0.5], [0.5, 1.0]])) and held.loglik <= whole.loglik
    one = mmer(table, "cbind(y, z) ~ vsr(env, Gtc=F)", "~ vsr(g, Gtc=D)", covariances={"F": fcm([1, 0]), "D": np.eye(2, dtype=int)}, residual={"Gtc": np.eye(2, dtype=int)})
    assert one.theta[0][1, 1] == pytest.approx(dict(mmec(table, "z ~ 1", "~ g").components())["g"], rel=1e-5)


def test_levels_left_without_variance(table):
    some = mmec(table, "y ~ env", "~ vsc(atr(env, e0, e1), isc(g))")
    other = mmec(table, "y ~ env", "~ vsc(atc(env, e0, e1), isc(g))")
    assert some.fit.loglik == pytest.approx(other.fit.loglik, rel=1e-9)
    assert some.fit.theta[0].shape == (3, 3) and other.fit.theta[0].shape == (2, 2)
    assert np.diag(some.fit.theta[0])[:2] == pytest.approx(np.diag(other.fit.theta[0]), rel=1e-5, abs=1e-8) and some.fit.theta[0][2, 2] == 0


def test_several_effects_with_one_covariance(table):
    pair, joined = mmec(table, "y ~ env", "~ covc(vsc(isc(g)), vsc(isc(h)))"), mmec(table, "y ~ env", "~ gvsr(g, h)")
    assert joined.fit.loglik == pytest.approx(pair.fit.loglik, rel=1e-9)
    apart = mmec(table, "y ~ env", "~ gvsr(g, h, Guc=D)", covariances={"D": np.eye(2, dtype=int)})
    assert apart.fit.loglik == pytest.approx(mmec(table, "y ~ env", "~ g + h").fit.loglik, rel=1e-8)


def test_fixed_effect_among_the_random(table):
    one, other = mmec(table, "y ~ 1", "~ g + vsc(isc(env), isFixed=TRUE)"), mmec(table, "y ~ env", "~ g")
    assert dict(one.components()) == pytest.approx(dict(other.components()), rel=1e-6)


def test_legendre_arguments(table):
    base, moved = mmec(table, "y ~ leg(x, 2)"), mmec(table, "y ~ 0 + leg(x, 2, u=0, v=2, intercept=TRUE)")
    assert base.fit.ypy == pytest.approx(moved.fit.ypy, rel=1e-6) or len(base.design.fixed[1].names) == 3
    assert mmec(table, "y ~ leg(x, 2, intercept=FALSE)").design.fixed[1].names == ["leg1", "leg2"]


def test_kernels_beyond_the_driver(spark, table, monkeypatch):
    rng = np.random.default_rng(2)
    names = sorted({r["g"] for r in table.select("g").collect()}) + [f"new{i}" for i in range(15)]
    w = rng.normal(size=(40, 200))
    k = w @ w.T / 200 + 0.01 * np.eye(40)
    kernel = matrices.from_dense(spark, names, k)
    whole = mmec(table, "y ~ env", "~ vsc(isc(g), Gu=K)", kernels={"K": kernel})
    monkeypatch.setattr(design, "MAX_ORDER", 30)
    cut = mmec(table, "y ~ env", "~ vsc(isc(g), Gu=K)", kernels={"K": kernel})
    assert len(cut.design.random[0].main) == 25 and len(whole.design.random[0].main) == 40
    assert dict(cut.components()) == pytest.approx(dict(whole.components()), rel=1e-5) and cut.fit.loglik == pytest.approx(whole.fit.loglik, rel=1e-8)
    expected = {r["level"]: r["blup"] for r in whole.blups().collect()}
    assert {r["level"]: r["blup"] for r in cut.extended_blups("g", kernel).collect()} == pytest.approx(expected, abs=1e-4)


def test_spatial_variants(spark):
    rng = np.random.default_rng(4)
    grid = spark.createDataFrame([(float(i), float(j), float(np.sin(i / 2) + j / 5 + rng.normal() * 0.2)) for i in range(9) for j in range(8)], "r double, c double, y double")
    made = spatial.tps(grid, "c", "r", (4, 4), nest=(2, 2))
    row = made.first()
    assert len(row["All"]) == sum(len(row[x]) for x in ("base", "fC", "fR", "fC_R", "C_fR", "fC_fR"))
    assert len(row["fC_fR"]) < len(spatial.tps(grid, "c", "r", (4, 4)).first()["fC_fR"])
    assert mmec(made, "y ~ 1", "~ vsc(isc(basis(All)))").fit.converged
    lee, wood = (spatial.spatial_design(grid, "c", "r", (4, 4), method=m).first()["fC_fR"] for m in ("lee", "wood"))
    a, b = spatial.margin(0, 7, 4), spatial.margin(0, 8, 4)
    assert np.array(lee) == pytest.approx(np.array(wood) * np.sqrt(np.outer(a.values, b.values) / np.add.outer(a.values, b.values)).ravel())
    with pytest.raises(ValueError, match="wood or lee"):
        spatial.spatial_design(grid, "c", "r", method="other")


def test_peak_clusters_and_q_values(spark):
    rows = [(c, p, 10.0 if p in (5, 8, 60, 64) else 1.0 + (p % 2) * 0.1) for c in ("a", "b") for p in range(1, 80)]
    found = ranking.peak_clusters(spark.createDataFrame(rows, "chrom string, pos int, score double"), "chrom", "pos", "score", 5, 4).collect()
    assert sorted((r["chrom"], r["pos"], r["n"]) for r in found) == [("a", 5, 2), ("a", 60, 2), ("b", 5, 2), ("b", 60, 2)]
    low = spark.createDataFrame([(i, (i + 1) / 101) for i in range(100)], "i int, p double")
    assert ranking.fdr_or_q(low, "p").first()["method"] == "q"
    high = spark.createDataFrame([(i, 1e-8 if i < 5 else (i + 1) / 101) for i in range(100)], "i int, p double")
    assert ranking.fdr_or_q(high, "p").first()["method"] == "BH"
    p = np.array([r["p"] for r in high.collect()])
    lambdas = [i / 20 for i in range(19)]
    pi0 = min(1.0, np.polyval(np.polyfit(lambdas, [(p >= x).mean() / (1 - x) for x in lambdas], 3), lambdas[-1]))
    assert {r["i"]: r["q"] for r in ranking.storey_q(high, "p").collect()}[0] == pytest.approx(pi0 * 1e-8 * 100 / 5, rel=1e-6)


def test_level_fill_and_long_medians(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("b", "y", 5.0), ("c", "y", 9.0)], "r string, c string, v double")
    similar = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -0.25), ("b", "a", 0.5), ("c", "b", 0.0), ("a", "a", 1.0)], "row string, col string, value double")
    got = {(r["r"], r["c"]): r["filled"] for r in records.level_fill(rows, "r", "c", "v", similar).collect()}
    assert got == {("a", "x"): 1.0, ("b", "x"): 3.0, ("b", "y"): 5.0, ("c", "y"): 9.0, ("a", "y"): pytest.approx((0.5 * 5 - 0.25 * 9) / 0.75), ("c", "x"): None}
    for n in (1001, 1000):
        many = spark.range(n).select(F.when(F.col("id") % 10 < 4, F.lit(7.0)).otherwise((F.col("id") * 37 % 1009).cast("double")).alias("v"))
        assert records.median_of(many, ["v"], {"v": n}, few=10)["v"] == many.agg(F.median("v")).first()[0]
