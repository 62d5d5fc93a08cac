"""Closed forms, equivalent models, and invariances."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from agromix.operators import kernels, markers, matrices, ranking, records, scan
from agromix.plans.design import Block, Design, Gram, RandomTerm
from agromix.plans.model import absorbed, lrt, mmec, mmer, two_stage, vpredict
from agromix.plans.reml import fit_reml


@pytest.fixture(scope="module")
def trial(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(size=(20, 3)) @ np.linalg.cholesky(np.array([[4, 2, 1], [2, 3, 1], [1, 1, 2.0]])).T
    rows = [(f"g{i:02d}", f"e{e}", k, float(rng.normal()), float(10 + e + u[i, e] + rng.normal()), float(rng.uniform(0.5, 2))) for i in range(20) for e in range(3) for k in range(1 + (i + e) % 4)]
    return spark.createDataFrame(rows, "g string, env string, rep int, x double, y double, w double").repartition(5)


def values(model):
    return dict(model.components())


def dense_reml(pdf, x, z_blocks, theta, residual):
    """REML log-likelihood by the full covariance of the records."""
    v = np.diag(residual) + sum(z @ t @ z.T for z, t in zip(z_blocks, theta, strict=True))
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    p = vi - vi @ x @ np.linalg.solve(xvx, x.T @ vi)
    y = pdf["y"].to_numpy()
    return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + y @ p @ y)


def test_likelihood_and_gradient_of_an_unbalanced_fit(trial):
    model = mmec(trial, "y ~ env + x", "~ g", "~ vsc(dsc(env), isc(units))")
    assert model.fit.converged and np.abs(model.fit.score).max() < 1e-4
    pdf = trial.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.env == "e1", pdf.env == "e2", pdf.x]).astype(float)
    z = np.array([[float(g == f"g{i:02d}") for i in range(20)] for g in pdf.g])
    su, left = float(model.fit.theta[0][0, 0]), {k: float(v) for k, v in model.fit.residual.items()}
    at = lambda s, r: dense_reml(pdf, x, [z], [s * np.eye(20)], pdf.env.map(r).to_numpy())
    top = at(su, left)
    assert model.fit.loglik == pytest.approx(top, abs=1e-6)
    for factor in (0.97, 1.03):
        assert at(su * factor, left) < top
        for e in left:
            assert at(su, left | {e: left[e] * factor}) < top


def test_unstructured_beats_diagonal_and_is_a_maximum(trial):
    us = mmec(trial, "y ~ env", "~ vsc(usc(env), isc(g))")
    ds = mmec(trial, "y ~ env", "~ vsc(dsc(env), isc(g))")
    assert us.fit.converged and ds.fit.converged and us.fit.loglik > ds.fit.loglik
    found = lrt(us, ds)
    assert found["df"] == 3 and 0 <= found["p_value"] <= 1
    pdf = trial.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.env == "e1", pdf.env == "e2"]).astype(float)
    z = np.array([[float(e == f"e{k}" and g == f"g{i:02d}") for k in range(3) for i in range(20)] for g, e in zip(pdf.g, pdf.env, strict=True)])
    theta, left = us.fit.theta[0], float(us.fit.residual["units"])
    at = lambda t: dense_reml(pdf, x, [z], [np.kron(t, np.eye(20))], np.full(len(pdf), left))
    assert us.fit.loglik == pytest.approx(at(theta), abs=1e-6)
    for i in range(3):
        for j in range(i + 1):
            move = np.zeros((3, 3))
            move[i, j] = move[j, i] = 0.02
            assert at(theta + move) < at(theta) > at(theta - move)


def test_em_agrees_with_average_information(trial):
    a, b = mmec(trial, "y ~ env", "~ g"), mmec(trial, "y ~ env", "~ g", em_only=True, iterations=3000)
    assert values(a)["g"] == pytest.approx(values(b)["g"], rel=1e-3)


def test_partitions_and_scale_do_not_matter(trial):
    a, b = mmec(trial, "y ~ env", "~ g"), mmec(trial.repartition(1).withColumn("y", F.col("y") * 10), "y ~ env", "~ g")
    assert values(b)["g"] == pytest.approx(100 * values(a)["g"], rel=1e-6)


def test_weights_equal_replicates(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 6}", float(rng.normal() + i % 6), 1 + i % 3) for i in range(60)]
    once = spark.createDataFrame(rows, "g string, y double, w int")
    often = once.select("g", "y", F.explode(F.sequence(F.lit(1), "w")).alias("k"))
    known = {"theta": {"g": [[1.0]]}, "codes": {"g": [[3]]}, "residual": {"units": 2.0}, "fixed_residual": True}
    a = mmec(once, "y ~ 1", "~ g", weights="w", **known).blups().orderBy("level").collect()
    b = mmec(often, "y ~ 1", "~ g", **known).blups().orderBy("level").collect()
    assert [r["blup"] for r in a] == pytest.approx([r["blup"] for r in b])


def test_main_effects_and_interaction_in_two_notations(trial):
    a = mmec(trial, "y ~ env*g").predict("env").orderBy("level").collect()
    b = mmec(trial, "y ~ env + g + env:g").predict("env").orderBy("level").collect()
    assert [r["predicted"] for r in a] == pytest.approx([r["predicted"] for r in b])
    assert [r["std_error"] for r in a] == pytest.approx([r["std_error"] for r in b])


def test_marker_effects_equal_a_kernel_model(spark):
    rng = np.random.default_rng(2)
    m = rng.integers(-1, 2, size=(25, 60)).astype(float)
    y = m @ rng.normal(size=60) * 0.3 + rng.normal(size=25)
    rows = spark.createDataFrame([(f"i{i:02d}", float(y[i]), k) for i in range(25) for k in range(2)], "id string, y double, k int").withColumn("y", F.col("y") + F.col("k") * 0.1)
    kernel = matrices.from_dense(spark, [f"i{i:02d}" for i in range(25)], m @ m.T / 60)
    with_kernel = mmec(rows, "y ~ 1", "~ vsc(isc(id), Gu=K)", kernels={"K": kernel})
    loads = ([f"i{i:02d}" for i in range(25)], m / np.sqrt(60))
    with_markers = mmec(rows, "y ~ 1", "~ vsc(isc(redmm(id, M)))", covariances={"M": loads})
    assert values(with_kernel)["residual.units"] == pytest.approx(values(with_markers)["residual.units"], rel=1e-3)
    u = np.array([r["blup"] for r in with_kernel.blups().orderBy("level").collect()])
    effects = np.array([r["blup"] for r in with_markers.blups().collect()])
    assert u == pytest.approx(m / np.sqrt(60) @ effects, abs=1e-3)


def test_scan_equals_refits_at_the_same_components(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(-1, 2, size=(30, 8))
    y = m[:, 0] * 1.0 + rng.normal(size=30)
    rows = spark.createDataFrame([(f"i{i:02d}", float(y[i] + 0.3 * k), k) for i in range(30) for k in range(2)], "id string, y double, k int")
    cells = spark.createDataFrame([(f"i{i:02d}", f"m{j}", int(m[i, j])) for i in range(30) for j in range(8)], "id string, marker string, dosage int")
    model = mmec(rows, "y ~ 1", "~ id")
    got = {r["marker"]: r for r in scan.scan_markers(model, "id", cells).collect()}
    theta, left = model.fit.theta[0], {"units": float(model.fit.residual["units"])}
    for j in range(8):
        one = rows.join(cells.filter(F.col("marker") == f"m{j}").select("id", F.col("dosage").cast("double").alias("d")), "id")
        refit = mmec(one, "y ~ d", "~ id", theta={"id": theta}, codes={"id": [[3]]}, residual=left, fixed_residual=True).blues().filter("term = 'd'").first()
        assert got[f"m{j}"]["effect"] == pytest.approx(refit["estimate"])
    assert got["m0"]["score"] == max(r["score"] for r in got.values())


def test_more_model_forms(trial, spark):
    assert mmec(trial, "y ~ env").fit.converged
    assert mmec(trial, "y ~ env", "~ vsc(atc(env, e1, e2), isc(g))", iterations=30).design.random[0].size == 40
    assert mmec(trial, "y ~ env", "~ vsc(usc(leg(rep, 1)), isc(g))", iterations=30).design.random[0].size == 40
    custom = mmec(trial, "y ~ env", "~ vsc(csc(env, mm), isc(g))", covariances={"mm": np.array([[1, 2, 0], [2, 1, 0], [0, 0, 1]])}, iterations=30)
    assert custom.fit.theta[0][0, 2] == 0 and custom.fit.theta[0][0, 1] != 0
    both = spark.createDataFrame([(f"p{i % 5}", f"p{(i * 3 + 1) % 5}", float(i % 7)) for i in range(70)], "a string, b string, y double")
    assert mmec(both, "y ~ 1", "~ overlay(a, b)", iterations=30).design.random[0].size == 5
    assert mmec(both, "y ~ 1", "~ covc(vsc(isc(a)), vsc(isc(b)))", iterations=30).fit.theta[0].shape == (2, 2)
    assert len(mmer(trial, "cbind(y, x) ~ 1", "~ g", stacked=True, iterations=20).components()) == 5
    assert mmer(trial, "cbind(y, x) ~ 1", "~ g", iterations=20).summary().count() == 6
    assert two_stage(trial, "y", "g", "env").fit.converged
    value, se = vpredict(mmec(trial, "y ~ env", "~ g"), "V1/(V1+V2)")
    assert 0 < value < 1 and se > 0
    with pytest.raises(ValueError):
        mmec(trial, "nothing ~ 1")
    with pytest.raises(ValueError):
        mmec(trial, "y ~ missing_column")


def test_imputation_and_policies(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (5.0, None), (3.0, "b")], "y double, k string")
    assert records.impute(df, ["y", "k"]).orderBy("y").collect()[1]["y"] == 3.0
    assert records.impute(df, ["y"], "mean").filter("y = 3.0").count() == 2
    assert records.na_policy(df, ["y"], ["k"]).count() == 2
    with pytest.raises(ValueError):
        records.impute(df, ["y"], "mode")


def test_single_step_kernel(spark):
    a = np.array([[1, 0.5, 0.5, 0], [0.5, 1, 0.25, 0], [0.5, 0.25, 1, 0], [0, 0, 0, 1.0]])
    names = ["a", "b", "c", "d"]
    same = kernels.h_matrix(matrices.from_dense(spark, names, a), matrices.from_dense(spark, ["b", "c"], a[1:3, 1:3]))
    assert np.allclose(matrices.dense(same)[1], a)
    other = kernels.h_matrix(matrices.from_dense(spark, names, a), matrices.from_dense(spark, ["b", "c"], np.array([[1.1, 0.4], [0.4, 0.9]])))
    assert np.allclose(matrices.dense(other)[1][1:3, 1:3], [[1.1, 0.4], [0.4, 0.9]])
    inverse = matrices.inverse_triplet(matrices.from_dense(spark, names, a), 0.0)
    assert np.allclose(matrices.dense(inverse)[1] @ a, np.eye(4))


def test_hybrids_refuse_other_codes(spark):
    odd = spark.createDataFrame([("a", "m", -1), ("b", "m", 2), ("c", "m", 1)], "id string, marker string, dosage int")
    with pytest.raises(ValueError):
        markers.build_hybrids(odd, odd)


def test_fdr_against_a_direct_computation(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(size=300) ** 3, 3) + 1e-6
    got = ranking.bh_fdr(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double"), "p")
    order = np.argsort(-p)
    adjusted = np.minimum.accumulate(np.minimum(1, p[order] * 300 / (300 - np.arange(300))))
    expected = dict(zip(order.tolist(), adjusted, strict=True))
    for r in got.collect():
        assert r["p_adjusted"] == pytest.approx(expected[r["i"]])
    assert ranking.fdr_threshold(got, "p").first()["threshold"] is not None


def test_levels_that_hold_colons(spark):
    rows = spark.createDataFrame([("a:b", "c", 1.0), ("a:b", "c", 3.0), ("a", "b:c", 10.0), ("a", "b:c", 12.0), ("x\\", "y", 5.0), ("x\\", "y", 5.5)], "f string, g string, y double")
    model = mmec(rows, "y ~ 0 + f:g")
    got = {r["level"]: r["predicted"] for r in model.predict("f:g").collect()}
    assert {k: got[k] for k in ("a\\:b:c", "a:b\\:c", "x\\\\:y")} == pytest.approx({"a\\:b:c": 2.0, "a:b\\:c": 11.0, "x\\\\:y": 5.25})
    assert sorted(r["estimate"] for r in model.blues().collect()) == pytest.approx([2.0, 5.25, 11.0])


def test_residual_levels_are_checked(spark):
    rows = spark.createDataFrame([(float(i % 7), None if i == 3 else "ab"[i % 2]) for i in range(30)], "y double, g string")
    assert sum(mmec(rows, "y ~ 1", None, "~ vsc(dsc(g), isc(units))").gram.records.values()) == 29


def test_perfect_fit_ends_at_the_floor(spark):
    rows = spark.createDataFrame([(float(2 * i + 1), float(i), f"g{i % 5}") for i in range(40)], "y double, x double, g string")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fit = mmec(rows, "y ~ x", "~ g").fit
    assert "residual.units" in fit.boundary or fit.residual["units"] < 1e-9
    assert np.isfinite(fit.loglik)


def test_cross_products_by_blocks_equal_plain_sums(spark, monkeypatch):
    from agromix.plans import design

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(rng.normal()), float(rng.normal()), f"g{rng.integers(6)}", "ab"[int(rng.integers(2))], float(rng.uniform(0.5, 2))) for _ in range(300)], "y double, x double, g string, l string, w double")
    fit = lambda: mmec(rows, "y ~ x", "~ g + g:x", "~ vsc(dsc(l), isc(units))", weights="w").gram
    one = fit()
    monkeypatch.setattr(design, "DENSE", 0)
    other = fit()
    for level in ("a", "b"):
        assert np.allclose(one.sums[level], other.sums[level]) and one.records[level] == other.records[level]
    plain = mmec(rows, "y ~ x", weights="w").gram
    monkeypatch.setattr(design, "PLAIN", 0)
    assert np.allclose(plain.sums["units"], mmec(rows, "y ~ x", weights="w").gram.sums["units"])
    total = sum(one.sums.values())
    keep = [0, 1, len(total) - 1]
    assert np.allclose(total[np.ix_(keep, keep)], plain.sums["units"])


def test_absorbed_effect_equals_the_whole_equations(spark, trial):
    whole = mmec(trial, "y ~ env + x", "~ g", weights="w")
    one = absorbed(trial, "y ~ env + x", "g", weights="w")
    assert (one.su, one.se) == pytest.approx(tuple(v for _, v in whole.components()), rel=1e-5)
    assert one.loglik == pytest.approx(whole.fit.loglik - sum(t.kernel_logdet for t in whole.design.random), rel=1e-6)
    a = {r["level"]: r for r in whole.blups().collect()}
    for r in one.blups().collect():
        assert (r["blup"], r["pev"], r["reliability"]) == pytest.approx((a[r["level"]]["blup"], a[r["level"]]["pev"], a[r["level"]]["reliability"]), rel=1e-4, abs=1e-7)
    assert [(r["estimate"], r["std_error"]) for r in one.blues().collect()] == [pytest.approx((r["estimate"], r["std_error"]), rel=1e-5) for r in whole.blues().collect()]
    many = spark.range(40_000).select((F.col("id") % 8000).cast("string").alias("g"), (F.hash(F.col("id") % 8000) % 100 / 50.0 + F.hash("id") % 100 / 100.0).alias("y"))
    found = absorbed(many, "y ~ 1", "g")
    assert found.su > 0.5 and found.blups().count() == 8000
    noise = many.select("g", (F.hash("g") * 0 + F.monotonically_increasing_id() % 2).cast("double").alias("y"))
    assert absorbed(noise.withColumn("y", F.col("y") - 0.5 * F.lit(1)), "y ~ 1", "g").su >= 0


def test_predictions_of_main_effects_with_interaction(trial):
    """V*N and V+N+V:N are one model; cell means and their averages follow from either."""
    rows = trial.filter("rep < 1").withColumn("h", F.when(F.col("x") > 0, "p").otherwise("n"))
    one, other = mmec(rows, "y ~ env*h"), mmec(rows, "y ~ env + h + env:h")
    for target, more in (("env:h", {}), ("env", {"average": ["h"]}), ("h", {"average": ["env"]})):
        a, b = ({r["level"]: (r["predicted"], r["std_error"]) for r in m.predict(target, **more).collect()} for m in (one, other))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    cells = {(r["env"], r["h"]): r["m"] for r in rows.groupBy("env", "h").agg(F.avg("y").alias("m")).collect()}
    assert {r["level"]: r["predicted"] for r in other.predict("env:h").collect()} == pytest.approx({f"{e}:{h}": m for (e, h), m in cells.items()})
    means = {e: np.mean([m for (f, _), m in cells.items() if f == e]) for e, _ in cells}
    assert {r["level"]: r["predicted"] for r in other.predict("env", average=["h"]).collect()} == pytest.approx(means)
    assert other.dtable("env", average=["h"]) == {"env": (True, False), "h": (False, True), "env:h": (True, True)}
    custom = other.predict("env", dtable={"env": (True, False)}).collect()
    assert len(custom) == len(means)


def test_hybrids_of_overlapping_sets_come_once(spark):
    rows = spark.createDataFrame([(x, m, v) for x, v in zip("abc", (1, -1, 1)) for m in ("m1",)] + [("a", "m2", -1), ("b", "m2", 1), ("c", "m2", 1)], "id string, marker string, dosage int")
    got = sorted({r["hybrid"] for r in markers.build_hybrids(rows, rows).collect()})
    assert got == ["a:a", "a:b", "a:c", "b:b", "b:c", "c:c"]
    part = markers.build_hybrids(rows.filter("id <> 'a'"), rows.filter("id <> 'c'"))
    assert sorted({r["hybrid"] for r in part.collect()}) == ["b:a", "b:b", "c:a", "c:b"]


def test_tied_variances(trial):
    """Ties over all environments are the plain interaction; other multiples lie at the maximum of the full likelihood."""
    free = mmec(trial, "y ~ env + x", "~ vsc(dsc(env), isc(g))")
    names = [n for n, _ in free.components() if not n.startswith("residual")]
    diagonal = [n for n in names if len(set(n.rsplit(".", 1)[1].split(":"))) == 1]
    assert len(diagonal) == 3
    tied = mmec(trial, "y ~ env + x", "~ vsc(dsc(env), isc(g))", ties=[dict.fromkeys(diagonal, 1.0)])
    plain = mmec(trial, "y ~ env + x", "~ env:g")
    assert tied.fit.converged and tied.fit.loglik == pytest.approx(plain.fit.loglik, abs=1e-6)
    assert values(tied)[diagonal[0]] == pytest.approx(values(plain)["env:g"], rel=1e-5) and lrt(free, tied)["df"] == 2
    errors = {r["component"]: r["var_comp_se"] for r in tied.summary().collect()}
    assert len({round(errors[n], 9) for n in diagonal}) == 1
    assert errors[diagonal[0]] == pytest.approx({r["component"]: r["var_comp_se"] for r in plain.summary().collect()}["env:g"], rel=1e-4)
    even = mmec(trial, "y ~ env + x", "~ g", "~ vsc(dsc(env), isc(units))", ties=[{"residual.e0": 2.0, "residual.e2": 2.0, "residual.e1": 2.0}])
    assert values(even)["residual.e1"] == pytest.approx(values(mmec(trial, "y ~ env + x", "~ g"))["residual.units"], rel=1e-5)

    model = mmec(trial, "y ~ env + x", "~ g + env:g", "~ vsc(dsc(env), isc(units))", ties=[{"g": 3.0, "env:g": 1.0}, {"residual.e0": 1.0, "residual.e2": 1.5}])
    got = values(model)
    assert model.fit.converged and got["g"] == pytest.approx(3 * got["env:g"]) and got["residual.e2"] == pytest.approx(1.5 * got["residual.e0"])
    pdf = trial.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.env == "e1", pdf.env == "e2", pdf.x]).astype(float)
    z = np.array([[float(g == f"g{i:02d}") for i in range(20)] for g in pdf.g])
    zz = np.array([[float(e == f"e{k}" and g == f"g{i:02d}") for k in range(3) for i in range(20)] for g, e in zip(pdf.g, pdf.env, strict=True)])
    at = lambda s, r, o: dense_reml(pdf, x, [z, zz], [3 * s * np.eye(20), s * np.eye(60)], pdf.env.map({"e0": r, "e1": o, "e2": 1.5 * r}).to_numpy())
    here = got["env:g"], got["residual.e0"], got["residual.e1"]
    assert model.fit.loglik == pytest.approx(at(*here), abs=1e-6)
    for k in range(3):
        for factor in (0.98, 1.02):
            assert at(*(v * (factor if i == k else 1) for i, v in enumerate(here))) < model.fit.loglik
    for bad in ([{"g": 1.0, "residual.e0": 1.0}], [{"g": 1.0}], [{"g": 1.0, "nothing": 1.0}], [{"g": 1.0, "env:g": 0.0}]):
        with pytest.raises(ValueError):
            mmec(trial, "y ~ env", "~ g + env:g", ties=bad)


def test_many_records_with_a_large_mean_converge():
    """Cross-products as of a million records of one variance in both halves: the likelihood's rounding must not end the fit early."""
    q, n = 64, 6000
    for seed, mean in ((6, 100.0), (8, 1000.0), (9, 0.0)):
        rng, place, total = np.random.default_rng(seed), np.arange(q), np.zeros((2 * q + 3, 2 * q + 3))
        means, spread = np.zeros((2, q)), np.zeros((2, q))
        for h in range(2):
            means[h] = mean + 0.02 * ((place + 1) * 7 % 64) + h * 0.01 * ((place + 1) * 11 % 64) + rng.normal(0, 0.125 / np.sqrt(n), q)
            spread[h] = 0.125**2 * rng.chisquare(n - 1, q)
            x = np.zeros((q, 2 * q + 3))  # a place's records alike, but for the spread of their values
            x[place, 2 + h * q + place], x[:, 0], x[:, 1], x[:, -1] = 1, 1, h, means[h]
            total += n * x.T @ x
            total[-1, -1] += spread[h].sum()
        term = RandomTerm("p", 2, [f"{a}:{b}" for a in "01" for b in place], ("place",), ["0", "1"], [str(b) for b in place], 0.15 * np.eye(2), np.eye(2, dtype=int))
        design = Design(None, [Block("(Intercept)", 0, ["(Intercept)"]), Block("half", 1, ["1"])], [term], ["units"], False)
        found = fit_reml(design, Gram({"units": total}, {"units": 2 * q * n}, {"units": 0.0}), ties=[{"p.0:0": 1.0, "p.1:1": 1.0}])
        mse = spread.mean() / (n - 1)
        assert found.converged and found.theta[0][0, 0] == pytest.approx(means.var(axis=1, ddof=1).mean() - mse / n, rel=1e-7) and found.residual["units"] == pytest.approx(mse, rel=1e-7)
