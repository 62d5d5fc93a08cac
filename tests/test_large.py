"""Effects of any number of levels: conjugate gradients and absorption against dense fits."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from agromix.plans import absorb, design, model
from agromix.plans.model import absorbed, crossed, mmec, two_stage


@pytest.fixture(scope="module")
def trial(spark):
    rng = np.random.default_rng(1)
    n, a, b, g = 1200, 60, 35, 3
    at, bt, gt, x = rng.integers(0, a, n), rng.integers(0, b, n), rng.integers(0, g, n), rng.normal(size=n)
    y = 3 + 0.5 * x + gt + rng.normal(size=a)[at] * 1.5 + rng.normal(size=b)[bt] * 0.8 + rng.normal(size=n) * 2
    rows = [(f"a{i}", f"b{j}", f"g{k}", float(z), float(v), float(1 + k)) for i, j, k, z, v in zip(at, bt, gt, x, y, strict=True)]
    return spark.createDataFrame(rows, "a string, b string, g string, x double, y double, w double").cache()


HELD = {"theta": {"a": [[2.0]], "b": [[0.5]]}, "codes": {"a": [[3]], "b": [[3]]}, "residual": {"units": 4.0}, "fixed_residual": True}


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_held_variances_give_the_dense_solutions(trial):
    dense = mmec(trial, "y ~ x + g", "~ a + b", weights="w", **HELD)
    large = crossed(trial, "y ~ x + g", ["a", "b"], weights="w", variances={"a": 2.0, "b": 0.5}, residual=4.0)
    want, got = by(dense.blups(), "term", "level"), by(large.blups(), "term", "level")
    assert set(want) == set(got) and all(abs(want[k]["blup"] - got[k]["blup"]) < 1e-8 for k in want)
    want, got = by(dense.blues(), "term", "level"), by(large.blues_with_errors(), "term", "level")
    assert set(want) == set(got) and all(abs(want[k][c] - got[k][c]) < 1e-7 for k in want for c in ("estimate", "std_error"))
    pev, want = large.pev("a", ["a1", "a20"]).collect(), by(dense.blups(), "term", "level")
    assert all(abs(r["pev"] - want["a", r["level"]]["pev"]) < 1e-8 and abs(r["reliability"] - want["a", r["level"]]["reliability"]) < 1e-8 for r in pev)
    with pytest.raises(ValueError, match="no level"):
        large.pev("a", ["nowhere"])
    a, b = dense.fitted().agg({"fitted": "sum", "residual": "max"}).first(), large.fitted().agg({"fitted": "sum", "residual": "max"}).first()
    assert np.allclose(a, b)
    assert large.steps < 40


def test_reml_agrees_with_the_dense_fit(trial):
    dense, large = by(mmec(trial, "y ~ x + g", "~ a + b").summary(), "component"), crossed(trial, "y ~ x + g", ["a", "b"], probes=8)
    got = by(large.summary(), "component")
    assert large.converged and set(dense) == set(got)
    assert all(abs(got[k]["var_comp"] / dense[k]["var_comp"] - 1) < 0.03 for k in dense)


def test_wide_fixed_part_and_interaction(spark, trial):
    """More fixed coefficients than sums are observed for, and an interaction as an effect."""
    dense = mmec(trial, "y ~ x + b", "~ a:g", theta={"a:g": [[1.5]]}, codes={"a:g": [[3]]}, residual={"units": 4.0}, fixed_residual=True)
    large = crossed(trial, "y ~ x + b", ["a:g"], variances={"a:g": 1.5}, residual=4.0)
    want, got = by(dense.blups(), "level"), by(large.blups(), "level")
    assert set(want) == set(got) and all(abs(want[k]["blup"] - got[k]["blup"]) < 1e-8 for k in want)
    want, got = by(dense.blues(), "term", "level"), by(large.blues(), "term", "level")
    assert set(want) == set(got) and all(abs(want[k]["estimate"] - got[k]["estimate"]) < 1e-7 for k in want)


def test_no_variance_ends_at_the_boundary(spark):
    rng = np.random.default_rng(5)
    rows = [(f"a{i % 40}", f"b{i // 40}", float(v)) for i, v in enumerate(rng.normal(size=1600))]
    # means of a are all alike: its variance can only be none
    df = spark.createDataFrame(rows, "a string, b string, y double").selectExpr("a", "b", "y - avg(y) OVER (PARTITION BY a) + hash(b) / 1073741824.0 AS y")
    found = by(crossed(df, "y ~ 1", ["a", "b"], probes=2, tol=1e-3).summary(), "component")
    assert found["a",]["constraint"] == "boundary" and found["a",]["var_comp"] == 0.0
    assert found["b",]["constraint"] == "positive" and found["b",]["var_comp"] > 0.5


def test_mmec_beyond_a_drivers_matrix(trial, monkeypatch):
    """The same calls with one and with two effects that are too large, and what the model can't be asked."""
    one = {"theta": {"a": [[2.0]]}, "codes": {"a": [[3]]}, "residual": {"units": 4.0}, "fixed_residual": True}
    small, both = mmec(trial, "y ~ x + g", "~ a", **one), mmec(trial, "y ~ x", "~ a + b", **HELD)
    stage = two_stage(trial, "y", "a", "g")
    want = [by(small.blups(), "level"), by(small.predict("a"), "level"), by(both.blups(), "term", "level"), by(stage.blues(), "level"), small.fitted().agg({"fitted": "sum", "residual": "max"}).first()]
    monkeypatch.setattr(design, "MAX_ORDER", 30)
    monkeypatch.setattr(model, "MAX_ORDER", 30)
    large = mmec(trial, "y ~ x + g", "~ a", **one)
    got = [by(large.blups(), "level"), by(large.predict("a"), "level"), by(mmec(trial, "y ~ x", "~ a + b", **HELD).blups(), "term", "level"), by(two_stage(trial, "y", "a", "g").blues(), "level")]
    for w, g, columns in zip(want, got, (("blup", "pev", "reliability"), ("predicted", "std_error"), ("blup",), ("estimate", "std_error", "t_value")), strict=False):
        assert set(w) == set(g) and all(abs(w[k][c] - g[k][c]) < 1e-7 for k in w for c in columns)
    assert np.allclose(large.fitted().agg({"fitted": "sum", "residual": "max"}).first(), want[-1])
    with pytest.raises(ValueError, match="no term"):
        large.predict("g")
    with pytest.raises(ValueError, match="all or none"):
        mmec(trial, "y ~ x", "~ a + b", codes={"a": [[3]]}, theta={"a": [[1.0]]})
    with pytest.raises(ValueError, match="would not fit"):
        mmec(trial, "y ~ x", "~ vsc(usc(g), isc(a))")


def test_an_absorbed_model_sums_its_levels_once(spark, monkeypatch):
    """Weights whose sums depend on the order they are added in, which another run of the same aggregation may change."""
    plan, calls, noise = absorb._by_level, [], F.udf(lambda: time.time_ns() % 1000 / 1000, "double").asNondeterministic()

    def shifted(made, level):
        calls.append(level)
        return plan(made, level).withColumn("n", F.col("n") * (1 + (noise() - 0.5) * 1e-12))

    rows = spark.createDataFrame([(f"g{i % 9}", float((i * 37) % 11), 0.1 * (1 + i % 7)) for i in range(90)], "g string, y double, w double")
    means = {k: m / n for k, m, n in ((r["g"], r["m"], r["n"]) for r in rows.groupBy("g").agg(F.sum(F.col("y") * F.col("w")).alias("m"), F.sum("w").alias("n")).collect())}
    want = mmec(rows, "y ~ 1", "~ g", weights="w").fit
    monkeypatch.setattr(absorb, "_by_level", shifted)
    fixed = absorb.fit_absorbed(design.build_design(rows, "y", (), False, (), None, "w"), "g", (math.inf, 1.0))
    got = {r["level"]: r["estimate"] for r in fixed.blues().collect()}
    assert calls and got.keys() == means.keys() and all(got[k] == pytest.approx(means[k]) for k in means)
    found = absorbed(rows, "y ~ 1", "g", weights="w")
    assert (found.su, found.se, found.loglik) == pytest.approx((float(want.theta[0][0, 0]), want.residual["units"], want.loglik), rel=1e-5, abs=1e-6)


def test_effects_of_a_few_covariates_are_plain_arithmetic(spark, monkeypatch):
    """With an intercept and covariates nothing is taken apart by entry, and effects equal those of the general way."""
    rng = np.random.default_rng(9)
    rows = [(f"l{k % 37}", float(x), float(y)) for k, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "level string, x double, y double")
    for held in ((2.0, 5.0), None):
        model = absorbed(df, "y ~ x", "level", variances=held)
        found = model.blups()
        assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {r["level"]: r for r in found.collect()}
        monkeypatch.setattr(absorb, "PLAIN", 0)
        other = absorbed(df, "y ~ x", "level", variances=held)
        want = {r["level"]: r for r in other.blups().collect()}
        monkeypatch.undo()
        assert model.loglik == pytest.approx(other.loglik) and got.keys() == want.keys()
        assert all((got[k]["blup"], got[k]["pev"]) == pytest.approx((want[k]["blup"], want[k]["pev"]), abs=1e-9) for k in got)
