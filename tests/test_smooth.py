"""Surfaces with overlapping penalties against the full covariance, and planted surfaces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agromix.operators.spatial import margin, tensor_bases
from agromix.plans.smooth import sap


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(2)
    rows = [(r, c, "ab"[(r + c) % 2], float(np.sin(r / 3) * np.cos(c / 4) * 2 + 0.1 * r + rng.normal(0, 0.3)), float(np.sin(r / 3) * np.cos(c / 4) * 2 + 0.1 * r)) for r in range(20) for c in range(16)]
    return spark.createDataFrame(rows, "r int, c int, k string, y double, truth double").repartition(4)


def full_likelihood(pdf, form, variances, left):
    """REML by the covariance of all records, its penalties added in the unscaled basis."""
    x, y = margin(0, 15, 5), margin(0, 19, 6)
    parts = tensor_bases(x, y, pdf.c.to_numpy(float), pdf.r.to_numpy(float))
    fixed = np.column_stack([np.ones(len(pdf)), parts["base"]])
    main = variances if form == "SAP" else variances[:2]
    both = variances if form == "SAP" else variances[2:]
    v = left * np.eye(len(pdf)) + main[0] * parts["fC"] @ parts["fC"].T + main[1] * parts["fR"] @ parts["fR"].T
    v += both[0] * parts["fC.R"] @ parts["fC.R"].T + both[1] * parts["C.fR"] @ parts["C.fR"].T
    raw = parts["fC.fR"] * np.sqrt(np.outer(x.values, y.values).ravel())
    precision = (x.values[:, None] / both[0] + y.values[None, :] / both[1]).ravel()
    v += raw / precision @ raw.T
    vi = np.linalg.inv(v)
    xvx = fixed.T @ vi @ fixed
    p = vi - vi @ fixed @ np.linalg.solve(xvx, fixed.T @ vi)
    z = pdf.y.to_numpy()
    return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + z @ p @ z)


@pytest.mark.parametrize("form", ["SAP", "SAP.ANOVA"])
def test_likelihood_is_at_a_maximum(field, form):
    model = sap(field, "y", "c", "r", form, segments=(5, 6))
    pdf = field.toPandas()
    assert model.fit.converged and np.abs(model.fit.slope).max() < 1e-3
    at = lambda v, e: full_likelihood(pdf, form, v, e)
    top = at(model.fit.variances, model.fit.residual)
    assert model.fit.loglik == pytest.approx(top, abs=1e-5)
    for factor in (0.8, 1.25):
        for k in range(len(model.fit.variances)):
            assert at(np.where(np.arange(len(model.fit.variances)) == k, factor, 1) * model.fit.variances, model.fit.residual) < top + 1e-7
        assert at(model.fit.variances, factor * model.fit.residual) < top


def test_planted_surface_is_found(field):
    model = sap(field, "y", "c", "r", segments=(6, 8))
    got = model.fitted().select(F.sqrt(F.avg((F.col("fitted") - F.col("truth")) ** 2)).alias("e"), F.sqrt(F.avg((F.col("y") - F.col("truth")) ** 2)).alias("n")).first()
    assert got["e"] < 0.5 * got["n"] and abs(model.fit.residual - 0.09) < 0.02
    found = {r["component"]: r for r in model.summary().collect()}
    assert set(found) == {"x", "y", "residual"} and 5 < found["x"]["ed"] + found["y"]["ed"] < 80


def test_surfaces_by_level(field):
    """Two levels of like size: each has its own surface, as two fits have, but for the common residual variance."""
    shifted = field.withColumn("y", F.when(F.col("k") == "a", F.col("y")).otherwise(7.0 - F.col("y"))).withColumn("truth", F.when(F.col("k") == "a", F.col("truth")).otherwise(7.0 - F.col("truth")))
    model = sap(shifted, "y", "c", "r", "SAP.ANOVA", at="k", segments=(5, 6))
    assert model.fit.converged and [n.split(":")[0] for n in model.names] == ["a"] * 4 + ["b"] * 4
    got = model.fitted().groupBy("k").agg(F.sqrt(F.avg((F.col("fitted") - F.col("truth")) ** 2)).alias("e")).collect()
    assert len(got) == 2 and all(r["e"] < 0.25 for r in got)


def test_refusals(spark, field):
    with pytest.raises(ValueError):
        sap(field, "y", "c", "r", "PSANOVA")
    with pytest.raises(ValueError):
        sap(field.withColumn("c", F.when(F.col("r") > 3, F.col("c"))), "y", "c", "r")
    some = field.withColumn("y", F.when(F.col("r") != 7, F.col("y")))
    assert sap(some, "y", "c", "r", segments=(4, 4)).fitted().count() == 19 * 16


def test_widths_of_all_bases_are_found_in_one_job(spark, monkeypatch):
    """A pass over the records for each basis would make the design anew as many times."""
    from agromix.plans import design
    from agromix.plans.formula import parse_formula, parse_terms

    rows = spark.createDataFrame([([1.0, 2.0], [3.0], [1.0, 0.0, 2.0], 1.0)], "a array<double>, b array<double>, c array<double>, y double")
    passes, plain = [], type(rows).agg
    monkeypatch.setattr(type(rows), "agg", lambda self, *x: passes.append(len(x)) or plain(self, *x))
    formula = parse_formula("y ~ basis(a) + basis(b)")
    made = design.build_design(rows, "y", formula.terms, formula.intercept, parse_terms("~ vsc(isc(basis(c)))")[0])
    assert passes == [3] and [b.size for b in (*made.fixed, *made.random)] == [1, 2, 1, 3]
