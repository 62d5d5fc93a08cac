"""Weight matrices of groups of records against the whole covariance."""

import numpy as np
import pytest

from agromix.plans import whiten
from agromix.plans.model import mmec
from agromix.plans.whiten import Weights, ar1_weights, block_weights
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{g}", t, f"u{t % 4}", float(rng.normal()), float(rng.normal()), float(rng.uniform(0.5, 2))) for g in range(12) for t in range(1 + g % 9)]
    return spark.createDataFrame(rows, "grp string, t int, line string, x double, y double, w double").cache()


def test_likelihood_and_estimates_of_correlated_residuals(series):
    rho, model = 0.55, None
    options = {"theta": {"line": [[0.7]]}, "codes": {"line": [[3]]}, "residual": {"units": 1.3}, "fixed_residual": True}
    model = mmec(series, "y ~ x", "~ line", weight_matrix=ar1_weights(series, "grp", "t", rho), **options)
    data = series.orderBy("grp", "t").toPandas()
    same = data["grp"].to_numpy()[:, None] == data["grp"].to_numpy()
    r = np.where(same, rho ** np.abs(data["t"].to_numpy()[:, None] - data["t"].to_numpy()), 0.0)
    z = (data["line"].to_numpy()[:, None] == np.unique(data["line"])).astype(float)
    v = 0.7 * z @ z.T + 1.3 * r
    x, y, vi = np.column_stack((np.ones(len(data)), data["x"])), data["y"].to_numpy(), np.linalg.inv(v)
    c = np.linalg.inv(x.T @ vi @ x)
    b = c @ x.T @ vi @ y
    got = model.blues().collect()
    assert np.allclose([g["estimate"] for g in got], b) and np.allclose([g["std_error"] for g in got], np.sqrt(np.diag(c)))
    assert np.allclose([g["blup"] for g in model.blups().collect()], 0.7 * z.T @ vi @ (y - x @ b))
    # the restricted likelihood differs by a constant from that of another correlation
    def restricted(r_):
        v_ = 0.7 * z @ z.T + 1.3 * r_
        i = np.linalg.inv(v_)
        p = i - i @ x @ np.linalg.inv(x.T @ i @ x) @ x.T @ i
        return -0.5 * (np.linalg.slogdet(v_)[1] + np.linalg.slogdet(x.T @ i @ x)[1] + y @ p @ y)

    plain = mmec(series, "y ~ x", "~ line", **options)
    assert model.fit.loglik - plain.fit.loglik == pytest.approx(restricted(r) - restricted(np.eye(len(data))))
    assert model.fitted().count() == series.count()


def test_diagonal_matrices_are_weights(series):
    a = mmec(series, "y ~ x", "~ line", weights="w")
    b = mmec(series, "y ~ x", "~ line", weight_matrix=block_weights(series, "grp", "t", F.col("w")))
    assert a.fit.loglik == pytest.approx(b.fit.loglik) and np.allclose(a.fit.solution, b.fit.solution, atol=1e-6)


def test_what_weights_must_be(spark, series, monkeypatch):
    good = ar1_weights(series, "grp", "t", 0.3)
    with pytest.raises(ValueError, match="rho"):
        ar1_weights(series, "grp", "t", 1.0)
    with pytest.raises(ValueError, match="a column of weights"):
        mmec(series, "y ~ x", weights="w", weight_matrix=good)
    with pytest.raises(Exception, match="positive definite"):
        mmec(series, "y ~ x", weight_matrix=Weights(good.cells.filter("row <> 2 and col <> 2"), "grp", "t"))
    with pytest.raises(Exception, match="not in the data"):
        mmec(series.filter("t <> 1"), "y ~ x", weight_matrix=good)
    monkeypatch.setattr(whiten, "MOST", 3)
    with pytest.raises(ValueError, match="records"):
        mmec(series, "y ~ x", weight_matrix=good)
