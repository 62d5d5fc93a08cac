"""Marker scans: refits in batches against whole fits, and components as covariates."""

import numpy as np
import pytest

from agromix.operators.kernels import a_matrix
from agromix.operators.matrices import from_dense
from agromix.operators.scan import gwas, kinship_components, scan_refits
from agromix.plans import design
from agromix.plans.model import mmec


@pytest.fixture(scope="module")
def population(spark):
    rng = np.random.default_rng(8)
    n, m = 30, 6
    dose = rng.integers(-1, 2, (n, m))
    markers = spark.createDataFrame([(f"g{i:02d}", f"m{j}", float(dose[i, j])) for i in range(n) for j in range(m)] + [(f"g{i:02d}", "flat", 1.0) for i in range(n)], "id string, marker string, dosage double")
    root = rng.normal(size=(n, n + 5))
    kernel = root @ root.T / (n + 5) + 0.05 * np.eye(n)
    u = np.linalg.cholesky(kernel) @ rng.normal(size=n) * 1.5
    g = np.concatenate((np.arange(n), rng.integers(0, n, 70)))
    x, b = rng.normal(size=len(g)), rng.integers(0, 3, len(g))
    y = 2 + 0.4 * x + b + u[g] + dose[g, 0] * 0.8 + rng.normal(size=len(g))
    rows = spark.createDataFrame([(f"g{i:02d}", f"b{k}", float(z), float(v)) for i, k, z, v in zip(g, b, x, y, strict=True)], "line string, block string, x double, y double").cache()
    return rows, markers.cache(), from_dense(spark, [f"g{i:02d}" for i in range(n)], kernel).cache(), dose


@pytest.mark.parametrize("with_kernel", [True, False])
def test_refits_equal_whole_fits(spark, population, with_kernel):
    rows, markers, kernel, dose = population
    random, options = ("~ vsc(isc(line), Gu=K)", {"kernels": {"K": kernel}}) if with_kernel else ("~ line", {})
    got = {r["marker"]: r for r in gwas(rows, "y ~ x + block", random, markers, "line", p3d=False, **options).collect()}
    assert set(got) == {f"m{j}" for j in range(6)}
    for j in (0, 1, 4):
        one = spark.createDataFrame([(f"g{i:02d}", float(v)) for i, v in enumerate(dose[:, j])], "line string, m double")
        want = mmec(rows.join(one, "line"), "y ~ x + block + m", random, **options).blues().filter("term = 'm'").first()
        own = got[f"m{j}"]
        assert own["effect"] == pytest.approx(want["estimate"], rel=1e-5) and own["std_error"] == pytest.approx(want["std_error"], rel=1e-5)
        assert own["f_value"] == pytest.approx(want["t_value"] ** 2, rel=1e-4)


def test_refits_take_one_effect(population):
    rows, markers, _, _ = population
    model = mmec(rows, "y ~ x", "~ line + block")
    with pytest.raises(ValueError, match="one random effect"):
        scan_refits(model, "line", markers)
    with pytest.raises(ValueError, match="no random effect"):
        scan_refits(mmec(rows, "y ~ x", "~ line"), "block", markers)


def test_components_are_covariates(population):
    rows, markers, _, _ = population
    dosed = markers.filter("marker <> 'flat'")
    pcs = kinship_components(a_matrix(dosed), 2).withColumnRenamed("id", "line")
    want = {r["marker"]: r for r in gwas(rows.join(pcs, "line"), "y ~ x + pc1 + pc2", "~ line", dosed, "line").collect()}
    got = {r["marker"]: r for r in gwas(rows, "y ~ x", "~ line", dosed, "line", n_pc=2).collect()}
    assert set(got) == set(want) and all(got[k]["effect"] == pytest.approx(want[k]["effect"]) for k in want)


@pytest.mark.parametrize("held", [True, False])
def test_more_genotypes_than_a_matrix_may_have(population, monkeypatch, held):
    """Summed by genotype the scan is the same, with no variance held and with one estimated; dosages are missing too."""
    rows, markers, _, _ = population
    some = markers.selectExpr("id", "marker", "CASE WHEN id IN ('g03', 'g11') AND marker = 'm2' THEN NULL ELSE dosage END AS dosage")
    options = {"theta": {"line": [[0.0]]}, "codes": {"line": [[3]]}} if held else {}
    want = {r["marker"]: r for r in gwas(rows, "y ~ x + block", "~ line", some, "line", **options).collect()}
    monkeypatch.setattr(design, "MAX_ORDER", 12)
    got = {r["marker"]: r for r in gwas(rows, "y ~ x + block", "~ line", some, "line", **options).collect()}
    assert want.keys() == got.keys() and all(got[k][c] == pytest.approx(want[k][c], rel=1e-4) for k in want for c in ("effect", "std_error", "f_value", "score"))
