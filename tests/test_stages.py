"""A mixed model for each environment as a first stage, against one model of its own and generalised least squares."""

import numpy as np
import pytest

from agromix.plans import design
from agromix.plans.model import mmec, two_stage_models


@pytest.fixture(scope="module")
def trials(spark):
    rng = np.random.default_rng(6)
    rows = []
    for e in range(4):
        block = rng.normal(size=5) * (1 + e)
        for i in range(8):
            for b in range(5):
                if (i + b + e) % 4 or i == b:
                    rows.append((f"e{e}", f"v{i}", f"b{b}", float(i * 0.3 + e + block[b] + rng.normal())))
    return spark.createDataFrame(rows, "env string, entry string, block string, y double").cache()


def test_second_stage_is_weighted_by_whole_covariances(trials):
    got = {r["level"]: r for r in two_stage_models(trials, "y", "entry", "env", "~ block").blues().collect()}
    names = sorted(got)
    left, right = np.zeros((8, 8)), np.zeros(8)
    for e in range(4):
        model = mmec(trials.filter(f"env = 'e{e}'"), "y ~ 0 + entry", "~ block")
        own = [model.design.fixed[0].names.index(x) for x in names]
        weight = np.linalg.inv(model.fit.c_inverse[np.ix_(own, own)])
        left += weight
        right += weight @ model.fit.solution[own]
    assert np.allclose([got[x]["estimate"] for x in names], np.linalg.solve(left, right), rtol=1e-5)
    assert np.allclose([got[x]["std_error"] for x in names], np.sqrt(np.diag(np.linalg.inv(left))), rtol=1e-4)


def test_entries_missing_from_an_environment_and_random_entries(trials):
    some = trials.filter("NOT (env = 'e1' AND entry IN ('v1', 'v2'))")
    assert two_stage_models(some, "y", "entry", "env", "~ block").blues().count() == 8
    model = two_stage_models(some, "y", "entry", "env", "~ block", random=True)
    assert model.fit.converged and model.blups().count() == 8
    with pytest.raises(ValueError, match="one variance"):
        two_stage_models(some, "y", "entry", "env", "~ vsc(dsc(block), isc(entry))")


def test_more_environments_than_a_dictionary_may_have(trials, monkeypatch):
    """Environments are groups of records, not coefficients: their number has no bound."""
    many = trials.selectExpr("env", "entry", "block", "y").unionByName(trials.selectExpr("concat(env, 'x')", "entry", "block", "2 * y + 1").toDF("env", "entry", "block", "y"))
    many = many.unionByName(many.selectExpr("concat(env, 'z')", "entry", "block", "y - 3").toDF("env", "entry", "block", "y"))
    want = {r["level"]: r["estimate"] for r in two_stage_models(many, "y", "entry", "env", "~ block").blues().collect()}
    monkeypatch.setattr(design, "MAX_ORDER", 14)  # 13 coefficients, 16 environments
    got = {r["level"]: r["estimate"] for r in two_stage_models(many, "y", "entry", "env", "~ block").blues().collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
