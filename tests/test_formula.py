import numpy as np
import pytest

from agromix.functions.numeric import chi2_sf, f_sf, log_beta_tail, logspace, normal_sf, t_sf2
from agromix.plans.formula import Call, Interaction, Name, parse_formula, parse_terms
from agromix.plans.model import _arithmetic, _Dual, wald_test
from agromix.operators.matrices import nearest_pd
from agromix.operators.spatial import bspline_basis, margin, tensor_bases


def test_terms():
    assert parse_terms("~ a + b:c") == ((Name("a"), Interaction((Name("b"), Name("c")))), True)
    assert parse_terms("a*b")[0] == (Name("a"), Name("b"), Interaction((Name("a"), Name("b"))))
    assert parse_terms("~ 0 + a") == ((Name("a"),), False)
    assert parse_terms("~ a - 1") == ((Name("a"),), False)
    term = parse_terms("~ vsc(usc(leg(x, 2)), isc(g), Gu=K)")[0][0]
    assert isinstance(term, Call) and term.name == "vsc" and str(term.named["Gu"]) == "K" and str(term.args[0]) == "usc(leg(x, 2))"
    assert parse_formula("cbind(y1, y2) ~ 1").responses == ("y1", "y2")


@pytest.mark.parametrize("text", ["y ~ a +", "y ~ a b", "y", "y ~ f(", "y ~ )"])
def test_what_is_not_a_formula(text):
    with pytest.raises(ValueError):
        parse_formula(text)


def test_tails():
    # fixed values: published quantiles
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-10)
    assert f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-9)
    assert t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert normal_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-12)
    assert f_sf(0, 1, 5) == 1 and chi2_sf(0, 3) == 1
    assert log_beta_tail(5000, 0.5, 0.2) < -5000  # far below the smallest float
    assert logspace(3, 1, 100) == pytest.approx([1, 10, 100])


def test_expressions_with_derivatives():
    values = {"V1": _Dual(2.0, np.array([1.0, 0])), "V2": _Dual(3.0, np.array([0, 1.0]))}
    found = _arithmetic("V1 / (V1 + V2)", values, 2)
    assert found.value == pytest.approx(0.4) and found.grad == pytest.approx([3 / 25, -2 / 25])
    found = _arithmetic("sqrt(V1) * exp(-V2) + log(V2) ^ 2 - 1e-1", values, 2)
    step = 1e-6
    f = lambda a, b: a**0.5 * np.exp(-b) + np.log(b) ** 2 - 0.1
    assert found.value == pytest.approx(f(2, 3))
    assert found.grad == pytest.approx([(f(2 + step, 3) - f(2 - step, 3)) / 2 / step, (f(2, 3 + step) - f(2, 3 - step)) / 2 / step], rel=1e-6)
    for text in ("V3", "V1 +", "import os", "(V1", "V1 V2"):
        with pytest.raises(ValueError):
            _arithmetic(text, values, 2)


def test_wald():
    found = wald_test(np.diag([4.0, 1.0]), np.array([4.0, 3.0]), df=20)
    assert found["chi2"] == pytest.approx(13) and found["df"] == 2 and found["f_value"] == pytest.approx(6.5)


def test_nearest_pd():
    a = np.array([[1.0, 1.2], [1.2, 1.0]])
    found = nearest_pd(a)
    assert np.linalg.eigvalsh(found).min() > 0 and np.abs(found - a).max() < 0.2


def test_splines():
    x = np.linspace(0, 10, 41)
    b = bspline_basis(x, 0, 10, 7, 3)
    assert b.shape == (41, 10) and np.allclose(b.sum(axis=1), 1) and (b >= 0).all()
    m = margin(0, 10, 7)
    assert m.penalised.shape == (10, 8)
    null, penalised = m.evaluate(x)
    # the null space and the penalised columns span the B-splines
    span = np.hstack([null, penalised])
    assert np.allclose(span @ np.linalg.lstsq(span, b, rcond=None)[0], b, atol=1e-8)
    made = tensor_bases(m, margin(0, 5, 4), x, np.linspace(0, 5, 41))
    assert [made[p].shape[1] for p in ("base", "fC", "fR", "fC.R", "C.fR", "fC.fR")] == [3, 8, 5, 8, 5, 40]


def test_structures():
    from agromix.plans.structures import fcm, fixm, transform_constraints, unsm, vector_to_symmetric

    assert unsm(2).tolist() == [[1, 2], [2, 1]] and len(unsm(2, 3)) == 3
    assert (fixm(3) == 3).all() and fcm([1, 0, 1]).tolist() == [[1, 0], [0, 0], [0, 1]]
    assert vector_to_symmetric([1, 2, 3, 4, 5, 6]).tolist() == [[1, 2, 4], [2, 3, 5], [4, 5, 6]]
    assert transform_constraints({"a": np.array([[0, 2], [3, 1]])}, 1)["a"].tolist() == [[0, 1], [1, 1]]
    with pytest.raises(ValueError):
        vector_to_symmetric([1, 2])
