"""Stepwise selection against fits of all models by least squares."""

import numpy as np
import pytest

from agromix.operators.ranking import stepwise


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 6))
    x[:, 5] = x[:, 0] + 0.3 * rng.normal(size=200)
    y = 2 + x[:, 0] - 0.6 * x[:, 2] + 0.15 * x[:, 3] + rng.normal(size=200)
    rows = [(*map(float, r), float(2 * r[1] - r[4]), float(v)) for r, v in zip(x, y, strict=True)]
    return spark.createDataFrame([*rows, (*[None] * 7, 1.0)], ", ".join(f"x{i} double" for i in range(7)) + ", y double")


def by_hand(data, names, start, fixed=()):
    y, n = data["y"].to_numpy(), len(data)

    def aic(some):
        x = np.column_stack([np.ones(n), *(data[c] for c in (*fixed, *some))])
        rss = float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
        return n * np.log(rss / n) + 2 * x.shape[1], rss

    now = [c for c in names] if start == "full" else []
    out = [("start", None, aic(now)[1])]
    while True:
        moves = [(aic([c for c in now if c != k] if k in now else [*now, k])[0], i, k) for i, k in enumerate(names)]
        best = min(moves)
        if best[0] >= aic(now)[0] - 1e-9:
            return out
        action = "drop" if best[2] in now else "add"
        now = [c for c in now if c != best[2]] if action == "drop" else [*now, best[2]]
        out.append((action, best[2], aic(now)[1]))


@pytest.mark.parametrize("start", ["full", "none"])
def test_steps_equal_those_by_least_squares(table, start):
    data = table.dropna().toPandas()
    names = [f"x{i}" for i in range(6)]
    for fixed in ((), ("x1",)):
        own = [x for x in names if x not in fixed]
        got = stepwise(table, "y", own, start, fixed).collect()
        want = by_hand(data, own, start, fixed)
        assert [(r["action"], r["variable"]) for r in got] == [w[:2] for w in want] and np.allclose([r["rss"] for r in got], [w[2] for w in want])


def test_a_candidate_that_depends_on_others_stays_out(table):
    got = stepwise(table, "y", [f"x{i}" for i in range(7)]).collect()  # x6 = 2 x1 - x4
    assert not any(r["variable"] == "x6" and r["action"] == "add" for r in got) and got[-1]["aic"] <= got[0]["aic"]
    with pytest.raises(ValueError, match="start"):
        stepwise(table, "y", ["x1"], "middle")
