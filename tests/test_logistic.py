import numpy as np
import pandas as pd
import pytest

from fathom.plans import logistic as L
from fathom.plans import search as S


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(500, 3)).round(1)
    z = x @ np.array([[1.5, -1, 0], [0, 1, 2.0], [-1, 0, 0.5]]).T + draw.gumbel(size=(500, 3))
    pdf = pd.DataFrame(x, columns=["a", "b b", "c"])
    pdf["y"], pdf["two"], pdf["fold"] = z.argmax(1), np.where(z[:, 0] > z[:, 1], "p", "q"), np.arange(500) % 5
    return spark.createDataFrame(pdf).repartition(3), pdf


FEATURES = ["a", "b b", "c"]


@pytest.mark.parametrize("target", ["y", "two"])
def test_the_score_equations_hold(table, target):
    df, pdf = table
    m = L.fit_logistic(df, FEATURES, target, {"C": 0.5, "tol": 1e-9, "max_iter": 500})
    x = np.column_stack([pdf[FEATURES], np.ones(500)])
    y = np.searchsorted(m.classes, pdf[target])
    z = x @ m.weights.T
    if target == "two":
        p, one = 1 / (1 + np.exp(-z)), (y == 1)[:, None]
    else:
        p, one = np.exp(z) / np.exp(z).sum(1, keepdims=True), y[:, None] == np.arange(3)
    free = m.weights * np.array([1, 1, 1, 0])
    assert np.abs((p - one).T @ x + free / 0.5).max() < 1e-5
    got = m.predict(df).toPandas()
    assert (got["prediction"] == got[target]).mean() > 0.6


def test_a_search_takes_one_pass_for_each_iteration(table, monkeypatch):
    df, _ = table
    combos = list(enumerate([{"C": c, "max_iter": 1000} for c in (0.01, 1.0)]))
    passes, descend = [], L.descend

    def counted(*a):
        out = descend(*a)
        passes.append(out[1])
        return out
    monkeypatch.setattr(L, "descend", counted)
    got = L.cv_logistic(df, FEATURES, "y", combos, 5)
    assert len(passes) == 1 and passes[0] < 60
    for (cid, p), s in zip(combos, got):
        scores = []
        for f in (0, 1):
            held = L.fit_logistic(df.where(f"fold <> {f}"), FEATURES, "y", p).predict(df.where(f"fold = {f}")).toPandas()
            scores.append((held["prediction"] == held["y"]).mean())
        assert abs(np.mean(scores) - s["mean_score"]) < 0.12 and s["combo_id"] == cid
    assert S.select_best(got)["params"]["C"] in (0.01, 1.0)


def test_rows_without_a_feature_are_left_out(spark):
    df = spark.createDataFrame([(float(i % 7), i % 7 > 3) for i in range(70)] + [(None, True)], "a double, y boolean")
    out = L.fit_logistic(df, ["a"], "y", {}).predict(df).collect()
    assert all(r.prediction == r.y for r in out if r.a is not None) and out[-1].prediction is None


def test_descent_ends_where_rounding_hides_the_decrease():
    """One feature of three values, as in M18_logistic_one_feature: its optimum to 1e-10 within few passes, whatever the counts."""
    from fathom.plans.logistic import Descent, losses
    draw = np.random.default_rng(1)
    x, y = np.column_stack([np.repeat([0.0, 1.0, 2.0], 2), np.ones(6)]), np.tile([0.0, 1.0], 3)
    for _ in range(300):
        scale = 10 ** draw.uniform(3, 8)
        c = np.floor(draw.uniform(0.05, 1, 6) * scale)
        run, passes = Descent(2, 1e-10, 1000), 0
        while not run.done and passes < 40:
            loss, grad = losses(x, y, c[None], run.point.reshape(1, 1, 2), 2)
            free = run.point * [1, 0]
            slope = (grad.reshape(-1) + free) / c.sum()
            run.told((loss[0] + (free ** 2).sum() / 2) / c.sum(), slope)
            passes += 1
        assert run.done and np.abs(slope).max() <= 1e-10
