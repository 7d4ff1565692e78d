"""AdaBoost against plain loops, and its draws."""

import numpy as np
import pandas as pd
import pytest

from fathom.plans import adaboost as A
from fathom.plans import trees as T


def test_rows_are_drawn_in_proportion_to_their_weight():
    draw = np.random.default_rng(2)
    w = draw.exponential(size=3000)
    w[7] = 40 * w.mean()
    total, n = w.sum(), 3000
    times = np.stack([A.drawn(w, 0.0, total, n, t) for t in range(60)])
    assert (times.sum(1) == n).all()
    assert np.allclose(times.mean(0), n * w / total, atol=0.35) and abs(times[:, 7].mean() - n * w[7] / total) < 0.5
    assert len({tuple(t) for t in times.tolist()}) == 60                       # every round draws anew
    # blocks draw for themselves what the whole draws
    start, parts = 0.0, []
    for part in np.array_split(w, 7):
        parts.append(A.drawn(part, start, total, n, 3))
        start += part.sum()
    assert np.abs(np.concatenate(parts) - times[3]).sum() <= 2                  # rounding at the borders


def test_weighted_median():
    v = np.array([[3.0, 1.0], [1.0, 2.0], [2.0, 9.0]])
    assert A.weighted_median(v, np.array([1.0, 1.0, 1.0])).tolist() == [2.0, 2.0]
    assert A.weighted_median(v, np.array([5.0, 1.0, 1.0])).tolist() == [3.0, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(5)
    n = 300
    x = draw.integers(0, 12, (n, 2)).astype(float)
    pdf = pd.DataFrame(x, columns=list("ab"))
    pdf["id"], pdf["y"] = np.arange(n), (x[:, 0] + (x[:, 1] > 5) * 4 + draw.normal(size=n)).round(2)
    pdf["c"] = pd.cut(pdf["y"], [-99, 5, 9, 99], labels=False).astype(int)
    return spark.createDataFrame(pdf), pdf


def stump(x, y, w, k):
    """Class shares left and right of the best cut by weighted Gini."""
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            sides = [np.array([w[s & (y == c)].sum() for c in range(k)]) for s in (left, ~left)]
            score = sum((s ** 2).sum() / s.sum() for s in sides)
            if best is None or score > best[0] * (1 + 1e-10):
                best = (score, f, cut, [s.argmax() for s in sides])
    return best[1:]


def test_samme_equals_a_plain_loop(table):
    df, pdf = table
    x, y, k = pdf[["a", "b"]].to_numpy(), pdf["c"].to_numpy(), 3
    w, votes = np.ones(len(y)) / len(y), np.zeros((k, len(y)))
    for _ in range(5):
        f, cut, sides = stump(x, y, w, k)
        p = np.where(x[:, f] <= cut, *sides)
        error = w[p != y].sum() / w.sum()
        step = np.log((1 - error) / error) + np.log(k - 1)
        votes[p, np.arange(len(y))] += step
        w = w / w.sum() * np.exp(step * (p != y))
    model = A.fit_adaboost(df.repartition(3), ["a", "b"], "c", "classification", {"n_estimators": 5}, ["id"])
    got = model.predict(df).toPandas().sort_values("id")["prediction"].to_numpy()
    assert len(model.members) == 5 and (got == votes.argmax(0)).all()


def test_r2_does_not_depend_on_the_layout_and_learns(table):
    df, pdf = table
    fit = lambda d: A.fit_adaboost(d, ["a", "b"], "y", "regression", {"n_estimators": 6}, ["id"])
    read = lambda m: m.predict(df).toPandas().sort_values("id")["prediction"].to_numpy()
    one, other = fit(df.repartition(1)), fit(df.repartition(6))
    assert np.allclose(read(one), read(other))
    assert np.corrcoef(read(one), pdf["y"])[0, 1] ** 2 > 0.85
    # the first round's weight, by its definition
    tree, weight = one.members[0]
    from fathom.plans.binned import bin_matrix
    e = np.abs(pdf["y"] - one.binned.mean - tree.value[tree.leaves(bin_matrix([pdf["a"].to_numpy(), pdf["b"].to_numpy()], one.binned.cuts)), 0])
    loss = (e / e.max()).mean()
    assert weight == pytest.approx(np.log((1 - loss) / loss))
    assert isinstance(tree, T.Tree) and tree.feature.max() <= 1
