"""Boosting against plain loops over small tables."""

import numpy as np
import pandas as pd
import pytest

from fathom.plans import boosting as G
from fathom.plans import trees as T


def score(g, h, lam):
    return g.sum() ** 2 / (h.sum() + lam) if h.sum() + lam > 0 else 0.0


def cut_of(x, g, h, b):
    """Best (gain, feature, cut) of some rows by the second-order gain."""
    best = (-np.inf, None, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            s = x[:, f] <= cut
            if min(s.sum(), (~s).sum()) < b.min_rows or min(h[s].sum(), h[~s].sum()) < b.min_weight:
                continue
            gain = score(g[s], h[s], b.penalty) + score(g[~s], h[~s], b.penalty) - score(g, h, b.penalty)
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    return best


def plain_tree(x, g, h, d, b):
    """Leaf values of all rows: depth first, best first, or one cut for each level."""
    value = np.zeros(len(x))

    def leaf(rows):
        value[rows] = g[rows].sum() / (d[rows].sum() + b.penalty)
    if b.symmetric:
        groups = [np.arange(len(x))]
        for _ in range(b.depth):
            best = (1e-9, None, None)
            for f in range(x.shape[1]):
                for cut in np.unique(x[:, f])[:-1]:
                    gain = sum(score(g[r[s]], h[r[s]], b.penalty) + score(g[r[~s]], h[r[~s]], b.penalty) - score(g[r], h[r], b.penalty)
                               for r in groups for s in [x[r, f] <= cut])
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
            if best[1] is None:
                break
            groups = [r[s] for r in groups for s in (x[r, best[1]] <= best[2], x[r, best[1]] > best[2])]
        for r in groups:
            if len(r):
                leaf(r)
        return value
    leaves, done = [(np.arange(len(x)), 0)], []
    cuts = {}
    while leaves:
        known = []
        for rows, depth in leaves:
            key = rows.tobytes()
            if key not in cuts:
                ok = depth < (b.depth or 99) and len(rows) >= 2 and (b.kind != "gbm" or np.ptp(g[rows]) > 1e-12)
                cuts[key] = cut_of(x[rows], g[rows], h[rows], b) if ok else (-np.inf, None, None)
            known.append(cuts[key])
        least = -1e-9 if b.min_gain is None else b.min_gain
        k = max(range(len(leaves)), key=lambda i: known[i][0])
        if known[k][1] is None or known[k][0] <= least or (b.leaves and len(leaves) >= b.leaves):
            break
        (rows, depth), (_, f, cut) = leaves.pop(k), known[k]
        s = x[rows, f] <= cut
        leaves += [(rows[s], depth + 1), (rows[~s], depth + 1)]
    for rows, _ in leaves + done:
        leaf(rows)
    return value


def plain_boost(x, y, b, k):
    n = len(y)
    if k == 0:
        f = np.full((1, n), y.mean())
    else:
        share = np.array([(y == c).mean() for c in range(k)])
        f = np.repeat(G.first_scores(b.kind, share, 0.0)[:, None], n, axis=1)
    for _ in range(b.rounds):
        if k == 0:
            g, h = y - f, np.ones_like(f)
        elif k == 2:
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
        else:
            e = np.exp(f)
            p = e / e.sum(0)
            g = (np.arange(k)[:, None] == y) - p
            h = {"gbm": np.abs(g) * (1 - np.abs(g)) * k / (k - 1), "xgb": 2 * p * (1 - p), "lgbm": k / (k - 1) * p * (1 - p), "catboost": p * (1 - p)}[b.kind]
        for m in range(len(f)):
            split_h = np.ones(n) if b.kind == "gbm" else h[m]
            f[m] = f[m] + b.rate * plain_tree(x, g[m], split_h, h[m], b)
    return f


NAMES = ["GradientBoosting", "XGB", "LGBM", "CatBoost"]


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(5)
    n = 400
    x = draw.integers(0, 12, (n, 3)).astype(float)
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["y"] = (x[:, 0] * 0.7 + (x[:, 1] > 5) * 3 + draw.normal(size=n)).round(2)
    pdf["two"], pdf["three"] = (pdf["y"] > 5).astype(int), pd.cut(pdf["y"], [-99, 3, 6, 99], labels=False).astype(int)
    pdf["fold"] = np.arange(n) % 2
    return spark.createDataFrame(pdf).repartition(3), pdf


@pytest.mark.parametrize("name, target, k", [(n, t, k) for n in NAMES for t, k in (("y", 0), ("three", 3))] + [("GradientBoosting", "two", 2), ("XGB", "two", 2)])
def test_equals_a_plain_loop(table, name, target, k):
    df, pdf = table
    task = "classification" if k else "regression"
    params = {"n_estimators": 3, "max_depth": 2} if name != "LGBM" else {"n_estimators": 3, "num_leaves": 5}
    model = G.fit_boosting(df, list("abc"), target, name + ("Classifier" if k else "Regressor"), task, params)
    got = np.array(df.select("a", "b", "c", "y", model.scores(df).alias("s")).toPandas().sort_values(["a", "b", "c", "y"])["s"].tolist()).T
    pdf = pdf.sort_values(["a", "b", "c", "y"])
    want = plain_boost(pdf[list("abc")].to_numpy(), pdf[target].to_numpy().astype(float), model.model.booster, k)
    assert np.allclose(got, want, atol=1e-8)


@pytest.mark.parametrize("name", ["XGB", "LGBM", "CatBoost"])
def test_finishing_in_one_task_does_not_change_a_model(table, monkeypatch, name):
    df, _ = table
    fit = lambda: G.fit_boosting(df, list("abc"), "three", name + "Classifier", "classification", {"n_estimators": 2, "max_depth": 3, "num_leaves": 6})
    read = lambda m: np.array(df.select("a", "b", "c", "y", m.scores(df).alias("s")).toPandas().sort_values(["a", "b", "c", "y"])["s"].tolist())
    here = read(fit())
    monkeypatch.setattr(G, "LOCAL", 60)
    monkeypatch.setattr(G, "KEEP", 1)
    assert np.allclose(here, read(fit()))


def test_a_search_equals_separate_fits(table):
    df, pdf = table
    combos = list(enumerate([{"n_estimators": n, "max_depth": 2, "learning_rate": r} for r in (0.1, 0.5) for n in (2, 4)]))
    got = {s["combo_id"]: s["mean_score"] for s in G.cv_boosting(df, list("abc"), "y", "GradientBoostingRegressor", "regression", combos, 2)}
    for cid, params in combos[1:]:
        scores = []
        for f in (0, 1):
            model = G.fit_boosting(df.where(f"fold <> {f}"), list("abc"), "y", "GradientBoostingRegressor", "regression", params)
            held = model.predict(df.where(f"fold = {f}")).select("y", "prediction").toPandas()
            scores.append(1 - ((held.y - held.prediction) ** 2).mean() / held.y.var(ddof=0))
        assert got[cid] == pytest.approx(np.mean(scores), abs=1e-6)
        if cid == 1:
            break


def test_missing_values_learn_their_side(spark):
    rows = [(float(i % 4) if i % 5 else None, 10.0 if i % 5 == 0 or i % 4 == 3 else 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, y double")
    model = G.fit_boosting(df, ["a"], "y", "XGBRegressor", "regression", {"n_estimators": 20, "max_depth": 2})
    for r in model.predict(df.distinct()).collect():
        assert r.prediction == pytest.approx(r.y, abs=1.0)


def test_best_first_is_cut_by_gain():
    # root 0 (gain 9) -> 1 (gain 2), 2 (gain 5) -> 5 (gain 4)
    tree = T.Tree(np.array([0, 0, 0, -1, -1, 0, -1, -1, -1], np.int32), np.zeros(9, np.uint8), np.zeros(9, np.uint8),
                  np.array([1, 3, 5, 0, 0, 7, 0, 0, 0], np.int32), np.array([9, 2, 5, 0, 0, 4, 0, 0, 0.0]), np.ones(9), np.arange(9.0)[:, None])
    cut, last = G.best_first(tree, 3)
    assert cut.feature.tolist() == [0, -1, 0, -1, -1] and cut.value[:, 0].tolist() == [0, 1, 2, 5, 6] and last == {1, 2, 5, 6}


@pytest.mark.parametrize("name", ["GradientBoosting", "XGB", "LGBM", "CatBoost"])
def test_trees_of_several_members_are_grown_without_an_exchange(table, monkeypatch, name):
    df, _ = table
    fit = lambda: G.fit_boosting(df, list("abc"), "three", name + "Classifier", "classification", {"n_estimators": 2, "max_depth": 3, "num_leaves": 6})
    read = lambda m: np.array(df.select("a", "b", "c", "y", m.scores(df).alias("s")).toPandas().sort_values(["a", "b", "c", "y"])["s"].tolist())

    def exchanged(*args):
        raise AssertionError("rows or histograms are sent over the network")
    with monkeypatch.context() as only:
        only.setattr(G, "LOCAL", 140)                       # 400 rows in three tasks, one for each class
        only.setattr(T, "_rows_of", exchanged)
        only.setattr(T, "_histograms", exchanged)
        here = read(fit())
    monkeypatch.setattr(G, "LOCAL", 60)
    assert np.allclose(here, read(fit()))


@pytest.mark.parametrize("name", ["GradientBoostingRegressor", "XGBRegressor", "LGBMRegressor", "CatBoostRegressor", "XGBClassifier"])
def test_all_rounds_of_a_fit_are_grown_in_one_task(table, monkeypatch, name):
    df, _ = table
    target, task = ("two", "classification") if name.endswith("Classifier") else ("y", "regression")
    fit = lambda: G.fit_boosting(df, list("abc"), target, name, task, {"n_estimators": 11, "max_depth": 3, "num_leaves": 6})
    read = lambda m: np.array(df.select("a", "b", "c", "y", m.scores(df).alias("s")).toPandas().sort_values(["a", "b", "c", "y"])["s"].tolist())

    def passed(*args, **kwargs):
        raise AssertionError("a pass for each level or round")
    with monkeypatch.context() as only:
        for at, what in ((T, "grow"), (G, "grow_symmetric"), (G, "grow_whole"), (G, "_with_scores")):
            only.setattr(at, what, passed)
        model = fit()
    assert len(model.model.trees) == 11
    here = read(model)
    monkeypatch.setattr(G, "BINS_OF_A_FIT", 0)
    monkeypatch.setattr(G, "LOCAL", 60)
    assert np.allclose(here, read(fit()))


@pytest.fixture(scope="module")
def cells():
    draw = np.random.default_rng(11)
    bins = np.stack([draw.integers(0, 40, 5000), draw.integers(0, 2, 5000), draw.integers(0, 200, 5000)]).astype(np.uint8)
    bins[0, ::9], bins[2, ::4] = T.MISSING, T.MISSING
    g = np.where((bins[0] < 20) == (bins[2] < 100), 5.0, -5.0) + bins[1] + draw.normal(size=5000)      # its first cut gains little, the next ones much
    c = draw.integers(1, 4, 5000).astype(float)
    return bins, np.column_stack([c, c * g, c]), np.array([41, 3, 201]), [np.arange(float(n)) for n in (40, 2, 200)]


def test_a_tree_from_counted_bins_is_the_tree_of_its_rows(cells):
    bins, s, sizes, stands = cells
    for rule in (T.Rule(max_depth=5), T.Rule(max_depth=6, penalty=1.0, min_weight=30.0, min_gain=1e-6, spread=False)):
        e = rule.expand(s)
        a, b = T.grow_counted(T.Counts(bins, sizes, list(e.T)), rule, T.root_path(0, 42), stands), T.grow_here(bins, e, rule, 0, T.root_path(0, 42), stands)
        inner = a.feature >= 0
        assert (a.feature == b.feature).all() and (a.left == b.left).all() and (a.cut[inner] == b.cut[inner]).all() and inner.sum() >= 10
        assert (a.missing_left[inner] == b.missing_left[inner]).all() and np.allclose(a.value, b.value)


@pytest.mark.parametrize("leaves", [2, 7, 31])
def test_best_first_growth_counts_no_other_leaves(cells, monkeypatch, leaves):
    bins, s, sizes, stands = cells
    rule = T.Rule(min_rows=20, min_gain=0.0, splits=leaves - 1, spread=False)
    want = G.best_first(T.grow_here(bins, s, rule, 0, T.root_path(0, 42), stands), leaves)[0]
    counted, of = [], T.Counts.of
    monkeypatch.setattr(T.Counts, "of", lambda self, *args: counted.append(1) or of(self, *args))
    got = G.best_first(T.grow_best(T.Counts(bins, sizes, list(s.T)), rule, stands), leaves)[0]
    inner = got.feature >= 0
    assert inner.sum() == leaves - 1 >= len(counted)
    assert (got.feature == want.feature).all() and (got.left == want.left).all() and (got.cut[inner] == want.cut[inner]).all() and np.allclose(got.value, want.value)


def test_leaves_by_conditions_are_those_of_the_table(cells):
    bins, s, sizes, stands = cells
    deep = T.Rule(min_rows=20, min_gain=0.0, splits=20, spread=False)
    flat = T.Rule(penalty=3.0, spread=False, min_gain=None)
    for tree in (G.best_first(T.grow_best(T.Counts(bins, sizes, list(s.T)), deep, stands), 21)[0], G.symmetric_here(T.Counts(bins, sizes, list(s.T)), flat, 6),
                 G.symmetric_here(T.Counts(bins[:, :1], sizes, list(s[:1].T)), flat, 6)):
        assert (tree.leaves(bins) == tree._looked_up(bins)).all() and (len(tree.feature) == 1 or len(np.unique(tree.leaves(bins))) > 7)


def test_catboost_takes_its_1000_rounds(table):
    df, _ = table
    for name in ("CatBoostRegressor", "CatBoostClassifier"):
        assert G.booster_for(name, {}).rounds == 1000 and G.booster_for(name, {"iterations": 7}).rounds == 7
    model = G.fit_boosting(df.limit(40), ["a"], "y", "CatBoostRegressor", "regression", {})
    assert len(model.model.trees) == 1000 and "1,000 rounds" in model.note
