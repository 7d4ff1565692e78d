"""Tree growing against a plain recursive tree, and the ways of finishing and routing against each other."""

import numpy as np
import pandas as pd
import pytest

from fathom.plans import binned as B
from fathom.plans import forest as Fo
from fathom.plans import trees as T


def brute_tree(x, y, w, depth=0, max_depth=None, min_split=2):
    """(feature, cut index, left, right) or the mean: the first best cut by variance, on columns of small numbers."""
    if len(y) < min_split or y.min() == y.max() or depth == max_depth:
        return np.average(y, weights=w)
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            score = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left))
            if best is None or score > best[0] * (1 + 1e-12):
                best = (score, f, cut)
    if best is None:
        return np.average(y, weights=w)
    _, f, cut = best
    left = x[:, f] <= cut
    return f, cut, *(brute_tree(x[s], y[s], w[s], depth + 1, max_depth, min_split) for s in (left, ~left))


def brute_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("params", [{}, {"max_depth": 3}, {"min_split": 10}])
def test_a_tree_equals_the_recursive_one(params):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 9, (300, 3)).astype(np.uint8)
    y = (x[:, 0] * 2.0 + draw.normal(size=300)).round(2)
    w = draw.integers(1, 4, 300).astype(float)
    rule = T.Rule(**params)
    sent = np.column_stack([np.ones(300), w * y, w])
    got = T.grow_here(x.T.copy(), rule.expand(sent), rule, 0, T.root_path(0, 1), [np.arange(9.0)] * 3)
    want = brute_tree(x, y, w, **params)
    assert np.allclose(got.value[got.leaves(x.T), 0], [brute_value(want, r) for r in x])


def test_random_cuts_are_inside_the_node_and_of_their_own():
    x = np.tile(np.arange(100, dtype=np.uint8), 2)[None, :]
    stands = [np.arange(100.0) ** 2]
    cuts = []
    for t in range(400):
        rule = T.Rule(random_cuts=True, max_depth=1)
        y = np.arange(200.0)
        tree = T.grow_here(x, rule.expand(np.column_stack([np.ones(200), y, np.ones(200)])), rule, 0, T.root_path(t, 7), stands)
        cuts.append(stands[0][tree.cut[0]])
    # uniform over the values, not over the bins
    assert abs(np.mean(np.array(cuts) < stands[0][-1] / 4) - 0.25) < 0.08 and len(set(cuts)) > 60


def test_truncation_equals_growing_with_the_bound():
    draw = np.random.default_rng(4)
    x = draw.integers(0, 20, (4, 500)).astype(np.uint8)
    y = draw.normal(size=500)
    sent = np.column_stack([np.ones(500), y, np.ones(500)])
    grow = lambda **k: T.grow_here(x, T.Rule(**k).expand(sent), T.Rule(**k), 0, T.root_path(0, 1), [np.arange(20.0)] * 4)
    whole, variants = grow(), [(2, 2), (5, 30), (None, 30), (None, 2)]
    ends = whole.truncated(x, variants)
    for v, (depth, least) in enumerate(variants):
        own = grow(max_depth=depth, min_split=least)
        assert np.allclose(whole.value[ends[v], 0], own.value[own.leaves(x), 0])


def test_poisson_draws():
    block = B.Block(0, 200_000, None, None, np.repeat([1, 7], 100_000), None, *np.random.default_rng(1).integers(0, B.PRIME, (2, 200_000)))
    w = B.bootstrap(block, B.constants(3, 42))
    for c, own in ((1, w[:100_000]), (7, w[100_000:])):
        assert abs(own.mean() - c) < 0.05 and abs(own.var() - c) < 0.2
    other = B.bootstrap(block, B.constants(4, 42))
    assert abs(np.corrcoef(w[:100_000], other[:100_000])[0, 1]) < 0.02


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(1)
    n = 900
    x = draw.normal(size=(n, 4)).round(1)
    pdf = pd.DataFrame(x, columns=["a", "b b", "c", "d.d"])
    pdf["y"] = (x[:, 0] * 3 + np.where(x[:, 1] > 0, 5, 0) + draw.normal(size=n)).round(2)
    pdf["kind"] = np.where(pdf["y"] > 4, "hi", np.where(pdf["y"] > 0, "mid", "lo"))
    pdf["id"], pdf["fold"] = np.arange(n), np.arange(n) % 3
    pdf.loc[::17, "a"] = np.nan
    return spark.createDataFrame(pdf).repartition(5)


FEATURES = ["a", "b b", "c", "d.d"]


def predicted(model, df):
    return model.predict(df).select("id", "prediction").toPandas().sort_values("id")["prediction"].to_numpy()


@pytest.mark.parametrize("name, target, least", [("RandomForestRegressor", "y", 0.9), ("ExtraTreesClassifier", "kind", 0.9)])
def test_finishing_and_routing_do_not_change_a_forest(table, monkeypatch, name, target, least):
    task = "regression" if target == "y" else "classification"
    fit = lambda df: Fo.fit_forest(df, FEATURES, target, name, task, {"n_estimators": 3}, ["id"])
    here = predicted(fit(table), table)
    monkeypatch.setattr(T, "LOCAL", 250)
    monkeypatch.setattr(T, "HELD", 1 << 16)
    there = predicted(fit(table.repartition(2)), table)
    monkeypatch.setattr(Fo, "MODEL", 10)
    monkeypatch.setattr(Fo, "ADDED", 1)
    routed = predicted(fit(table), table)
    truth = table.select("id", target).toPandas().sort_values("id")[target].to_numpy()
    if task == "regression":
        assert np.allclose(here, there) and np.allclose(here, routed)
        assert np.corrcoef(here, truth)[0, 1] ** 2 > least
    else:
        assert (here == there).all() and (here == routed).all() and (here == truth).mean() > least


@pytest.mark.parametrize("target", ["y", "kind"])
def test_a_search_equals_separate_fits(table, target):
    from fathom.plans.search import expand_grid
    task, name = ("regression", "RandomForestRegressor") if target == "y" else ("classification", "RandomForestClassifier")
    combos = list(enumerate(expand_grid({"n_estimators": [2, 4], "max_depth": [3, None], "min_samples_split": [2, 40]})))
    got = {s["combo_id"]: s["mean_score"] for s in Fo.cv_forest(table, FEATURES, target, name, task, combos, 3, ["id"])}
    for cid in (0, 3, 5):
        scores = []
        for f in range(3):
            model = Fo.fit_forest(table.where(f"fold <> {f}"), FEATURES, target, name, task, combos[cid][1], ["id"])
            held = model.predict(table.where(f"fold = {f}")).select(target, "prediction").toPandas()
            y, p = held[target], held["prediction"]
            scores.append((y == p).mean() if task == "classification" else 1 - ((y - p) ** 2).mean() / y.var(ddof=0))
        # the cuts of the columns come from all folds there, from two of them here
        assert got[cid] == pytest.approx(np.mean(scores), abs=0.02)


def test_rows_of_one_value_are_one_cell(spark):
    df = spark.range(20_000).selectExpr("id % 2 as a", "cast(id % 3 = 0 as int) as y").repartition(4)
    binned = B.prepare(df, ["a"], "y", "regression")
    assert binned.blocks.agg({"n": "sum"}).first()[0] == 4 and binned.n_rows == 20_000
    model = Fo.fit_forest(df, ["a"], "y", "BaggingRegressor", "regression", {})
    for r in model.predict(df.distinct()).collect():
        assert r.prediction == pytest.approx(1 / 3, abs=0.02)


def test_defined_cases(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "a double, y double")
    assert Fo.fit_forest(one, ["a"], "y", "DecisionTreeRegressor", "regression", {}).predict(one).first().prediction == 2.0
    odd = spark.createDataFrame([(float("inf"), 1.0), (float("-inf"), 2.0), (None, 3.0), (float("nan"), 3.0), (0.0, 4.0), (1.0, None)], "a double, y double")
    model = Fo.fit_forest(odd, ["a"], "y", "DecisionTreeRegressor", "regression", {})
    assert [r.prediction for r in model.predict(odd.where("y is not null")).collect()] == [1.0, 2.0, 3.0, 3.0, 4.0]


@pytest.mark.parametrize("target", ["y", "kind"])
def test_few_distinct_cells_are_drawn_once(spark, monkeypatch, target):
    task, name = ("regression", "RandomForestRegressor") if target == "y" else ("classification", "RandomForestClassifier")
    pdf = pd.DataFrame({"a": np.arange(3000) % 3, "b": np.arange(3000) // 3 % 2, "id": np.arange(3000), "fold": np.arange(3000) % 7 % 3})
    pdf["y"] = pdf["a"] * 2.0 + pdf["b"] + np.arange(3000) % 5
    pdf["kind"] = np.where(pdf["y"] > 4, "hi", "lo")
    df = spark.createDataFrame(pdf).repartition(3)
    combos = [(0, {"n_estimators": 3, "max_depth": 1}), (1, {"n_estimators": 5})]

    def found():
        model = Fo.fit_forest(df, ["a", "b"], target, name, task, {"n_estimators": 5}, ["id"])
        scores = Fo.cv_forest(df, ["a", "b"], target, name, task, combos, 3, ["id"])
        return model, predicted(model, df), [s["mean_score"] for s in scores]
    model, values, scores = found()
    assert model.binned.n_rows <= 6 * 9                                   # not 3000
    monkeypatch.setattr(Fo, "WEIGHTS", 0)
    model, each, of_each = found()
    assert model.binned.n_rows == 3000
    assert (values == each).all() if task == "classification" else np.allclose(values, each, rtol=1e-12)
    assert np.allclose(scores, of_each, rtol=1e-12)


def test_cells_are_gathered_only_where_few(table):
    model = Fo.fit_forest(table, FEATURES, "y", "RandomForestRegressor", "regression", {"n_estimators": 2}, ["id"])
    assert model.binned.n_rows == 900


def test_equal_rows_are_counted_where_nothing_is_sampled(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": np.arange(600) % 3, "y": np.arange(600) % 3 * 2.0, "id": np.arange(600)}))
    model = Fo.fit_forest(df, ["a"], "y", "ExtraTreesRegressor", "regression", {"n_estimators": 2}, ["id"])
    assert model.binned.blocks.selectExpr("sum(n)").first()[0] == 3       # not 600
    assert np.allclose(predicted(model, df), np.arange(600) % 3 * 2.0)


def test_best_first_growth_leaves_out_what_it_cannot_come_to():
    from fathom.plans.boosting import best_first
    draw = np.random.default_rng(5)
    x = draw.integers(0, 30, (3, 2000)).astype(np.uint8)
    x[0, ::9] = T.MISSING
    sent = np.column_stack([np.ones(2000), draw.normal(size=2000) + x[1], np.ones(2000)])
    grow = lambda splits: T.grow_here(x, sent, T.Rule(min_gain=0.0, spread=False, splits=splits), 0, T.root_path(0, 1), [np.arange(30.0)] * 3)
    whole, some = grow(None), grow(6)
    assert len(some.feature) < len(whole.feature) / 5
    want, got = best_first(whole, 7)[0], best_first(some, 7)[0]
    assert all(np.array_equal(getattr(want, k), getattr(got, k)) for k in ("feature", "cut", "missing_left", "left", "gain", "rows", "value"))
    assert len(whole.feature) > T.LOOKUP > len(got.feature)
    for tree in (some, got):                                              # by the table and step by step
        node = np.zeros(2000, np.int64)
        while (live := np.flatnonzero(tree.feature[node] >= 0)).size:
            node[live] = tree.step(node[live], x, live)
        assert np.array_equal(tree.leaves(x), node)


@pytest.mark.parametrize("nodes", [3, 4000])
@pytest.mark.parametrize("kind", ["newton", "gini", "gini of mixed rows"])
def test_sums_by_node_and_bin_are_the_same_counted_or_sorted(nodes, kind):
    draw = np.random.default_rng(nodes)
    n = 5000                                                                   # with few nodes all their bins are counted, with many the rows are sorted
    node, bins = np.sort(draw.integers(0, nodes, n)), draw.integers(0, 41, n).astype(np.uint8)
    bins[bins == 40] = B.MISSING
    rule = T.Rule("newton") if kind == "newton" else T.Rule("gini", 3)
    s = rule.expand(np.column_stack([np.ones(n), draw.integers(1, 4, n), draw.integers(0, 3, n)]).astype(float))
    if kind == "gini of mixed rows":
        s[:, 1:] = draw.integers(0, 5, (n, 3))
    seen = s if kind != "newton" else s[:, :3]
    rows = np.flatnonzero(draw.random(n) < 0.7)
    for which in (None, rows):
        own = np.arange(n) if which is None else rows
        at, values, sums = T.Sums(rule, s).of(node[own], bins[own], nodes, 40, which)
        want = {}
        for i in own:
            want.setdefault((node[i], bins[i]), []).append(seen[i])
        assert list(zip(at, values)) == sorted(want)
        assert np.array_equal(sums, [np.sum(want[k], axis=0) for k in sorted(want)])


def test_a_nodes_tree_is_sent_to_as_many_groups_as_its_cells_fill(table, monkeypatch):
    monkeypatch.setattr(T, "LOCAL", 100)
    monkeypatch.setattr(Fo, "MODEL", 10)
    monkeypatch.setattr(Fo, "SHARE", 200)                    # the table fills five groups, a node's cells one
    copies, routed_sums = [], Fo.routed_sums

    def one_row_for_each_tree(d, variants):
        def work(key, cells, tree):
            return pd.DataFrame({"block": [0] * len(tree), "part": [0] * len(tree), "member": [int(key[0])] * len(tree), "n": [0] * len(tree),
                                 "at": [b""] * len(tree), "data": [b""] * len(tree)})
        return work

    class Counted(Exception):
        pass

    def counted(*args):
        copies.append(routed_sums(*args).where("length(data) = 0").count())
        raise Counted
    model = Fo.fit_forest(table, FEATURES, "y", "DecisionTreeRegressor", "regression", {})
    monkeypatch.setattr(Fo, "_below", one_row_for_each_tree)
    monkeypatch.setattr(Fo, "routed_sums", counted)
    with pytest.raises(Counted):
        model.predict(table)
    nodes = sum(len(n) for n in model.grown.nodes)
    assert 5 < nodes and 0 < copies[0] <= nodes


def test_a_large_table_has_no_more_nodes_to_finish():
    binned = B.Binned(["a"], [], [], None, 300_000_000, 0.0, None, None)
    assert T.rows_of_a_task(binned) > T.LOCAL and T.rows_of_a_task(binned) <= T.MOST_LOCAL
    assert T.rows_of_a_task(B.Binned(["a"], [], [], None, 1000, 0.0, None, None)) == T.LOCAL


@pytest.mark.parametrize("rule", [T.Rule(random_cuts=True), T.Rule(random_cuts=True, min_rows=4, max_depth=7), T.Rule("gini", 3, random_cuts=True),
                                  T.Rule("gini", 3, random_cuts=True, max_features=2)])
@pytest.mark.parametrize("missing", [False, True])
def test_random_cuts_need_no_sums_of_bins(monkeypatch, rule, missing):
    draw = np.random.default_rng(3)
    n = 600
    bins = np.stack([draw.integers(0, 30, n), draw.integers(0, 2, n), draw.integers(0, 150, n)]).astype(np.uint8)
    if missing:
        bins[0, ::3], bins[1, ::5], bins[2, ::50] = T.MISSING, T.MISSING, T.MISSING
    stands, c, y = [np.sort(draw.normal(size=k)) for k in (30, 2, 150)], draw.integers(1, 3, n).astype(float), draw.normal(size=n) + bins[0] % 7
    s = rule.expand(np.column_stack([c, c, (y > 2) + (y > 4)] if rule.kind == "gini" else [c, c * y, c]))
    path, of = T.child_paths(T.root_path(1, 42), np.array([0, 1, 2])), np.sort(draw.integers(0, 3, n))
    starts = np.searchsorted(of, np.arange(3))
    total, sums, wide = np.add.reduceat(s, starts, axis=0), T.Sums(rule, s), s.shape[1] if rule.kind == "gini" else 3
    for f in range(3):
        a, b = T.Best(3), T.Best(3)
        T.judge_sums(a, f, *sums.of(of, bins[f], 3, 255, None), total[:, :wide], rule, path, stands[f])
        T.judge_random(b, f, np.arange(3), starts, of, bins[f], sums, total[:, :wide], rule, path, stands[f])
        assert all((getattr(a, k) == getattr(b, k)).all() for k in ("feature", "cut", "missing_left")) and np.allclose(a.gain, b.gain)

    def summed(*args):
        raise AssertionError("the sums of all bins are not needed")
    monkeypatch.setattr(T.Sums, "of", summed)
    assert len(T.grow_here(bins, s, rule, 0, T.root_path(0, 42), stands).feature) > 50
