import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.plans import estimators as M
from fathom.plans import knn as N
from fathom.plans import search as S
from fathom.plans.registry_models import list_models, lookup, resolve_estimator_name

FEATS = ["Al_conc_wt_pct", "Ti_conc_wt_pct", "V_conc_wt_pct", "process_temperature_C", "process_time_h"]


def xy(alloy):
    pdf = alloy.toPandas()
    return pdf[FEATS].to_numpy(), pdf["hardness_HV"].to_numpy()


def test_ols_matches_golden(alloy):
    m = M.fit(alloy, FEATS, "hardness_HV", "LinearRegression", "regression")
    assert np.allclose(m.coef, [2.251645, 3.356491, 1.229568, 0.048682, -2.990683], atol=1e-6)
    assert m.intercept == pytest.approx(154.097147, abs=1e-6)
    from fathom.operators import evaluate as E
    pred = m.predict(alloy).select(F.col("hardness_HV").alias("y_true"), F.col("prediction").alias("y_pred"))
    r = E.regression_metrics(pred).first()
    assert (r["R2"], r["MSE"], r["MAE"]) == (0.8011, 26.8704, 4.0356)


def test_ridge_matches_numpy_closed_form(alloy):
    X, y = xy(alloy)
    Xc, yc = X - X.mean(0), y - y.mean()
    b = np.linalg.solve(Xc.T @ Xc + 10.0 * np.eye(5), Xc.T @ yc)
    m = M.fit(alloy, FEATS, "hardness_HV", "Ridge", "regression", {"alpha": 10.0})
    assert np.allclose(m.coef, b, atol=1e-9)


@pytest.mark.parametrize("name,params", [("Lasso", {"alpha": 0.5}), ("ElasticNet", {"alpha": 0.5, "l1_ratio": 0.5})])
def test_sparse_linear_models_satisfy_optimality(alloy, name, params):
    X, y = xy(alloy)
    n = len(y)
    m = M.fit(alloy, FEATS, "hardness_HV", name, "regression", params)
    l1 = params["alpha"] * params.get("l1_ratio", 1.0)
    l2 = params["alpha"] * (1 - params.get("l1_ratio", 1.0))
    r = y - X @ m.coef - m.intercept
    grad = -(X - X.mean(0)).T @ r / n + l2 * m.coef
    for g, b in zip(grad, m.coef):
        if b != 0:
            assert g + l1 * np.sign(b) == pytest.approx(0, abs=1e-6)
        else:
            assert abs(g) <= l1 + 1e-6


def test_gaussian_nb_matches_numpy(spark, alloy):
    df = alloy.withColumn("cls", (F.col("hardness_HV") > 175).cast("int"))
    X, _ = xy(alloy)
    y = df.select("cls").toPandas()["cls"].to_numpy()
    m = M.fit(df, FEATS, "cls", "GaussianNB", "classification")
    got = np.array([r["prediction"] for r in m.predict(df).select("prediction").collect()])
    eps = 1e-9 * X.var(0).max()
    scores = []
    for c in (0, 1):
        Xc = X[y == c]
        mu, var = Xc.mean(0), Xc.var(0) + eps
        s = np.log(len(Xc) / len(y)) - 0.5 * np.log(2 * np.pi * var).sum() - ((X - mu) ** 2 / (2 * var)).sum(1)
        scores.append(s)
    assert (got == np.argmax(np.vstack(scores), axis=0)).all()


def test_knn_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 37)   # several shards and blocks
    monkeypatch.setattr(N, "CELL_ROWS", 40)    # and cells
    rng = np.random.default_rng(0)
    tr = rng.normal(size=(150, 3))
    te = rng.normal(size=(60, 3))
    ytr = rng.integers(0, 3, size=150)
    train = spark.createDataFrame([(i, *map(float, tr[i]), int(ytr[i])) for i in range(150)], "id long, a double, b double, c double, y int")
    test = spark.createDataFrame([(1000 + i, *map(float, te[i]), 0) for i in range(60)], "id long, a double, b double, c double, y int")
    m = M.fit(train, ["a", "b", "c"], "y", "KNeighborsClassifier", "classification", {"id_col": "id"})
    got = {r["id"]: r["prediction"] for r in m.predict(test).collect()}
    mr = M.fit(train, ["a", "b", "c"], "y", "KNeighborsRegressor", "regression", {"id_col": "id"})
    got_r = {r["id"]: r["prediction"] for r in mr.predict(test).collect()}
    for i in range(60):
        d = np.sqrt(((tr - te[i]) ** 2).sum(1))
        nn = np.lexsort((np.arange(150), d))[:5]
        votes = np.bincount(ytr[nn], minlength=3)
        assert got[1000 + i] == int(np.argmax(votes))
        assert got_r[1000 + i] == pytest.approx(ytr[nn].mean())


def test_registry_and_fallback():
    assert len(list_models()) == 33
    assert len(list_models("regression")) == 17 and len(list_models("classification")) == 16
    assert lookup("XGBRegressor")[1] == "xgboost" and lookup("Nope") is None
    assert resolve_estimator_name("SVR", "regression")[0] == "RandomForestRegressor"


def test_grid_sizes_and_sampling():
    sizes = {m: len(S.expand_grid(g)) for m, g in S.DEFAULT_REGRESSION_GRIDS.items()}
    assert sizes == {"RandomForestRegressor": 24, "GradientBoostingRegressor": 8, "Ridge": 4, "Lasso": 4, "SVR": 6}
    assert len(S.expand_grid(S.DEFAULT_CLASSIFICATION_GRIDS["SVC"])) == 6
    assert S.param_grid("Ridge", "regression", tuning=False) == {}
    assert S.param_grid("Unknown", "regression") == {}
    combos = S.expand_grid(S.DEFAULT_REGRESSION_GRIDS["RandomForestRegressor"])
    picked = S.random_search_sample(combos, 20, 42)
    assert len(picked) == 20 and len({i for i, _ in picked}) == 20
    assert len(S.random_search_sample(S.expand_grid({"alpha": [1, 2]}), 20)) == 2
    assert S.select_best([{"combo_id": 0, "mean_score": 0.5}, {"combo_id": 1, "mean_score": 0.5}])["combo_id"] == 0


def test_cv_from_moments_equals_refits(spark, alloy):
    from fathom.operators import splits as T
    data = T.split_and_folds(alloy, alloy.columns)
    train = data.where("split = 'train'")
    combos = [(0, {"alpha": 0.1}), (1, {"alpha": 10.0})]
    fast = S.cv_linear(train, FEATS, "hardness_HV", "Ridge", combos)
    slow = []
    for cid, p in combos:
        sc = []
        for f in range(5):
            m = M.fit(train.where(F.col("fold") != f), FEATS, "hardness_HV", "Ridge", "regression", p)
            sc.append(S._score(m, train.where(F.col("fold") == f), "hardness_HV", "regression"))
        slow.append(np.mean(sc))
    assert [x["mean_score"] for x in fast] == pytest.approx(slow, abs=1e-9)


def test_spark_ml_classifier_returns_original_labels(spark, alloy):
    df = alloy.withColumn("cls", F.when(F.col("hardness_HV") > 175, "hard").otherwise("soft"))
    m = M.fit(df, FEATS, "cls", "DecisionTreeClassifier", "classification", {"max_depth": 3})
    vals = {r["prediction"] for r in m.predict(df).select("prediction").distinct().collect()}
    assert vals <= {"hard", "soft"}


@pytest.mark.parametrize("name", ["AdaBoostRegressor", "ExtraTreesRegressor"])
def test_regression_ensembles_learn(spark, alloy, name):
    from fathom.operators import evaluate as E
    m = M.fit(alloy, FEATS, "hardness_HV", name, "regression", {"n_estimators": 8})
    pred = m.predict(alloy).select(F.col("hardness_HV").alias("y_true"), F.col("prediction").alias("y_pred"))
    assert E.regression_metrics(pred).first()["R2"] > 0.3


@pytest.mark.parametrize("name", ["AdaBoostClassifier", "ExtraTreesClassifier"])
def test_classification_ensembles_vote(spark, alloy, name):
    df = alloy.withColumn("cls", F.when(F.col("hardness_HV") > 180, "hi").when(F.col("hardness_HV") > 170, "mid")
                          .otherwise("lo"))
    m = M.fit(df, FEATS, "cls", name, "classification", {"n_estimators": 8})
    out = m.predict(df)
    assert {r["prediction"] for r in out.select("prediction").distinct().collect()} <= {"hi", "mid", "lo"}
    acc = out.agg(F.avg((F.col("prediction") == F.col("cls")).cast("double"))).first()[0]
    assert acc > 0.4


def test_weighted_median_combination():
    from fathom.plans.adaboost import weighted_median
    values = np.array([[5.0], [1.0], [9.0]])
    assert weighted_median(values, np.array([1.0, 3.0, 1.0]))[0] == 1.0
    assert weighted_median(values, np.array([1.0, 1.0, 2.5]))[0] == 9.0


def test_forest_defaults_grow_deep_trees(alloy):
    from fathom.plans.forest import _depths
    m = M.fit(alloy, FEATS, "hardness_HV", "RandomForestRegressor", "regression", {"n_estimators": 5})
    assert m.predict(alloy).where("prediction is null").count() == 0 and len(m.trees) == 5
    assert max(_depths(t).max() for t in m.trees) > 8
    # every leaf is pure or holds one combination of bins
    for t in m.trees:
        assert (t.rows[t.feature < 0] < 2).mean() > 0.9


def test_generic_cv_runs_fits_in_threads(spark, alloy):
    from fathom.operators import splits as T
    df = alloy.withColumn("cls", (F.col("hardness_HV") > 175).cast("int"))
    data = T.split_and_folds(df, alloy.columns, label="cls")
    train = data.where("split = 'train'")
    combos = list(enumerate(S.expand_grid({"max_depth": [2, 3]})))
    scores = S.cv_score(train, FEATS, "cls", "DecisionTreeClassifier", "classification", combos, parallelism=2)
    assert [s["combo_id"] for s in scores] == [0, 1] and all(0 <= s["mean_score"] <= 1 for s in scores)


def test_tree_memory_budget_is_bounded(spark):
    assert M._mem_mb("16g", 0) == 16384 and M._mem_mb("512m", 0) == 512 and M._mem_mb("2048", 0) == 2048
    assert 64 <= M.tree_memory_mb(spark) <= 1024


def test_knn_visits_few_cells_of_clustered_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(25, 3)) * 50
    x = centres[draw.integers(0, 25, 2000)] + draw.normal(size=(2000, 3))
    q = centres[draw.integers(0, 25, 200)] + draw.normal(size=(200, 3))
    train = spark.createDataFrame([(i, *map(float, r), float(i % 7)) for i, r in enumerate(x)], "id long, a double, b double, c double, y double")
    model = M.fit(train, ["a", "b", "c"], "y", "KNeighborsRegressor", "regression", {"id_col": "id"})
    d = N.distances(q, model.pivots)
    first = N.first_cells(d, model.sizes, 5)
    true = np.sort(N.distances(q, x), axis=1)[:, 4]
    pairs = sum(model.sizes[f].sum() for f in first) + N.other_cells(d, true, model.radius, model.sizes).dot(model.sizes).sum()
    assert pairs < 0.2 * 2000 * 200
    test = spark.createDataFrame([(5000 + i, *map(float, r)) for i, r in enumerate(q)] + [(9999, None, 1.0, 1.0)], "id long, a double, b double, c double")
    got = {r.id: r.prediction for r in model.predict(test).collect()}
    near = np.argsort(N.distances(q, x), axis=1, kind="stable")[:, :5]
    assert all(got[5000 + i] == pytest.approx((near[i] % 7).mean()) for i in range(200)) and got[9999] is None


def test_moments_are_the_same_for_narrow_and_wide_tables(alloy, monkeypatch):
    fold = F.col("process_time_h") > 4
    one = M.fold_moments(alloy, [*FEATS, "hardness_HV"], fold)
    monkeypatch.setattr(M, "NARROW", 0)
    other = M.fold_moments(alloy, [*FEATS, "hardness_HV"], fold)
    assert set(one) == set(other) and len(one) == 2
    for f in one:
        assert one[f]["n"] == other[f]["n"] and np.allclose(one[f]["mean"], other[f]["mean"]) and np.allclose(one[f]["cov"], other[f]["cov"])


@pytest.mark.parametrize("name, grid", [("Ridge", {"alpha": [0.1, 100.0]}), ("Lasso", {"alpha": [0.01, 1.0]})])
def test_a_linear_search_passes_over_its_rows_once(spark, monkeypatch, name, grid):
    rows = spark.range(400).selectExpr("cast(id as double) as a", "cast(pmod(id * 7, 11) as double) as b", "cast(id % 5 as int) as fold") \
        .selectExpr("*", "3 * a - 2 * b + pmod(cast(a as int) * 13, 7) as y")
    passes, moments = [], M.fold_moments
    monkeypatch.setattr(M, "fold_moments", lambda *a: passes.append(a) or moments(*a))
    model, best, scores = S.search(rows, ["a", "b"], "y", name, "regression", grid)
    assert len(passes) == 1 and scores.count() == 2
    whole = M.fit(rows, ["a", "b"], "y", name, "regression", best["params"])
    assert np.allclose(model.coef, whole.coef, rtol=1e-9) and np.isclose(model.intercept, whole.intercept, rtol=1e-9)
    assert S.cv_score(rows, ["a", "b"], "y", name, "regression", list(enumerate(S.expand_grid(grid))))[best["combo_id"]] == best


def test_nearest_rows_by_products_are_those_of_all_distances(monkeypatch):
    draw = np.random.default_rng(8)
    b = np.concatenate([draw.normal(size=(300, 16)) + 1000, np.repeat(draw.normal(size=(4, 16)) + 1000, 50, axis=0)])
    a = np.concatenate([b[::25], draw.normal(size=(20, 16)) + 1000])
    every = N.distances(a, b)
    want = np.argsort(every, axis=1, kind="stable")[:, :5]
    for bound in (np.full(len(a), np.inf), np.take_along_axis(every, want, 1)[:, 4]):
        i, j, d = N.near_pairs(a, b, 5, bound)
        assert (j.reshape(len(a), 5) == want).all() and (d == every[i, j]).all()
    i, j, d = N.near_pairs(np.array([[1e200, 0.0]]), np.array([[-1e200, 0.0], [0.0, 0.0]]), 2, np.array([np.inf]))
    assert sorted(j.tolist()) == [0, 1]


def test_knn_measures_few_of_all_pairs(monkeypatch):
    draw, measured = np.random.default_rng(9), []
    rows = pd.DataFrame({"rid": np.arange(4000), "vec": list(draw.normal(size=(4000, 16))), "far": 0.0, "y": 0})
    queries = pd.DataFrame({"qid": np.arange(300), "vec": list(draw.normal(size=(300, 16))), "q_far": 0.0, "bound": np.inf})
    whole = N.distances
    monkeypatch.setattr(N, "distances", lambda a, b: measured.append(len(a) * len(b)) or whole(a, b))
    found = N._nearest(5)(queries, rows)
    assert len(found) == 1500 and sum(measured) < 0.1 * 300 * 4000
