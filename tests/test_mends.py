"""Cases that earlier versions got wrong."""
import numpy as np
import pandas as pd
import pytest

from fathom.operators import evaluate as E
from fathom.operators import prepare as P
from fathom.operators import profile as D
from fathom.operators import replies as L
from fathom.plans import estimators as M
from fathom.plans import search as S
from fathom.plans.runner import RunResult, run_stage
from fathom.sources.csv import csv_source
from fathom.sources.sinks import csv_sink


def test_quoted_csv_reads_as_pandas(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,a.b,x\n1,"say ""hi"", you",10d\n2,"two\nlines",0x1p3\n3,plain,1.5\n')
    got = csv_source(spark, str(path)).toPandas()
    want = pd.read_csv(path)
    assert got.sort_values("id").astype(str).values.tolist() == want.astype(str).values.tolist()
    out = str(tmp_path / "out")
    csv_sink(csv_source(spark, str(path)).coalesce(1), out)
    part = next((tmp_path / "out").glob("*.csv"))
    assert pd.read_csv(part).astype(str).values.tolist() == want.astype(str).values.tolist()


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("10d",), ("3f",), ("0x1p3",), (" 1.5e3 ",), ("-.5",), ("7.",), ("nan",), (None,)], "`v.w` string")
    assert sorted(r.x for r in D.coerce_numeric(df, "v.w").collect()) == [-0.5, 7.0, 1500.0]


def test_dotted_names_in_drop_missing(spark):
    kept, counts = P.drop_missing(spark.createDataFrame([(1, None), (2, "x")], "`a.b` int, c string"))
    assert kept.count() == 1 and tuple(counts.first()) == (2, 1, 1)


def test_confusion_matrix_of_many_classes(spark):
    df = spark.range(300).selectExpr("cast(id as string) as y_true", "cast(id + 1 as string) as y_pred")
    cm = E.confusion_matrix(df)
    assert cm.count() == 301 * 301 and cm.agg({"n": "sum"}).first()[0] == 300


def test_linear_models_of_many_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 300))
    beta = rng.normal(size=300)
    names = [f"f{i}" for i in range(300)]
    pdf = pd.DataFrame(x, columns=names).assign(y=x @ beta + 2.0)
    df = spark.createDataFrame(pdf).repartition(5)
    ols = M.fit(df, names, "y", "LinearRegression", "regression")
    assert np.allclose(ols.coef, beta, atol=1e-8) and abs(ols.intercept - 2.0) < 1e-8
    ridge = M.fit(df, names, "y", "Ridge", "regression", {"alpha": 3.0})
    c = x - x.mean(0)
    assert np.allclose(ridge.coef, np.linalg.solve(c.T @ c + 3 * np.eye(300), c.T @ (pdf.y - pdf.y.mean())), atol=1e-8)


def test_rows_without_target_take_no_part(spark):
    rows = [(1.0, 1.0), (2.0, 3.0), (3.0, 4.0), (9.0, None), (None, 5.0), (20.0, float("nan"))]
    m = M.fit(spark.createDataFrame(rows, "x double, y double"), ["x"], "y", "LinearRegression", "regression")
    b, a = np.polyfit([1, 2, 3], [1, 3, 4], 1)
    assert abs(m.coef[0] - b) < 1e-12 and abs(m.intercept - a) < 1e-12


def test_gaussian_nb_of_constant_features_is_the_prior(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (1.0, "b")], "x double, y string")
    got = M.fit(df, ["x"], "y", "GaussianNB", "classification").predict(df)
    assert {r.prediction for r in got.collect()} == {"b"}


def test_svc_search_has_linear_kernels_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "cv_score", lambda *a, **k: seen.extend(a[5]) or [{"combo_id": i, "params": p, "mean_score": 0.0, "std_score": 0.0} for i, p in a[5]])
    monkeypatch.setattr(M, "fit", lambda *a, **k: None)
    S.search(spark.range(1).selectExpr("1 as x", "1 as y", "0 as fold"), ["x"], "y", "SVC", "classification", {"C": [1.0, 2.0], "kernel": ["rbf", "linear"]})
    assert [p["kernel"] for _, p in seen] == ["linear", "linear"]


@pytest.mark.parametrize("reply, reason", [
    ('[{"model_name": "Ridge", "reason": "a", "reason": "b"}]', "b"),
    ('[{"model_name": "Ridge", "score": NaN, "low": -Infinity, "reason": "is NaN \\"Infinity\\""}]', 'is NaN "Infinity"')])
def test_replies_that_python_reads(spark, reply, reason):
    full = reply.replace('"reason"', '"package": "sklearn", "reason"', 1)
    rows = L.suggestions(spark.createDataFrame([(1, full)], "id long, response string")).collect()
    assert [(r.model_name, r.reason) for r in rows] == [("Ridge", reason)]


def test_histograms_of_every_feature(spark):
    names = [f"c{i}" for i in range(9)]
    df = spark.range(20).selectExpr(*[f"id * {i + 1} as {n}" for i, n in enumerate(names)])
    assert {r.column for r in D.feature_histograms(df, names, 5).select("column").distinct().collect()} == set(names)


def test_stand_ins_are_labelled(spark):
    df = spark.range(40).selectExpr("cast(id as double) as x", "cast(id * 2 as double) as y")
    assert "best-first" in M.fit(df, ["x"], "y", "LGBMRegressor", "regression", {"n_estimators": 2}).note


def test_a_stage_without_its_inputs_changes_nothing():
    res = RunResult()
    assert run_stage("evaluate", None, res) is res and run_stage("unknown", None, res) is res
