import pytest

from fathom.operators import evaluate as E


def preds(spark, rows, typ="double"):
    return spark.createDataFrame(rows, f"y_true {typ}, y_pred {typ}")


def test_regression_metrics_basic(spark):
    r = E.regression_metrics(preds(spark, [(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)])).first()
    assert r["MSE"] == pytest.approx(round((0.25 + 0 + 1) / 3, 4))
    assert r["MAE"] == pytest.approx(0.5)
    assert r["R2"] == pytest.approx(round(1 - (1.25 / 3) / (2 / 3), 4))


def test_regression_metrics_constant_target(spark):
    assert E.regression_metrics(preds(spark, [(2.0, 2.0), (2.0, 2.0)])).first()["R2"] == 1.0
    assert E.regression_metrics(preds(spark, [(2.0, 2.0), (2.0, 3.0)])).first()["R2"] == 0.0
    assert E.regression_metrics(preds(spark, [(2.0, 2.0)])).first()["R2"] is None


def test_macro_metrics_include_class_only_in_predictions(spark):
    p = preds(spark, [("a", "a"), ("a", "c"), ("b", "b"), ("b", "a")], "string")
    r = E.classification_metrics(p).first()
    # classes a, b, c: precision (1/2, 1, 0), recall (1/2, 1/2, 0)
    assert r["accuracy"] == 0.5
    assert r["precision"] == pytest.approx(round((0.5 + 1 + 0) / 3, 4))
    assert r["recall"] == pytest.approx(round((0.5 + 0.5 + 0) / 3, 4))
    f1 = (0.5 + 2 * 1 * 0.5 / 1.5 + 0) / 3
    assert r["f1"] == pytest.approx(round(f1, 4))


def test_confusion_matrix_has_zeros(spark):
    p = preds(spark, [("a", "a"), ("a", "c"), ("b", "b")], "string")
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in E.confusion_matrix(p).collect()}
    assert len(cm) == 9 and cm[("a", "c")] == 1 and cm[("c", "c")] == 0


def test_verdict_levels(spark):
    m = spark.createDataFrame([(0.9, 1.0, 1.0, 1.0), (0.5, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)],
                              "R2 double, MSE double, RMSE double, MAE double")
    levels = [r["level"] for r in E.verdict(m, "Ridge").collect()]
    assert levels == ["good", "moderate", "limited"]
    text = E.verdict(m.limit(1), "Ridge").first()["verdict"].split("\n")
    assert text[0] == "Model: Ridge | Task: regression"
    assert text[1] == "Metrics: {'R2': 0.9, 'MSE': 1.0, 'RMSE': 1.0, 'MAE': 1.0}"


def test_ideal_range_and_density(spark):
    p = preds(spark, [(1.0, 0.5), (2.0, 4.0)])
    r = E.ideal_line_range(p).first()
    assert (r["lo"], r["hi"]) == (0.5, 4.0)
    d = E.residual_scatter_density(p, 4).collect()
    assert sum(x["n"] for x in d) == 4


def test_confusion_wide_form(spark):
    p = preds(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "string")
    rows = {r["y_true"]: (r["a"], r["b"]) for r in E.confusion_wide(p).collect()}
    assert rows == {"a": (1, 1), "b": (0, 2)}
