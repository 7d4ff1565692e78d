"""Evaluation (E1-E7) over a prediction table ``(..., y_true, y_pred)``.

Each metric is one grouped aggregate; classification metrics start from
the confusion counts (one ``groupBy(y_true, y_pred)``, at most classes²
rows), so nothing row-sized reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions.stats import numeric_text, py_round

# Verdict bands and texts of the reference.
GOOD_ACCURACY, MODERATE_ACCURACY = 0.85, 0.65
GOOD_R2, MODERATE_R2 = 0.7, 0.4
CLASSIFICATION_LINES = (
    "Performance: good. High accuracy suggests the model generalizes well.",
    "Performance: moderate. Consider feature engineering or trying other models.",
    "Performance: limited. Try more features, class balance, or different algorithms.",
    "Suggestion: try hyperparameter tuning (GridSearchCV) or ensemble methods.",
)
REGRESSION_LINES = (
    "Performance: good. R2 indicates strong predictive capability.",
    "Performance: moderate. RMSE reflects typical prediction error.",
    "Performance: limited. Consider more features or nonlinear models.",
    "Suggestion: try feature selection or regularization (Ridge/Lasso).",
)


# ------------------------------------------------------------------ E1
def regression_metrics(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., n, R2, MSE, RMSE, MAE)`` rounded to 4 places.

    R2 = 1 - MSE / var_pop(y); constant y gives 1 when every residual is 0,
    else 0; fewer than two rows give null R2.
    """
    by = by or []
    y, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    g = pred.groupBy(*by) if by else pred
    a = g.agg(F.count(F.lit(1)).alias("n"), F.avg((y - p) * (y - p)).alias("mse"),
              F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("vy"))
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
           .when(F.col("vy") == 0, F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(F.lit(1.0) - F.col("mse") / F.col("vy")))
    return a.select(*by, "n", py_round(r2, 4).alias("R2"), F.round("mse", 4).alias("MSE"),
                    F.round(F.sqrt("mse"), 4).alias("RMSE"), F.round("mae", 4).alias("MAE"))


# ------------------------------------------------------------------ E2, E3
def confusion_counts(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return (pred.groupBy(*by, F.col("y_true").cast("string").alias("t"), F.col("y_pred").cast("string").alias("p"))
                .agg(F.count(F.lit(1)).alias("n")))


def per_class_report(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """E3 per class over the union of true and predicted classes:
    ``(by..., class, support, tp, precision, recall, f1)``; zero division -> 0."""
    by = by or []
    cm = confusion_counts(pred, by)
    # each (true, predicted) cell adds to its true class's support, its predicted
    # class's count and, on the diagonal, to tp: one aggregation over the cells
    parts = cm.select(*by, F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("tp")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("c")).select(*by, "c.*")
    rep = parts.groupBy(*by, "class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                          F.sum("tp").alias("tp"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return rep.select(*by, "class", F.col("support").cast("bigint").alias("support"),
                      F.col("tp").cast("bigint").alias("tp"), prec.alias("precision"),
                      rec.alias("recall"), f1.alias("f1"))


def classification_metrics(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., n, accuracy, precision, recall, f1)`` — macro over the class union, 4 places."""
    by = by or []
    rep = per_class_report(pred, by)
    a = rep.groupBy(*by).agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                             F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                             F.avg("f1").alias("f1"))
    return a.select(*by, F.col("n").cast("bigint").alias("n"),
                    F.round(F.col("tp") / F.col("n"), 4).alias("accuracy"),
                    F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"),
                    F.round("f1", 4).alias("f1"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """``(y_true, y_pred, n)`` for every pair of classes in the union, zeros included."""
    cm = confusion_counts(pred)
    classes = cm.select(F.col("t").alias("c")).union(cm.select(F.col("p").alias("c"))).distinct()
    # the matrix is classes x classes by definition; both sides are lists of classes, not rows
    grid = classes.select(F.col("c").alias("y_true")).crossJoin(classes.select(F.col("c").alias("y_pred")))
    return (grid.join(cm.select(F.col("t").alias("y_true"), F.col("p").alias("y_pred"), "n"),
                      ["y_true", "y_pred"], "left")
                .select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_wide(pred: DataFrame) -> DataFrame:
    """E3 wide form: one row per true class, one column per predicted class."""
    cm = confusion_matrix(pred)
    return cm.groupBy("y_true").pivot("y_pred").agg(F.first("n")).orderBy("y_true")


# ------------------------------------------------------------------ E4, E5, E7
def residuals(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys..., y_true, y_pred, residual = y_true - y_pred)``."""
    return pred.select(*(keys or []), "y_true", "y_pred",
                       (F.col("y_true") - F.col("y_pred")).alias("residual"))


def ideal_line_range(pred: DataFrame) -> DataFrame:
    """E5: ``(lo, hi)`` over both y_true and y_pred."""
    a = pred.agg(F.min("y_true").alias("a"), F.min("y_pred").alias("b"),
                 F.max("y_true").alias("c"), F.max("y_pred").alias("d"))
    return a.select(F.least("a", "b").cast("double").alias("lo"), F.greatest("c", "d").cast("double").alias("hi"))


def _bin2(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    w = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.least(F.floor((x - lo) / w * F.lit(float(bins))), F.lit(bins - 1)).cast("int")


def residual_scatter_density(pred: DataFrame, bins: int = 20) -> DataFrame:
    """2-D bin counts of the two scatter plots (raw points never reach the driver).

    ``(plot, bx, by, n)`` for 'actual_vs_predicted' (x = y_true, y = y_pred)
    and 'residual_vs_predicted' (x = y_pred, y = residual); non-empty cells.
    """
    r = pred.select(F.col("y_true").cast("double").alias("t"), F.col("y_pred").cast("double").alias("p"))
    r = r.withColumn("e", F.col("t") - F.col("p"))
    # One-row aggregate read back as six scalars: the binning map stage gets literals.
    g = r.agg(F.min("t").alias("tl"), F.max("t").alias("th"), F.min("p").alias("pl"),
              F.max("p").alias("ph"), F.min("e").alias("el"), F.max("e").alias("eh")).first()
    lit = {k: F.lit(g[k]).cast("double") for k in ("tl", "th", "pl", "ph", "el", "eh")}
    a = r.select(F.lit("actual_vs_predicted").alias("plot"),
                 _bin2(F.col("t"), lit["tl"], lit["th"], bins).alias("bx"),
                 _bin2(F.col("p"), lit["pl"], lit["ph"], bins).alias("by"))
    b = r.select(F.lit("residual_vs_predicted").alias("plot"),
                 _bin2(F.col("p"), lit["pl"], lit["ph"], bins).alias("bx"),
                 _bin2(F.col("e"), lit["el"], lit["eh"], bins).alias("by"))
    return a.unionByName(b).groupBy("plot", "bx", "by").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ E6
def _metrics_repr(names: list[str]) -> Column:
    parts = []
    for i, n in enumerate(names):
        parts += [F.lit(("" if i == 0 else ", ") + f"'{n}': "),
                  F.coalesce(numeric_text(F.col(n), 4), F.lit("nan"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def verdict(metrics: DataFrame, model_name: Column | str, task: str = "regression") -> DataFrame:
    """The rule-based interpretation text per metrics row.

    A missing metric counts as 0. Works on any number of metric rows (one
    per model or group) at once.
    """
    name = F.lit(model_name) if isinstance(model_name, str) else model_name
    if task == "classification":
        key, good, mod, lines, names = "accuracy", GOOD_ACCURACY, MODERATE_ACCURACY, CLASSIFICATION_LINES, \
            ["accuracy", "precision", "recall", "f1"]
    else:
        key, good, mod, lines, names = "R2", GOOD_R2, MODERATE_R2, REGRESSION_LINES, ["R2", "MSE", "RMSE", "MAE"]
    v = F.coalesce(F.col(key), F.lit(0.0))
    level = F.when(v >= good, "good").when(v >= mod, "moderate").otherwise("limited")
    perf = F.when(v >= good, lines[0]).when(v >= mod, lines[1]).otherwise(lines[2])
    text = F.concat_ws("\n", F.concat(F.lit("Model: "), name, F.lit(f" | Task: {task}")),
                       F.concat(F.lit("Metrics: "), _metrics_repr(names)), perf, F.lit(lines[3]))
    return metrics.withColumn("level", level).withColumn("verdict", text)
