"""Registered queries for search and composite runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.bundle import Bundle, DatasetRoles
from fathom.operators import prepare as P
from fathom.operators import splits as T
from fathom.plans import inputs as I
from fathom.plans import search as S
from fathom.plans.catalog import register, table
from fathom.plans.runner import compare_models, run_pipeline, run_tasks
from fathom.session import written

LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _linepart_bundle(spark, sf) -> Bundle:
    d, enc = P.label_encode(I.linepart(spark, sf), I.LINEPART_FEATURES)
    roles = DatasetRoles(tuple(I.LINEPART_FEATURES), "l_extendedprice", {}, "lineitem+part", "line items with part attributes")
    # the split passes over its input several times: join and encode once
    return Bundle(written(d, "linepart"), roles, enc)


@register("T7_cv_score_linear")
def t7_cv_score_linear(spark, sf):
    """5-fold CV R2 of the default Ridge grid on line items: one grouped moment pass for all 20 fits."""
    b = _linepart_bundle(spark, sf)
    data = written(T.split_and_folds(b.df, LI_KEYS), "split")
    train = data.where(F.col("split") == "train")
    combos = list(enumerate(S.expand_grid(S.param_grid("Ridge", "regression"))))
    return S.scores_frame(spark, S.cv_score(train, b.features, b.target, "Ridge", "regression", combos))


@register("T7_cv_score_logistic")
def t7_cv_score_logistic(spark, sf):
    """Stratified 5-fold CV accuracy of the default LogisticRegression grid on the embeddings."""
    e = table(spark, sf, "embeddings")
    dims = [f"e{i}" for i in range(64)]
    wide = e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    data = T.split_and_folds(wide, ["vec_id"], "label")
    train = data.where(F.col("split") == "train")
    combos = list(enumerate(S.expand_grid(S.param_grid("LogisticRegression", "classification"))))
    return S.scores_frame(spark, S.cv_score(train, dims, "label", "LogisticRegression", "classification", combos))


@register("T8_select_best_refit")
def t8_select_best_refit(spark, sf):
    """Best Lasso alpha by CV (ties to the earliest), refitted on all train rows: its coefficients."""
    b = _linepart_bundle(spark, sf)
    data = written(T.split_and_folds(b.df, LI_KEYS), "split")
    train = data.where(F.col("split") == "train")
    model, best, _ = S.search(train, b.features, b.target, "Lasso", "regression", S.param_grid("Lasso", "regression"))
    rows = [("alpha", float(best["params"]["alpha"]))] + [("intercept", float(model.intercept))] + \
        [(f, float(c)) for f, c in zip(model.features, model.coef)]
    return spark.createDataFrame(rows, "term string, value double")


@register("X1_run_pipeline")
def x1_run_pipeline(spark, sf):
    """Whole run on line items: metadata, profile, Ridge with CV grid search, test metrics, verdict."""
    b = _linepart_bundle(spark, sf)
    r = run_pipeline(spark, {}, task="regression", key=LI_KEYS, fixed_model="Ridge", bundle=b)
    return r.interpretation


@register("X2_run_tasks")
def x2_run_tasks(spark, sf):
    """Two tasks on one table of labelled documents: quality (classification), n_chars (regression)."""
    d = I.docs(spark, sf)
    d, _ = P.label_encode(d, ["lang", "source"])
    cfg = {"df": d, "path": "documents", "features": ["lang", "source", "n_chars"]}
    return run_tasks(spark, cfg, [
        {"target": "quality", "task": "classification", "options": {"fixed_model": "GaussianNB", "key": ["doc_id"]}},
        {"target": "n_chars", "task": "regression",
         "options": {"fixed_model": "LinearRegression", "key": ["doc_id"]}}])


@register("X3_compare_models")
def x3_compare_models(spark, sf):
    """Five linear models scored on the same line-item split, best first."""
    b = _linepart_bundle(spark, sf)
    return compare_models(spark, b, ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "SGDRegressor"],
                          "regression", LI_KEYS)
