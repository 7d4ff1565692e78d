"""Parameter grids and cross-validated search.

Grids are small configuration (a few dozen combinations); they are
expanded on the driver in scikit-learn's order (keys sorted, cartesian
product). Each (combination, fold) fit is a distributed Spark job over the
cached train rows; up to ``parallelism`` of them run at once.

Linear models take a shortcut with the same result: the per-fold moments
(count, means, covariances) come from one ``groupBy(fold)`` aggregate, the
moments of every "all folds but f" are merged on the driver, and every
combination x fold is solved and scored from moments alone — one pass over
the data for the whole search.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from fathom.plans import estimators as M
from fathom.plans.boosting import cv_boosting
from fathom.plans.forest import KINDS, NESTED, cv_forest
from fathom.plans.logistic import cv_logistic
from fathom.plans.registry_models import resolve_estimator_name

# Default grids of the reference, per task and model.
DEFAULT_REGRESSION_GRIDS = {
    "RandomForestRegressor": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15, None],
                              "min_samples_split": [2, 5]},
    "GradientBoostingRegressor": {"n_estimators": [50, 100], "max_depth": [3, 5], "learning_rate": [0.01, 0.1]},
    "Ridge": {"alpha": [0.01, 0.1, 1.0, 10.0]},
    "Lasso": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "SVR": {"C": [0.1, 1.0, 10.0], "kernel": ["rbf", "linear"]},
}
DEFAULT_CLASSIFICATION_GRIDS = {
    "RandomForestClassifier": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15, None],
                               "min_samples_split": [2, 5]},
    "LogisticRegression": {"C": [0.01, 0.1, 1.0, 10.0], "max_iter": [1000]},
    "SVC": {"C": [0.1, 1.0, 10.0], "kernel": ["rbf", "linear"]},
}
CV_FOLDS = 5
N_ITER = 20


# ------------------------------------------------------------------ T4, T5, T6
def param_grid(model: str, task: str, user_grid: dict | None = None, tuning: bool = True) -> dict:
    """T4: tuning off -> {}; a user grid wins; else the default of (task, model); unknown -> {}."""
    if not tuning:
        return {}
    if user_grid:
        return dict(user_grid)
    grids = DEFAULT_CLASSIFICATION_GRIDS if task == "classification" else DEFAULT_REGRESSION_GRIDS
    return dict(grids.get(model, {}))


def expand_grid(grid: dict) -> list[dict]:
    """T5: every combination, keys in sorted order (scikit-learn's ParameterGrid order)."""
    if not grid:
        return [{}]
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def random_search_sample(combos: list[dict], n_iter: int = N_ITER, seed: int = 42) -> list[tuple[int, dict]]:
    """min(n_iter, size) combinations without replacement, ordered by md5(combo_id|seed)."""
    keyed = sorted(range(len(combos)), key=lambda i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest())
    return [(i, combos[i]) for i in keyed[:min(n_iter, len(combos))]]


# ------------------------------------------------------------------ T7 generic
def _score(model, held: DataFrame, target: str, task: str) -> float:
    pred = model.predict(held).select(F.col(target).alias("y_true"), F.col("prediction").alias("y_pred"))
    if task == "classification":
        r = pred.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("s")).first()
        return float(r["s"] or 0.0)
    # unrounded r2 for ranking
    r = pred.agg(F.avg((F.col("y_true") - F.col("y_pred")) ** 2).alias("mse"), F.var_pop("y_true").alias("v")).first()
    if not r["v"]:
        return 1.0 if (r["mse"] or 0) == 0 else 0.0
    return 1.0 - r["mse"] / r["v"]


def cv_score(train: DataFrame, features: list[str], target: str, name: str, task: str,
             combos: list[tuple[int, dict]], k: int = CV_FOLDS, parallelism: int = 2, key: list[str] | None = None) -> list[dict]:
    """Mean held-out score (r2 / accuracy) per combination over the ``fold`` column.

    Linear models are scored from moments, forests from one forest for all folds and combinations, boosting with
    all folds in the same rounds, logistic regressions all in the same passes; other models by a fit for each combination and fold."""
    if name in M.LINEAR_KIND:
        return cv_linear(train, features, target, name, combos, k)
    if name in KINDS and all(set(p) <= set(NESTED) for _, p in combos):
        return cv_forest(train, features, target, name, task, combos, k, key)
    if name == "LogisticRegression" and all(set(p) <= {"C", "max_iter", "tol", "random_state"} for _, p in combos):
        return cv_logistic(train, features, target, combos, k)
    if name.startswith(("GradientBoosting", "XGB", "LGBM", "CatBoost")):
        return cv_boosting(train, features, target, name, task, combos, k)
    data = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        jobs = [(cid, params, f) for cid, params in combos for f in range(k)]

        def run(job):
            cid, params, f = job
            model = M.fit(data.where(F.col("fold") != f), features, target, name, task, params)
            return cid, f, _score(model, data.where(F.col("fold") == f), target, task)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            results = list(ex.map(run, jobs))
    finally:
        data.unpersist()
    out = []
    for cid, params in combos:
        scores = [s for c, _, s in results if c == cid]
        out.append({"combo_id": cid, "params": params, "mean_score": float(np.mean(scores)),
                    "std_score": float(np.std(scores))})
    return out


# ------------------------------------------------------------------ T7 linear, from moments
def _fold_moments(train: DataFrame, features: list[str], target: str, k: int) -> list[dict]:
    found = M.fold_moments(train, features + [target], F.col("fold"))
    return [found[f] for f in range(k)]


def _merge(parts: list[dict]) -> dict:
    """Pooled count, mean and population covariance of several groups (exact)."""
    n = sum(p["n"] for p in parts)
    mean = sum(p["n"] * p["mean"] for p in parts) / n
    cov = sum(p["n"] * (p["cov"] + np.outer(p["mean"] - mean, p["mean"] - mean)) for p in parts) / n
    return {"n": n, "mean": mean, "cov": cov}


def _solve(kind: str, m: dict, params: dict) -> tuple[np.ndarray, float]:
    d = len(m["mean"]) - 1
    cxx, cxy, n = m["cov"][:d, :d], m["cov"][:d, d], m["n"]
    if kind == "ols":
        b = np.linalg.lstsq(cxx, cxy, rcond=None)[0]
    elif kind in ("ridge", "sgd"):
        alpha = float(params.get("alpha", 1.0 if kind == "ridge" else 1e-4))
        a = alpha if kind == "ridge" else alpha * n
        b = np.linalg.solve(n * cxx + a * np.eye(d), n * cxy)
    elif kind == "lasso":
        b = M._coordinate_descent(cxx, cxy, float(params.get("alpha", 1.0)), 0.0)
    else:
        a, r = float(params.get("alpha", 1.0)), float(params.get("l1_ratio", 0.5))
        b = M._coordinate_descent(cxx, cxy, a * r, a * (1 - r))
    return b, float(m["mean"][d] - m["mean"][:d] @ b)


def _r2_on(m: dict, b: np.ndarray, b0: float) -> float:
    d = len(b)
    cxx, cxy, vy = m["cov"][:d, :d], m["cov"][:d, d], m["cov"][d, d]
    resid_var = vy - 2 * b @ cxy + b @ cxx @ b
    bias = m["mean"][d] - b0 - m["mean"][:d] @ b
    mse = resid_var + bias * bias
    if vy == 0:
        return 1.0 if mse == 0 else 0.0
    return 1.0 - mse / vy


def cv_linear(train: DataFrame, features: list[str], target: str, name: str,
              combos: list[tuple[int, dict]], k: int = CV_FOLDS) -> list[dict]:
    """T7 for linear models: one grouped aggregate, then every fit and score from moments."""
    return _scored(M.LINEAR_KIND[name], _fold_moments(train, features, target, k), combos, k)


def _scored(kind: str, folds: list[dict], combos: list[tuple[int, dict]], k: int) -> list[dict]:
    out = []
    for cid, params in combos:
        scores = []
        for f in range(k):
            fit_m = _merge([folds[g] for g in range(k) if g != f])
            b, b0 = _solve(kind, fit_m, params)
            scores.append(_r2_on(folds[f], b, b0))
        out.append({"combo_id": cid, "params": params, "mean_score": float(np.mean(scores)),
                    "std_score": float(np.std(scores))})
    return out


# ------------------------------------------------------------------ T8, T9
def select_best(scores: list[dict]) -> dict:
    """Highest mean score; ties go to the earliest combination."""
    return sorted(scores, key=lambda s: (-round(s["mean_score"], 12), s["combo_id"]))[0]


def scores_frame(spark, scores: list[dict]) -> DataFrame:
    rows = [(s["combo_id"], json.dumps(s["params"], sort_keys=True, default=str), s["mean_score"], s["std_score"])
            for s in scores]
    df = spark.createDataFrame(rows, "combo_id int, params string, mean_score double, std_score double")
    from pyspark.sql import Window
    w = Window.orderBy(F.col("mean_score").desc(), F.col("combo_id"))   # one row per combination
    return df.withColumn("rank", F.rank().over(w))


def search(train: DataFrame, features: list[str], target: str, name: str, task: str,
           grid: dict, randomized: bool = False, n_iter: int = N_ITER, seed: int = 42,
           parallelism: int = 2, key: list[str] | None = None):
    """(fitted model on all train rows, best combination, score table).

    ``train`` carries the ``fold`` column (T2/T3). An empty grid fits the
    library defaults once (T9).
    """
    spark = train.sparkSession
    if not grid:
        return M.fit(train, features, target, name, task, {}, key), None, None
    combos = list(enumerate(expand_grid(grid)))
    if name == "SVC":        # only the linear kernel is fitted; the others would repeat its scores
        combos = [(i, dict(c, kernel="linear")) for i, c in combos if c.get("kernel", "linear") == "linear"] or combos[:1]
    if randomized:
        combos = random_search_sample([c for _, c in combos], n_iter, seed)
    if name in M.LINEAR_KIND and resolve_estimator_name(name, task) == (name, None):
        # the fit on all rows follows from the folds' moments too: one pass for search and refit
        kind, folds = M.LINEAR_KIND[name], _fold_moments(train, features, target, CV_FOLDS)
        scores = _scored(kind, folds, combos, CV_FOLDS)
        best = select_best(scores)
        model = M.fit_linear(train, features, target, kind, best["params"], M.target_last(_merge(folds)))
        return model, best, scores_frame(spark, scores)
    scores = cv_score(train, features, target, name, task, combos, parallelism=parallelism, key=key)
    best = select_best(scores)
    model = M.fit(train, features, target, name, task, best["params"], key)
    return model, best, scores_frame(spark, scores)
