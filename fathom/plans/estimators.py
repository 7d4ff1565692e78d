"""Estimators (M1-M24): ``fit(train, features, target, params) -> Fitted``.

``Fitted.predict(df)`` adds ``prediction`` (a double for regression, the
original class value for classification) and stays lazy.

* Linear models and naive Bayes are fitted from one distributed aggregate
  (means, covariances, per-class moments); only a d x d system is solved on
  the driver and prediction is a JVM-side column expression.
* Trees and forests (``forest``), gradient boosting (``boosting``) and AdaBoost (``adaboost``) are grown
  level by level over one binned table; logistic regressions (``logistic``) share
  passes over blocks; linear SVM and the MLP are Spark ML estimators with
  scikit-learn's defaults passed explicitly.
* k-nearest neighbours (``knn``) is exact over pivot cells.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fathom.bundle import quote
from fathom.session import written

#: Columns whose moments are single aggregates.
NARROW = 10
FIT_PARTITIONS, FIT_ROWS = 16, 1_000_000   # least partitions of a tree fit, and most rows of one


# ------------------------------------------------------------------ helpers
def _x(c: str) -> Column:
    return F.col(c).cast("double")


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))


class Fitted:
    name: str
    task: str
    note: str | None = None

    def predict(self, df: DataFrame) -> DataFrame:   # pragma: no cover - interface
        raise NotImplementedError


# ------------------------------------------------------------------ linear, closed form
@dataclass
class LinearFitted(Fitted):
    name: str
    task: str
    features: list
    coef: np.ndarray
    intercept: float
    note: str | None = None

    def expression(self) -> Column:
        e = F.lit(float(self.intercept))
        for f, b in zip(self.features, self.coef):
            e = e + F.lit(float(b)) * _x(f)
        return e

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.expression())


def _complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """The rows that have a value in every one of ``cols``, as doubles."""
    rows = df.select(*[_x(c).alias(f"x{i}") for i, c in enumerate(cols)])
    return rows.where(" and ".join(f"x{i} is not null and not isnan(x{i})" for i in range(len(cols))))


def _gram_parts(d: int):
    """(fold, x0 .. x{d-1}) -> for each fold of a partition and each column i: count, mean, and row i of the centred products."""
    def work(batches):
        kept = {}
        for b in batches:
            for fold, g in b.groupby("fold"):
                x = g[[f"x{i}" for i in range(d)]].to_numpy(float)
                n, mean = len(x), x.mean(axis=0)
                kept[fold] = _pooled(kept.get(fold), (n, mean, (x - mean).T @ (x - mean)))
        rows = [(fold, i, n, mean.tolist(), m[i].tolist()) for fold, (n, mean, m) in kept.items() for i in range(d)]
        yield pd.DataFrame(rows, columns=["fold", "i", "n", "mean", "row"])
    return work


def _pooled(a, b):
    if a is None:
        return b
    (n, mean, m), (k, other, o) = a, b
    gap = other - mean
    return n + k, mean + gap * (k / (n + k)), m + o + np.outer(gap, gap) * (n * k / (n + k))


def _gram_rows(d: int):
    """Parts of one row of a fold's products -> the row over all partitions."""
    def work(key, parts):
        n, mean, row = 0, np.zeros(d), np.zeros(d)
        for p in parts.sort_values(["n", "row"], key=lambda c: c if c.name == "n" else c.map(tuple)).itertuples():
            gap, total = np.asarray(p.mean) - mean, n + p.n
            row = row + np.asarray(p.row) + gap[key[1]] * gap * (n * p.n / total)
            n, mean = total, mean + gap * (p.n / total)
        return pd.DataFrame({"fold": [key[0]], "i": [key[1]], "n": [n], "mean": [mean.tolist()], "row": [row.tolist()]})
    return work


def fold_moments(df: DataFrame, cols: list[str], fold: Column | None = None) -> dict:
    """Per fold ``{"n", "mean", "cov"}`` (population covariance) of the complete rows of ``cols``, for any number of columns.

    Up to NARROW columns they are aggregates of Spark's own. Beyond, each partition
    sums one matrix of centred products; its rows are merged by
    (fold, column), so no task holds more than the parts of one row and only
    the merged matrices reach the driver."""
    d = len(cols)
    rows = _complete(df.withColumn("__fold", F.lit(0) if fold is None else fold), ["__fold", *cols])
    rows = rows.select(F.col("x0").cast("int").alias("fold"), *[F.col(f"x{i + 1}").alias(f"x{i}") for i in range(d)])
    if d <= NARROW:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        found = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)],
                                         *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect()      # one row for each fold
        narrow = {}
        for r in found:
            cov = np.zeros((d, d))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
            narrow[r.fold] = {"n": int(r.n), "mean": np.array([r[f"m{i}"] for i in range(d)]), "cov": cov}
        return narrow
    part = "fold int, i int, n bigint, mean array<double>, row array<double>"
    merged = rows.mapInPandas(_gram_parts(d), part).groupBy("fold", "i").applyInPandas(_gram_rows(d), part).collect()
    out: dict = {}
    for r in merged:
        m = out.setdefault(r.fold, {"n": int(r.n), "mean": np.array(r.mean), "cov": np.zeros((d, d))})
        m["cov"][r.i] = np.array(r.row) / r.n
    for m in out.values():
        m["cov"] = (m["cov"] + m["cov"].T) / 2
    return out


def linear_moments(df: DataFrame, features: list[str], target: str) -> dict:
    """n, means, population covariances of (X, y) over the complete rows, sample std of y."""
    d = len(features)
    return target_last(fold_moments(df, [*features, target]).get(0, {"n": 0, "mean": np.zeros(d + 1), "cov": np.zeros((d + 1, d + 1))}))


def target_last(m: dict) -> dict:
    """The moments of ``linear_moments`` from those of (X, y)."""
    d = len(m["mean"]) - 1
    vy = float(m["cov"][d, d])
    return {"n": m["n"], "my": float(m["mean"][d]), "vy": vy, "sy": math.sqrt(vy * m["n"] / (m["n"] - 1)) if m["n"] > 1 else 0.0,
            "mx": m["mean"][:d], "cxx": m["cov"][:d, :d], "cxy": m["cov"][:d, d]}


def _coordinate_descent(cxx, cxy, l1, l2, tol=1e-12, max_iter=100_000):
    """min_b 0.5 b'Cb - c'b + l1 |b|_1 + 0.5 l2 |b|^2 on the covariance (Gram / n)."""
    d = len(cxy)
    b = np.zeros(d)
    for _ in range(max_iter):
        delta = 0.0
        for j in range(d):
            if cxx[j, j] + l2 == 0:
                continue
            rho = cxy[j] - cxx[j] @ b + cxx[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (cxx[j, j] + l2)
            delta = max(delta, abs(new - b[j]))
            b[j] = new
        if delta < tol:
            break
    return b


def fit_linear(df: DataFrame, features: list[str], target: str, kind: str, params: dict, moments: dict | None = None) -> LinearFitted:
    """M5-M9 from one aggregate pass (none with the ``moments`` of ``linear_moments``).

    ols: least squares (minimum-norm on rank deficiency); ridge: (nC + a I) b = n c;
    lasso / elasticnet: coordinate descent on the covariance for scikit-learn's
    objective 1/(2n)|r|^2 + a*l1|b|_1 + a*(1-l1)/2 |b|^2; sgd: the optimum of
    squared loss + alpha/2 |w|^2 that SGD approaches (ridge with a = alpha * n).
    """
    m = moments or linear_moments(df, features, target)
    n, cxx, cxy = m["n"], m["cxx"], m["cxy"]
    d = len(features)
    if kind == "ols":
        b = np.linalg.lstsq(cxx, cxy, rcond=None)[0] if d else np.zeros(0)
    elif kind in ("ridge", "sgd"):
        alpha = float(params.get("alpha", 1.0 if kind == "ridge" else 1e-4))
        a = alpha if kind == "ridge" else alpha * n
        b = np.linalg.solve(n * cxx + a * np.eye(d), n * cxy) if d else np.zeros(0)
    elif kind == "lasso":
        b = _coordinate_descent(cxx, cxy, float(params.get("alpha", 1.0)), 0.0)
    elif kind == "elasticnet":
        a, r = float(params.get("alpha", 1.0)), float(params.get("l1_ratio", 0.5))
        b = _coordinate_descent(cxx, cxy, a * r, a * (1 - r))
    else:
        raise ValueError(kind)
    intercept = (m["my"] or 0.0) - float(m["mx"] @ b) if d else (m["my"] or 0.0)
    return LinearFitted(kind, "regression", list(features), b, intercept)


# ------------------------------------------------------------------ naive Bayes, closed form
@dataclass
class ScoredClassifier(Fitted):
    """argmax over per-class score expressions; ties go to the smallest class."""
    name: str
    task: str
    classes: list
    scores: list            # Column per class
    label_type: T.DataType
    note: str | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        scores = F.array(*self.scores)
        idx = F.array_position(scores, F.array_max(scores))      # first maximum: smallest class
        pick = F.element_at(F.array(*[F.lit(c) for c in self.classes]), idx.cast("int"))
        return df.withColumn("prediction", pick.cast(self.label_type))


def _class_list(df: DataFrame, target: str) -> list:
    return sorted(r[0] for r in df.select(target).distinct().where(F.col(target).isNotNull()).collect())


def fit_gaussian_nb(df: DataFrame, features: list[str], target: str, params: dict) -> ScoredClassifier:
    """Per-class mean and population variance (+ 1e-9 x the largest feature variance)."""
    smoothing = float(params.get("var_smoothing", 1e-9))
    per = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"),
                                 *[F.avg(_x(f)).alias(f"m{i}") for i, f in enumerate(features)],
                                 *[F.var_pop(_x(f)).alias(f"v{i}") for i, f in enumerate(features)])
    groups = per.collect()                                                   # one row per class
    rows = sorted((r for r in groups if r[target] is not None), key=lambda r: r[target])
    total = sum(r["n"] for r in rows)
    # variance of each feature over all rows, merged exactly from the class moments
    glob = []
    for i in range(len(features)):
        parts = [(r["n"], r[f"m{i}"], r[f"v{i}"]) for r in groups if r[f"m{i}"] is not None]
        n_all = sum(n for n, _, _ in parts)
        mean = sum(n * m for n, m, _ in parts) / n_all if n_all else 0.0
        glob.append(sum(n * (v + (m - mean) ** 2) for n, m, v in parts) / n_all if n_all else 0.0)
    eps = smoothing * max(glob + [0.0])
    scores = []
    for r in rows:
        s = F.lit(math.log(r["n"] / total))
        for i, f in enumerate(features):
            var = (r[f"v{i}"] or 0.0) + eps
            if var == 0:          # every feature is constant: only the prior tells
                continue
            s = s - F.lit(0.5 * math.log(2 * math.pi * var)) - (_x(f) - F.lit(r[f"m{i}"])) ** 2 / F.lit(2 * var)
        scores.append(s)
    return ScoredClassifier("GaussianNB", "classification", [r[target] for r in rows], scores,
                            df.schema[target].dataType)


def fit_bernoulli_nb(df: DataFrame, features: list[str], target: str, params: dict) -> ScoredClassifier:
    """Features binarised at ``binarize`` (0.0), Laplace smoothing ``alpha`` (1.0)."""
    thr, alpha = float(params.get("binarize", 0.0)), float(params.get("alpha", 1.0))
    xb = {f: (_x(f) > thr).cast("double") for f in features}
    per = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"),
                                 *[F.sum(xb[f]).alias(f"s{i}") for i, f in enumerate(features)])
    rows = sorted(per.where(F.col(target).isNotNull()).collect(), key=lambda r: r[target])
    total = sum(r["n"] for r in rows)
    scores = []
    for r in rows:
        s = F.lit(math.log(r["n"] / total))
        for i, f in enumerate(features):
            p = ((r[f"s{i}"] or 0.0) + alpha) / (r["n"] + 2 * alpha)
            s = s + xb[f] * F.lit(math.log(p)) + (F.lit(1.0) - xb[f]) * F.lit(math.log(1 - p))
        scores.append(s)
    return ScoredClassifier("BernoulliNB", "classification", [r[target] for r in rows], scores,
                            df.schema[target].dataType)


# ------------------------------------------------------------------ Spark ML wrappers
@dataclass
class SparkMLFitted(Fitted):
    name: str
    task: str
    model: object
    label_type: T.DataType | None = None
    classes: list = field(default_factory=list)
    note: str | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        cols = df.columns
        out = self.model.transform(df)
        if self.task == "classification":
            back = F.create_map(*[x for i, c in enumerate(self.classes) for x in (F.lit(float(i)), F.lit(c))])
            out = out.withColumn("prediction", back[F.col("prediction")].cast(self.label_type))
        return out.select(*cols, "prediction")


def _mem_mb(text: str | None, default: int) -> int:
    if not text:
        return default
    t = text.strip().lower()
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    if t[-1] == "b":
        t = t[:-1]
    return int(float(t[:-1]) * units[t[-1]]) if t[-1] in units else int(t)   # no unit: MiB


def tree_memory_mb(spark) -> int:
    """Histogram budget per tree-learning task: ~30% of an executor heap shared by its
    concurrent tasks, between 64 and 1024 MB (each task allocates the whole budget)."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    heap = _mem_mb(conf.get("spark.driver.memory" if local else "spark.executor.memory", None), 1024)
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    return int(max(64, min(1024, 0.3 * heap / max(cores, 1))))


def spark_estimator(name: str, params: dict, n: int, n_classes: int):
    """Spark ML estimator with scikit-learn's defaults for ``name``; features 'features', label 'label', weight 'weight'."""
    from pyspark.ml import classification as C
    columns = dict(featuresCol="features", labelCol="label", weightCol="weight")
    if name in ("SVC", "SGDClassifier"):
        reg = 1.0 / (float(params.get("C", 1.0)) * n) if name == "SVC" else float(params.get("alpha", 1e-4))
        # scikit-learn iterates until its tolerance; Spark's OWLQN also stops after 100 rounds
        iters = int(params["max_iter"]) if int(params.get("max_iter", -1)) > 0 else 100
        # scikit-learn's SVC and SGDClassifier stop at tol=1e-3
        svm = C.LinearSVC(regParam=reg, standardization=False, maxIter=iters, tol=float(params.get("tol", 1e-3)),
                          **columns)
        return svm if n_classes <= 2 else C.OneVsRest(classifier=svm, parallelism=min(n_classes, 8), **columns)
    raise KeyError(name)


def counted_rows(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The distinct rows with a target and their number ``weight``, dealt by their values.

    Equal rows, however many, are one row with a weight, so no task gets more than its share; a fit depends
    neither on cores nor on the layout of the input."""
    rows = df.where(F.col(quote(target)).isNotNull()).groupBy(*[quote(c) for c in features], quote(target)).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = written(rows, "counted")
    n = max(FIT_PARTITIONS, math.ceil(rows.count() / FIT_ROWS))
    by = [quote(c) for c in (*features, target)]
    return rows.repartition(n, *by).sortWithinPartitions(*by)


def fit_spark_ml(df: DataFrame, features: list[str], target: str, name: str, params: dict) -> SparkMLFitted:
    """Assemble features and fit the Spark ML classifier of ``name``.

    Class labels are indexed in ascending class order from the distinct
    classes (one row per class) and mapped back with a literal map, so
    prediction needs no label column.
    """
    from pyspark import StorageLevel
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    data = counted_rows(df, features, target)
    if name == "MLPClassifier":
        # no weights there: every row by itself, dealt by its values and its number among equal ones
        data = data.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
        by = [quote(c) for c in (*features, target)]
        data = data.repartition(max(FIT_PARTITIONS, data.rdd.getNumPartitions()), *by, "__i").sortWithinPartitions(*by, "__i").drop("__i")
    # Spark ML reads its input once for each iteration
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classes = _class_list(data, target)
        to_index = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
        k, n = len(classes), int(data.agg(F.sum("weight")).first()[0] or 0)
        data = data.withColumn("label", to_index[F.col(quote(target))])
        if name == "MLPClassifier":
            from pyspark.ml.classification import MultilayerPerceptronClassifier
            est = MultilayerPerceptronClassifier(layers=[len(features), 100, max(k, 2)], maxIter=int(params.get("max_iter", 200)), seed=42,
                                                 featuresCol="features", labelCol="label")
        else:
            est = spark_estimator(name, params, n, k)
        return SparkMLFitted(name, "classification", Pipeline(stages=[assembler, est]).fit(data), df.schema[target].dataType, classes=classes)
    finally:
        data.unpersist()


# ------------------------------------------------------------------ dispatch
LINEAR_KIND = {"LinearRegression": "ols", "Ridge": "ridge", "Lasso": "lasso", "ElasticNet": "elasticnet",
               "SGDRegressor": "sgd"}


def fit(df: DataFrame, features: list[str], target: str, name: str, task: str, params: dict | None = None, key: list[str] | None = None) -> Fitted:
    """Fit model ``name`` for ``task``; T11 fallback for names Spark cannot fit.

    ``key`` names columns that identify a row, from which tree samples are drawn; without them rows are known by their values."""
    from fathom.plans.adaboost import fit_adaboost
    from fathom.plans.boosting import fit_boosting
    from fathom.plans.forest import KINDS, fit_forest
    from fathom.plans.knn import fit_knn
    from fathom.plans.logistic import fit_logistic
    from fathom.plans.registry_models import resolve_estimator_name
    params = dict(params or {})
    actual, note = resolve_estimator_name(name, task)
    if actual == "SVC" and params.get("kernel", "rbf") == "rbf":
        note = "SVC kernel 'rbf' has no distributed solver; fitted with the linear kernel"
    if actual in LINEAR_KIND:
        m = fit_linear(df, features, target, LINEAR_KIND[actual], params)
    elif actual == "GaussianNB":
        m = fit_gaussian_nb(df, features, target, params)
    elif actual == "BernoulliNB":
        m = fit_bernoulli_nb(df, features, target, params)
    elif actual in ("KNeighborsRegressor", "KNeighborsClassifier"):
        m = fit_knn(df, features, target, task, params)
    elif actual in ("AdaBoostRegressor", "AdaBoostClassifier"):
        m = fit_adaboost(df, features, target, task, params, key)
    elif actual.startswith(("GradientBoosting", "XGB", "LGBM", "CatBoost")):
        m = fit_boosting(df, features, target, actual, task, params)
    elif actual == "LogisticRegression":
        m = fit_logistic(df, features, target, params)
    elif actual in KINDS:
        m = fit_forest(df, features, target, actual, task, params, key)
    else:
        m = fit_spark_ml(df, features, target, actual, params)
    m.note = note or getattr(m, "note", None)
    m.name = actual
    return m


# workers get the functions above by value, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
