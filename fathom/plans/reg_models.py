"""Registered queries for estimators, prediction and evaluation (M, T10, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import evaluate as E
from fathom.operators import splits as T
from fathom.plans import estimators as M
from fathom.plans import inputs as I
from fathom.plans.catalog import register, table
from fathom.session import written

LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]   # unique row key


def li_split(spark, sf):
    """lineitem with the T1 split column (seed 42, 20 % test)."""
    li = table(spark, sf, "lineitem").select(*LI_KEYS, "l_quantity", "l_discount", "l_tax", "l_extendedprice",
                                             "l_returnflag", "l_linestatus")
    return T.train_test_split(li, LI_KEYS, 0.2, 42)


LI_SPLIT_SQL = """
with o as (select *, l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey as k from lineitem),
h as (select *, md5(k || '|42') as h from o),
r as (select *, row_number() over (order by h, k) - 1 as rk, count(*) over () as n from h),
sp as (select *, case when rk < ceil(0.2::double * n)::bigint then 'test' else 'train' end as split from r)"""


def _predict_test(spark, sf, name, features, target, params=None, task="regression"):
    s = li_split(spark, sf)
    model = M.fit(s.where("split = 'train'"), features, target, name, task, params)
    test = s.where("split = 'test'")
    return model.predict(test).select(*LI_KEYS, F.col(target).alias("y_true"), F.col("prediction").alias("y_pred"))


# ------------------------------------------------------------------ T10 + E on 1-feature OLS
def ols_predictions(spark, sf):
    return _predict_test(spark, sf, "LinearRegression", ["l_quantity"], "l_extendedprice")


OLS_PRED_SQL = LI_SPLIT_SQL + """,
m as (select regr_intercept(l_extendedprice, l_quantity) as a, regr_slope(l_extendedprice, l_quantity) as b
      from sp where split = 'train'),
pred as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice as y_true, a + b * l_quantity as y_pred
         from sp, m where split = 'test')"""


@register("T10_batch_predict", OLS_PRED_SQL + """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, y_true, round(y_pred, 4) as y_pred from pred""")
def t10_batch_predict(spark, sf):
    """Least-squares fit of l_extendedprice on l_quantity (train rows), predicted on test rows."""
    p = ols_predictions(spark, sf)
    return p.select(*LI_KEYS, "y_true", F.round("y_pred", 4).alias("y_pred"))


_E1_SQL = """
select count(*) as n,
       round(case when count(*) < 2 then null
                  when var_pop(y_true) = 0 then (case when avg((y_true - y_pred) ^ 2) = 0 then 1.0 else 0.0 end)
                  else 1 - avg((y_true - y_pred) ^ 2) / var_pop(y_true) end, 4) as R2,
       round(avg((y_true - y_pred) ^ 2), 4) as MSE, round(sqrt(avg((y_true - y_pred) ^ 2)), 4) as RMSE,
       round(avg(abs(y_true - y_pred)), 4) as MAE"""


@register("E1_regression_metrics", OLS_PRED_SQL + _E1_SQL + " from pred")
def e1_regression_metrics(spark, sf):
    """R2, MSE, RMSE, MAE of the least-squares predictions on the test rows."""
    return E.regression_metrics(ols_predictions(spark, sf))


@register("E1_regression_metrics_by_flag", OLS_PRED_SQL.replace(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice as y_true",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice as y_true") + _E1_SQL.replace(
    "select count(*) as n", "select l_returnflag, count(*) as n") + " from pred group by l_returnflag")
def e1_regression_metrics_by_flag(spark, sf):
    """Regression metrics per return flag, one grouped aggregate."""
    s = li_split(spark, sf)
    model = M.fit(s.where("split = 'train'"), ["l_quantity"], "l_extendedprice", "LinearRegression", "regression")
    p = model.predict(s.where("split = 'test'")).select(
        "l_returnflag", F.col("l_extendedprice").alias("y_true"), F.col("prediction").alias("y_pred"))
    return E.regression_metrics(p, ["l_returnflag"])


@register("E4_residuals", OLS_PRED_SQL + """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, y_true, round(y_pred, 4) as y_pred, round(y_true - y_pred, 4) as residual from pred""")
def e4_residuals(spark, sf):
    """Residuals y_true - y_pred of the test rows."""
    r = E.residuals(ols_predictions(spark, sf), LI_KEYS)
    return r.select(*LI_KEYS, "y_true", F.round("y_pred", 4).alias("y_pred"), F.round("residual", 4).alias("residual"))


@register("E5_ideal_line_range", OLS_PRED_SQL + """
select round(least(min(y_true), min(y_pred)), 4) as lo, round(greatest(max(y_true), max(y_pred)), 4) as hi from pred""")
def e5_ideal_line_range(spark, sf):
    """Range of the ideal line over actual and predicted values."""
    r = E.ideal_line_range(ols_predictions(spark, sf))
    return r.select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def _num_sql(x: str, d: int) -> str:
    r = f"round(({x})::double, {d})"
    return (f"case when {r} is null then 'nan' when isnan({r}) then 'nan' else "
            f"regexp_replace(regexp_replace(printf('%.{d}f', {r}), '0+$', ''), '\\.$', '.0') end")


@register("E6_verdict_regression", OLS_PRED_SQL + """,
met as (""" + _E1_SQL + """ from pred)
select n, R2, MSE, RMSE, MAE,
       case when R2 >= 0.7 then 'good' when R2 >= 0.4 then 'moderate' else 'limited' end as level,
       'Model: LinearRegression | Task: regression' || chr(10) ||
       'Metrics: {''R2'': ' || """ + _num_sql("R2", 4) + """ || ', ''MSE'': ' || """ + _num_sql("MSE", 4) + """ ||
       ', ''RMSE'': ' || """ + _num_sql("RMSE", 4) + """ || ', ''MAE'': ' || """ + _num_sql("MAE", 4) + """ || '}' || chr(10) ||
       case when coalesce(R2, 0) >= 0.7 then 'Performance: good. R2 indicates strong predictive capability.'
            when coalesce(R2, 0) >= 0.4 then 'Performance: moderate. RMSE reflects typical prediction error.'
            else 'Performance: limited. Consider more features or nonlinear models.' end || chr(10) ||
       'Suggestion: try feature selection or regularization (Ridge/Lasso).' as verdict
from met""")
def e6_verdict_regression(spark, sf):
    """Rule-based interpretation of the regression metrics."""
    return E.verdict(E.regression_metrics(ols_predictions(spark, sf)), "LinearRegression", "regression")


@register("E7_residual_scatter_density", OLS_PRED_SQL + """,
e as (select y_true as t, y_pred as p, y_true - y_pred as e from pred),
rg as (select min(t) tl, max(t) th, min(p) pl, max(p) ph, min(e) el, max(e) eh from e),
b as (select 'actual_vs_predicted' as plot,
             least(floor((t - tl) / (case when th > tl then th - tl else 1.0 end) * 20.0), 19)::integer as bx,
             least(floor((p - pl) / (case when ph > pl then ph - pl else 1.0 end) * 20.0), 19)::integer as "by"
      from e, rg
      union all
      select 'residual_vs_predicted',
             least(floor((p - pl) / (case when ph > pl then ph - pl else 1.0 end) * 20.0), 19)::integer,
             least(floor((e - el) / (case when eh > el then eh - el else 1.0 end) * 20.0), 19)::integer
      from e, rg)
select plot, bx, "by", count(*) as n from b group by all""")
def e7_residual_scatter_density(spark, sf):
    """20 x 20 cell counts of the predicted-vs-actual and residual scatters."""
    return E.residual_scatter_density(ols_predictions(spark, sf), 20)


# ------------------------------------------------------------------ M8, M5: coefficients
def _coef_sql(alpha: float | str | None) -> str:
    a = 0.0 if alpha is None else alpha   # a number, or SQL over the train moments (n)
    return LI_SPLIT_SQL + f""",
m as (select count(*)::double as n, avg(l_quantity) as m1, avg(l_discount) as m2, avg(l_extendedprice) as my,
             covar_pop(l_quantity, l_quantity) as s11, covar_pop(l_quantity, l_discount) as s12,
             covar_pop(l_discount, l_discount) as s22, covar_pop(l_quantity, l_extendedprice) as s1y,
             covar_pop(l_discount, l_extendedprice) as s2y from sp where split = 'train'),
a as (select n * s11 + {a} as a11, n * s12 as a12, n * s22 + {a} as a22, n * s1y as c1, n * s2y as c2,
             m1, m2, my from m),
b as (select (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) as b1,
             (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) as b2, m1, m2, my from a)
select 'intercept' as term, round(my - b1 * m1 - b2 * m2, 6) as coef from b
union all select 'l_quantity', round(b1, 6) from b
union all select 'l_discount', round(b2, 6) from b"""


def _coef_frame(spark, model):
    rows = [("intercept", float(model.intercept))] + [(f, float(b)) for f, b in zip(model.features, model.coef)]
    return spark.createDataFrame(rows, "term string, coef double").select("term", F.round("coef", 6).alias("coef"))


@register("M8_linear_regression", _coef_sql(None))
def m8_linear_regression(spark, sf):
    """Least squares of l_extendedprice on (l_quantity, l_discount): one covariance aggregate."""
    s = li_split(spark, sf).where("split = 'train'")
    return _coef_frame(spark, M.fit(s, ["l_quantity", "l_discount"], "l_extendedprice", "LinearRegression",
                                    "regression"))


@register("M5_ridge", _coef_sql(1.0))
def m5_ridge(spark, sf):
    """Ridge (alpha = 1, unpenalised intercept) on the same two features."""
    s = li_split(spark, sf).where("split = 'train'")
    return _coef_frame(spark, M.fit(s, ["l_quantity", "l_discount"], "l_extendedprice", "Ridge", "regression",
                                    {"alpha": 1.0}))


@register("M6_lasso")
def m6_lasso(spark, sf):
    """Lasso (alpha = 1) coefficients by coordinate descent on the covariance aggregate."""
    s = li_split(spark, sf).where("split = 'train'")
    return _coef_frame(spark, M.fit(s, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "Lasso",
                                    "regression", {"alpha": 1.0}))


@register("M7_elastic_net")
def m7_elastic_net(spark, sf):
    """ElasticNet (alpha = 1, l1_ratio = 0.5) coefficients."""
    s = li_split(spark, sf).where("split = 'train'")
    return _coef_frame(spark, M.fit(s, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "ElasticNet",
                                    "regression", {"alpha": 1.0, "l1_ratio": 0.5}))


@register("M9_sgd_regressor", _coef_sql("0.0001 * n"))
def m9_sgd_regressor(spark, sf):
    """Optimum of squared loss + L2 (alpha 1e-4) that SGD approaches: ridge with alpha * n."""
    s = li_split(spark, sf).where("split = 'train'")
    return _coef_frame(spark, M.fit(s, ["l_quantity", "l_discount"], "l_extendedprice", "SGDRegressor",
                                    "regression"))


# ------------------------------------------------------------------ M23, M24 + E2, E3
NB_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def gnb_predictions(spark, sf):
    return _predict_test(spark, sf, "GaussianNB", NB_FEATURES, "l_returnflag", task="classification")


def _gnb_sql() -> str:
    feats = NB_FEATURES
    per = ", ".join(f"avg({f}) as m{i}, var_pop({f}) as v{i}" for i, f in enumerate(feats))
    glob = "greatest(" + ", ".join(f"var_pop({f})" for f in feats) + ")"
    score = " ".join(f"- 0.5 * ln(2 * pi() * (c.v{i} + g.eps)) - (t.{f} - c.m{i}) ^ 2 / (2 * (c.v{i} + g.eps))"
                     for i, f in enumerate(feats))
    return LI_SPLIT_SQL + f""",
tr as (select * from sp where split = 'train'),
c as (select l_returnflag as cls, count(*) as cn, {per} from tr group by 1),
g as (select 1e-9 * {glob} as eps, count(*) as total from tr),
te as (select * from sp where split = 'test'),
sc as (select t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.l_returnflag as y_true, c.cls,
              ln(c.cn / g.total) {score} as s
       from te t, c, g),
best as (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey order by s desc, cls) as r from sc)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, y_true, cls as y_pred from best where r = 1"""


GNB_SQL = _gnb_sql()


@register("M23_gaussian_nb", GNB_SQL)
def m23_gaussian_nb(spark, sf):
    """Gaussian naive Bayes for l_returnflag from three numeric columns, predicted on test rows."""
    return gnb_predictions(spark, sf)


def _bnb_sql() -> str:
    feats = ["l_discount", "l_tax"]
    per = ", ".join(f"sum(({f} > 0)::double) as s{i}" for i, f in enumerate(feats))
    score = " ".join(
        f"+ (t.{f} > 0)::double * ln((c.s{i} + 1) / (c.cn + 2)) + (1 - (t.{f} > 0)::double) * ln(1 - (c.s{i} + 1) / (c.cn + 2))"
        for i, f in enumerate(feats))
    return LI_SPLIT_SQL + f""",
tr as (select * from sp where split = 'train'),
c as (select l_returnflag as cls, count(*)::double as cn, {per} from tr group by 1),
g as (select count(*)::double as total from tr),
te as (select * from sp where split = 'test'),
sc as (select t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.l_returnflag as y_true, c.cls, ln(c.cn / g.total) {score} as s
       from te t, c, g),
best as (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey order by s desc, cls) as r from sc)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, y_true, cls as y_pred from best where r = 1"""


@register("M24_bernoulli_nb", _bnb_sql())
def m24_bernoulli_nb(spark, sf):
    """Bernoulli naive Bayes (features binarised at 0, Laplace 1) for l_returnflag."""
    return _predict_test(spark, sf, "BernoulliNB", ["l_discount", "l_tax"], "l_returnflag", task="classification")


@register("E2_classification_metrics", GNB_SQL.replace("select l_orderkey, l_linenumber, l_partkey, l_suppkey, y_true, cls as y_pred from best where r = 1", """,
pred as (select y_true, cls as y_pred from best where r = 1),
cls as (select y_true as c from pred union select y_pred from pred),
per as (select c, (select count(*) from pred where y_true = c and y_pred = c) as tp,
               (select count(*) from pred where y_pred = c) as np, (select count(*) from pred where y_true = c) as nt
        from cls),
pr as (select c, tp, case when np > 0 then tp / np else 0.0 end as p, case when nt > 0 then tp / nt else 0.0 end as r from per)
select (select count(*) from pred) as n, round(sum(tp) / (select count(*) from pred), 4) as accuracy,
       round(avg(p), 4) as precision, round(avg(r), 4) as recall,
       round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 4) as f1
from pr"""))
def e2_classification_metrics(spark, sf):
    """Accuracy and macro precision / recall / F1 of the Gaussian NB predictions."""
    return E.classification_metrics(gnb_predictions(spark, sf))


@register("E3_confusion_matrix", GNB_SQL.replace("select l_orderkey, l_linenumber, l_partkey, l_suppkey, y_true, cls as y_pred from best where r = 1", """,
pred as (select y_true, cls as y_pred from best where r = 1),
cls as (select y_true as c from pred union select y_pred from pred)
select a.c as y_true, b.c as y_pred, (select count(*) from pred where pred.y_true = a.c and pred.y_pred = b.c) as n
from cls a, cls b"""))
def e3_confusion_matrix(spark, sf):
    """Confusion counts over the union of classes, zeros included."""
    return E.confusion_matrix(gnb_predictions(spark, sf))


# ------------------------------------------------------------------ M11, M15: exact kNN
EMB_SPLIT_SQL = """
with o as (select vec_id, embedding::double[] as v, label, cast(vec_id as varchar) as k from embeddings),
h as (select *, md5(k || '|42') as h from o),
r as (select *, row_number() over (order by h, k) - 1 as rk, count(*) over () as n from h),
sp as (select *, case when rk < ceil(0.2::double * n)::bigint then 'test' else 'train' end as split from r),
pairs as (select q.vec_id, q.label as y_true, t.label as y, t.rid,
                 list_distance(q.v, t.v) as d
          from (select * from sp where split = 'test') q,
               (select *, vec_id as rid from sp where split = 'train') t),
nn as (select *, row_number() over (partition by vec_id order by d, rid) as r from pairs)"""


def emb_split(spark, sf):
    e = table(spark, sf, "embeddings")
    return T.train_test_split(e, ["vec_id"], 0.2, 42)


def _knn(spark, sf, task):
    s = emb_split(spark, sf)
    train = s.where("split = 'train'")
    model = M.fit(train, ["embedding"], "label", "KNeighborsRegressor" if task == "regression"
                  else "KNeighborsClassifier", task, {"id_col": "vec_id"})
    return model.predict(s.where("split = 'test'")).select("vec_id", F.col("label").alias("y_true"),
                                                          F.col("prediction").alias("y_pred"))


@register("M15_knn_classifier", EMB_SPLIT_SQL + """,
votes as (select vec_id, y_true, y, count(*) as v from nn where r <= 5 group by all),
best as (select *, row_number() over (partition by vec_id order by v desc, y) as rr from votes)
select vec_id, y_true, y as y_pred from best where rr = 1""")
def m15_knn_classifier(spark, sf):
    """5-nearest-neighbour vote over 64-d embeddings (distance ties to the smaller id, vote ties to the smaller class)."""
    return _knn(spark, sf, "classification")


@register("M11_knn_regressor", EMB_SPLIT_SQL + """
select vec_id, y_true, round(avg(y::double), 6) as y_pred from nn where r <= 5 group by all""")
def m11_knn_regressor(spark, sf):
    """Mean label of the 5 nearest embeddings."""
    p = _knn(spark, sf, "regression")
    return p.select("vec_id", "y_true", F.round("y_pred", 6).alias("y_pred"))


# ------------------------------------------------------------------ models with a rows check
def _reg(name, params=None):
    def q(spark, sf):
        d = I.linepart(spark, sf)
        from fathom.operators.prepare import label_encode
        d, _ = label_encode(d, I.LINEPART_FEATURES)
        # the split passes over its input several times: join and encode once
        s = T.train_test_split(written(d, "linepart"), LI_KEYS, 0.2, 42)
        m = M.fit(s.where("split = 'train'"), I.LINEPART_FEATURES, "l_extendedprice", name, "regression", params, LI_KEYS)
        return m.predict(s.where("split = 'test'")).select(
            *LI_KEYS, F.col("l_extendedprice").alias("y_true"), F.col("prediction").alias("y_pred"))
    q.__doc__ = f"{name} on line items with part attributes (label-encoded flags), predicted on test rows."
    return q


def _clf(name, params=None):
    def q(spark, sf):
        s = emb_split(spark, sf)
        dims = [f"e{i}" for i in range(64)]
        wide = s.select("vec_id", "label", "split", *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                                                      for i in range(64)])
        m = M.fit(wide.where("split = 'train'"), dims, "label", name, "classification", params, ["vec_id"])
        return m.predict(wide.where("split = 'test'")).select(
            "vec_id", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
    q.__doc__ = f"{name} over the 64 embedding dimensions, predicted on test rows."
    return q


for _id, _name, _p in [("M1", "RandomForestRegressor", None), ("M2", "GradientBoostingRegressor", None),
                       ("M3", "DecisionTreeRegressor", None), ("M4", "ExtraTreesRegressor", None),
                       ("M10", "AdaBoostRegressor", None), ("M12", "BaggingRegressor", None),
                       ("M13", "XGBRegressor", None), ("M13b", "LGBMRegressor", None), ("M13c", "CatBoostRegressor", None)]:
    register(f"{_id}_{_name}")(_reg(_name, _p))

for _id, _name, _p in [("M14", "RandomForestClassifier", None), ("M14b", "DecisionTreeClassifier", None),
                       ("M16", "GradientBoostingClassifier", None),
                       ("M17", "ExtraTreesClassifier", None), ("M18", "LogisticRegression", None),
                       ("M19", "SVC", {"kernel": "linear"}), ("M20", "SGDClassifier", None),
                       ("M21", "MLPClassifier", None), ("M22", "AdaBoostClassifier", None)]:
    register(f"{_id}_{_name}")(_clf(_name, _p))


@register("E6_verdict_classification", GNB_SQL.replace(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, y_true, cls as y_pred from best where r = 1", """,
pred as (select y_true, cls as y_pred from best where r = 1),
cls as (select y_true as c from pred union select y_pred from pred),
per as (select c, (select count(*) from pred where y_true = c and y_pred = c) as tp,
               (select count(*) from pred where y_pred = c) as np, (select count(*) from pred where y_true = c) as nt
        from cls),
pr as (select c, tp, case when np > 0 then tp / np else 0.0 end as p, case when nt > 0 then tp / nt else 0.0 end as r from per),
met as (select (select count(*) from pred) as n, round(sum(tp) / (select count(*) from pred), 4) as accuracy,
               round(avg(p), 4) as precision, round(avg(r), 4) as recall,
               round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 4) as f1 from pr)
select n, accuracy, precision, recall, f1,
       case when accuracy >= 0.85 then 'good' when accuracy >= 0.65 then 'moderate' else 'limited' end as level,
       'Model: GaussianNB | Task: classification' || chr(10) ||
       'Metrics: {''accuracy'': ' || """ + _num_sql("accuracy", 4) + """ || ', ''precision'': ' || """ + _num_sql("precision", 4) + """ ||
       ', ''recall'': ' || """ + _num_sql("recall", 4) + """ || ', ''f1'': ' || """ + _num_sql("f1", 4) + """ || '}' || chr(10) ||
       case when coalesce(accuracy, 0) >= 0.85 then 'Performance: good. High accuracy suggests the model generalizes well.'
            when coalesce(accuracy, 0) >= 0.65 then 'Performance: moderate. Consider feature engineering or trying other models.'
            else 'Performance: limited. Try more features, class balance, or different algorithms.' end || chr(10) ||
       'Suggestion: try hyperparameter tuning (GridSearchCV) or ensemble methods.' as verdict
from met"""))
def e6_verdict_classification(spark, sf):
    """Rule-based interpretation of the Gaussian NB classification metrics."""
    return E.verdict(E.classification_metrics(gnb_predictions(spark, sf)), "GaussianNB", "classification")


for _id, _name, _p in [("M14c", "BaggingClassifier", None), ("M16b", "XGBClassifier", None), ("M16c", "LGBMClassifier", None),
                       ("M16d", "CatBoostClassifier", None)]:
    register(f"{_id}_{_name}")(_clf(_name, _p))


@register("E3_per_class_report", GNB_SQL.replace(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, y_true, cls as y_pred from best where r = 1", """,
pred as (select y_true, cls as y_pred from best where r = 1),
cls as (select y_true as c from pred union select y_pred from pred),
per as (select c, (select count(*) from pred where y_true = c and y_pred = c) as tp,
               (select count(*) from pred where y_pred = c) as np, (select count(*) from pred where y_true = c) as nt
        from cls),
pr as (select c, tp, nt, case when np > 0 then tp / np else 0.0 end as p, case when nt > 0 then tp / nt else 0.0 end as r
       from per)
select c as class, nt as support, tp, round(p, 6) as precision, round(r, 6) as recall,
       round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1
from pr"""))
def e3_per_class_report(spark, sf):
    """Per-class support, precision, recall and F1 of the Gaussian NB predictions (class union)."""
    r = E.per_class_report(gnb_predictions(spark, sf))
    return r.select("class", "support", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
