"""Searches, fits and runs whose answer SQL can state in closed form: one feature, linear models.

The input is lineitem with the price in thousands as the feature and the
quantity plus half of it as the target; splits and folds are those of T1 and T2.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.bundle import Bundle, DatasetRoles
from fathom.operators import splits as T
from fathom.plans import estimators as M
from fathom.plans import search as S
from fathom.plans.catalog import register, table
from fathom.plans.runner import compare_models, run_pipeline, run_tasks

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
RIDGE = S.param_grid("Ridge", "regression")["alpha"]
LASSO = S.param_grid("Lasso", "regression")["alpha"]

ROWS = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1000.0::double as x,
       l_quantity::double + l_extendedprice / 2000.0::double as y from lineitem"""

FOLDS = f"""
with o as (select x, y, l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey as k from ({ROWS})),
h as (select *, md5(k || '|42') as h from o),
r as (select *, row_number() over (order by h, k) - 1 as rk, count(*) over () as n from h),
s as (select *, ceil(0.2::double * n)::bigint as n_test from r),
t as (select *, rk - n_test as tr, n - n_test as nt from s),
f as (select *, nt // 5 as q, nt % 5 as rem from t),
d as (select x, y, rk < n_test as is_test,
             case when tr < rem * (q + 1) then tr // (q + 1) else rem + (tr - rem * (q + 1)) // q end as fold from f),
train as (select * from d where not is_test),
held as (select distinct fold as h from train),
fits as (select h, count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy
         from train join held on fold <> h group by h)"""


def _grid_sql(alphas) -> str:
    return ", ".join(f"({i}, {float(a)!r}::double)" for i, a in enumerate(alphas))


def _scores(alphas, slope: str) -> str:
    """Mean held-out R2 of each penalty; ``slope`` is the coefficient from n, cxx, cxy and alpha."""
    return FOLDS + f""",
grid as (select * from (values {_grid_sql(alphas)}) g(combo_id, alpha)),
model as (select h, combo_id, alpha, {slope} as b, my - ({slope}) * mx as b0 from fits, grid),
score as (select h, combo_id, alpha, 1 - avg((y - b0 - b * x) * (y - b0 - b * x)) / var_pop(y) as r2
          from model join train on fold = h group by h, combo_id, alpha),
mean as (select combo_id, alpha, avg(r2) as r2 from score group by combo_id, alpha),
best as (select combo_id, alpha from mean order by round(r2, 12) desc, combo_id limit 1),
whole as (select count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy from train)"""


RIDGE_SLOPE = "n * cxy / (n * cxx + alpha)"
LASSO_SLOPE = "sign(cxy) * greatest(abs(cxy) - alpha, 0) / cxx"


def _rows(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, (F.col("l_extendedprice") / 1000.0).cast("double").alias("x"),
                                               (F.col("l_quantity") + F.col("l_extendedprice") / 2000.0).cast("double").alias("y"))


def _bundle(spark, sf) -> Bundle:
    return Bundle(_rows(spark, sf), DatasetRoles(("x",), "y", {}, "lineitem", "price and quantity"), None)


def _coefficients(model):
    return [("intercept", round(float(model.intercept), 6)), ("x", round(float(model.coef[0]), 6))]


@register("M6_lasso_one_feature", f"""
with d as ({ROWS}), m as (select avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy from d),
b as (select *, sign(cxy) * greatest(abs(cxy) - 1.0, 0) / cxx as b from m)
select 'x' as term, round(b, 6) as value from b union all select 'intercept', round(my - b * mx, 6) from b""")
def m6_lasso_one_feature(spark, sf):
    """Lasso (alpha 1) of quantity on price: soft threshold of the covariance."""
    m = M.fit(_rows(spark, sf), ["x"], "y", "Lasso", "regression", {"alpha": 1.0})
    return spark.createDataFrame(_coefficients(m), "term string, value double")


@register("M7_elastic_net_one_feature", f"""
with d as ({ROWS}), m as (select avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy from d),
b as (select *, sign(cxy) * greatest(abs(cxy) - 2.0 * 0.3, 0) / (cxx + 2.0 * 0.7) as b from m)
select 'x' as term, round(b, 6) as value from b union all select 'intercept', round(my - b * mx, 6) from b""")
def m7_elastic_net_one_feature(spark, sf):
    """Elastic net (alpha 2, l1_ratio 0.3) of quantity on price."""
    m = M.fit(_rows(spark, sf), ["x"], "y", "ElasticNet", "regression", {"alpha": 2.0, "l1_ratio": 0.3})
    return spark.createDataFrame(_coefficients(m), "term string, value double")


@register("M3_tree_of_groups", """
select l_linenumber, l_tax, round(avg(l_quantity::double) over (partition by l_linenumber, l_tax), 6) as prediction,
       l_orderkey from lineitem""")
def m3_tree_of_groups(spark, sf):
    """A fully grown regression tree on two columns of few values predicts the mean of each group."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    m = M.fit(li, ["l_linenumber", "l_tax"], "l_quantity", "DecisionTreeRegressor", "regression", {})
    return m.predict(li).select("l_orderkey", "l_linenumber", "l_tax", F.round("prediction", 6).alias("prediction"))


@register("T7_cv_ridge_one_feature", _scores(RIDGE, RIDGE_SLOPE) + " select combo_id, round(r2, 8) as mean_score from mean")
def t7_cv_ridge_one_feature(spark, sf):
    """5-fold CV R2 of the default Ridge grid."""
    train = T.split_and_folds(_rows(spark, sf), KEYS).where("split = 'train'")
    combos = list(enumerate(S.expand_grid({"alpha": RIDGE})))
    scores = S.scores_frame(spark, S.cv_score(train, ["x"], "y", "Ridge", "regression", combos))
    return scores.select("combo_id", F.round("mean_score", 8).alias("mean_score"))


@register("T8_lasso_one_feature", _scores(LASSO, LASSO_SLOPE) + f""",
fit as (select alpha, mx, my, {LASSO_SLOPE} as b from whole, best)
select 'alpha' as term, alpha as value from fit union all select 'x', round(b, 6) from fit
union all select 'intercept', round(my - b * mx, 6) from fit""")
def t8_lasso_one_feature(spark, sf):
    """The Lasso penalty that CV prefers (ties to the first) and its refit on all train rows."""
    train = T.split_and_folds(_rows(spark, sf), KEYS).where("split = 'train'")
    model, best, _ = S.search(train, ["x"], "y", "Lasso", "regression", {"alpha": LASSO})
    return spark.createDataFrame([("alpha", float(best["params"]["alpha"])), *_coefficients(model)], "term string, value double")


def _metrics(source: str) -> str:
    return f"""count(*) as n, round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) as "R2", round(avg((y - p) * (y - p)), 4) as "MSE",
       round(sqrt(avg((y - p) * (y - p))), 4) as "RMSE", round(avg(abs(y - p)), 4) as "MAE" from {source}"""


@register("X1_run_one_feature", _scores(RIDGE, RIDGE_SLOPE) + f""",
fit as (select my, mx, {RIDGE_SLOPE} as b from whole, best),
pred as (select y, my + b * (x - mx) as p from d, fit where is_test)
select {_metrics("pred")}""")
def x1_run_one_feature(spark, sf):
    """Whole run: profile, Ridge, 5-fold search of its default grid, refit, test metrics."""
    return run_pipeline(spark, {}, task="regression", key=KEYS, fixed_model="Ridge", bundle=_bundle(spark, sf)).metrics


@register("X3_compare_one_feature", FOLDS + f""",
whole as (select count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy from train),
coef as (select 'LinearRegression' as model, cxy / cxx as b, mx, my from whole
         union all select 'Ridge', n * cxy / (n * cxx + 1.0), mx, my from whole
         union all select 'Lasso', sign(cxy) * greatest(abs(cxy) - 1.0, 0) / cxx, mx, my from whole
         union all select 'ElasticNet', sign(cxy) * greatest(abs(cxy) - 0.5, 0) / (cxx + 0.5), mx, my from whole
         union all select 'SGDRegressor', cxy / (cxx + 0.0001), mx, my from whole),
pred as (select model, y, my + b * (x - mx) as p from d, coef where is_test)
select model, {_metrics("pred")} group by model""")
def x3_compare_one_feature(spark, sf):
    """The five linear models at their defaults on one split."""
    names = ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "SGDRegressor"]
    return compare_models(spark, _bundle(spark, sf), names, "regression", KEYS)


WIDE = [round(0.001 * 1.5 ** i, 6) for i in range(30)]


@register("T6_random_search_one_feature", _scores(WIDE, LASSO_SLOPE).replace(
    "g(combo_id, alpha)),\nmodel", "g(combo_id, alpha) order by md5(combo_id || '|42') limit 20),\nmodel") + f""",
fit as (select alpha, mx, my, {LASSO_SLOPE} as b from whole, best)
select 'alpha' as term, alpha as value from fit union all select 'x', round(b, 6) from fit
union all select 'intercept', round(my - b * mx, 6) from fit""")
def t6_random_search_one_feature(spark, sf):
    """Randomised search: 20 of 30 Lasso penalties drawn by md5 order, scored by 5-fold CV, the best one refitted."""
    train = T.split_and_folds(_rows(spark, sf), KEYS).where("split = 'train'")
    model, best, _ = S.search(train, ["x"], "y", "Lasso", "regression", {"alpha": WIDE}, randomized=True, n_iter=20)
    return spark.createDataFrame([("alpha", float(best["params"]["alpha"])), *_coefficients(model)], "term string, value double")


@register("T9_fit_plain_one_feature", FOLDS + """,
w as (select avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy from train)
select 'x' as term, round(cxy / cxx, 6) as value from w union all select 'intercept', round(my - cxy / cxx * mx, 6) from w""")
def t9_fit_plain_one_feature(spark, sf):
    """Without a grid the library's defaults are fitted once on all train rows."""
    train = T.split_and_folds(_rows(spark, sf), KEYS).where("split = 'train'")
    model, _, _ = S.search(train, ["x"], "y", "LinearRegression", "regression", {})
    return spark.createDataFrame(_coefficients(model), "term string, value double")


@register("X2_run_tasks_named_columns", FOLDS.replace("select x, y, l_orderkey", "select x, y, l_returnflag, l_orderkey", 1)
          .replace("as y from lineitem)", "as y, l_returnflag from lineitem)", 1)
          .replace("d as (select x, y, rk", "d as (select x, y, l_returnflag as f, rk", 1) + """,
test as (select * from d where is_test),
w as (select avg(x) as mx, avg(y) as my, cxy / cxx as b from (select x, y, covar_pop(x, y) over () as cxy, var_pop(x) over () as cxx from train) group by cxy / cxx),
reg as (select 1 - avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))) / var_pop(y) as v, count(*) as n from test, w),
eps as (select 1e-9 * var_pop(x) as e, count(*) as total from train),
cls as (select f as c, count(*) as k, avg(x) as m, var_pop(x) + any_value(e) as s from train, eps group by f),
sc as (select test.rowid_, f, c, ln(k / total) - 0.5 * ln(2 * pi() * s) - (x - m) * (x - m) / (2 * s) as p
       from (select *, row_number() over () as rowid_ from test) test, cls, eps),
hit as (select f = arg_max(c, {'p': p, 'o': -ascii(c)}) as ok from sc group by rowid_, f),
clf as (select avg(ok::int) as v, count(*) as n from hit)
select 'Quantity (units)' as target, 'regression' as task, 'LinearRegression' as model, n,
       case when round(v, 4) >= 0.7 then 'good' when round(v, 4) >= 0.4 then 'moderate' else 'limited' end as level from reg
union all select 'Return flag', 'classification', 'GaussianNB', n,
       case when round(v, 4) >= 0.85 then 'good' when round(v, 4) >= 0.65 then 'moderate' else 'limited' end from clf""")
def x2_run_tasks_named_columns(spark, sf):
    """Two targets of different tasks on one prepared table whose names hold blanks and brackets, through the loader."""
    li = table(spark, sf, "lineitem").select(
        *KEYS, (F.col("l_extendedprice") / 1000.0).cast("double").alias("Price (thousands)"),
        (F.col("l_quantity") + F.col("l_extendedprice") / 2000.0).cast("double").alias("Quantity (units)"), F.col("l_returnflag").alias("Return flag"))
    cfg = {"df": li, "path": "lineitem", "features": ["Price (thousands)"]}
    return run_tasks(spark, cfg, [
        {"target": "Quantity (units)", "task": "regression", "options": {"fixed_model": "LinearRegression", "key": KEYS}},
        {"target": "Return flag", "task": "classification", "options": {"fixed_model": "GaussianNB", "key": KEYS}}]).drop("verdict")
