"""Tree ensembles and default runs whose answer SQL can state: two columns of few values.

The input is lineitem with its return flag and line status as numbers; a fully
grown tree tells their six combinations apart, so a tree predicts the (sampled)
mean of each. The sampling weights follow from md5 of the row's key, by the
same arithmetic in SQL as in the learner.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.bundle import Bundle, DatasetRoles
from fathom.plans import estimators as M
from fathom.plans.binned import PRIME, poisson_steps
from fathom.plans.catalog import register, table
from fathom.plans.runner import run_pipeline

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
X1, X2 = "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end", "case l_linestatus when 'O' then 1 else 0 end"
SCORE = "l_quantity + case when l_returnflag = 'R' then 20 else 0 end + case when l_linestatus = 'O' then 5 else 0 end"
#: Target of the regression, and class of the classification.
TARGETS = {"regression": f"cast({SCORE} as double)",
           "classification": f"case when {SCORE} > 42 then 'large' when {SCORE} > 22 then 'medium' else 'small' end"}
NAMES = ["large", "medium", "small"]


def _rows(spark, sf, task):
    return table(spark, sf, "lineitem").selectExpr(*KEYS, f"cast({X1} as double) as x1", f"cast({X2} as double) as x2", f"{TARGETS[task]} as y")


def _bundle(spark, sf, task) -> Bundle:
    return Bundle(_rows(spark, sf, task), DatasetRoles(("x1", "x2"), "y", {}, "lineitem", "flag and status"), None)


def _base_sql(task: str) -> str:
    """Rows with their group g, target y (a class as its number) and the two halves of md5 of the key."""
    y = TARGETS[task] if task == "regression" else f"list_position(['large', 'medium', 'small'], {TARGETS[task]}) - 1"
    return f"""o as (select {X1} as x1, {X2} as x2, 2 * ({X1}) + ({X2}) as g, {y} as y,
                   l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey as k from lineitem),
h as (select *, md5(k || '|42') as h, ('0x' || substr(md5(k), 1, 8))::bigint & {PRIME} as id1, ('0x' || substr(md5(k), 9, 8))::bigint & {PRIME} as id2 from o),
r as (select *, row_number() over (order by h, k) - 1 as rk, count(*) over () as n from h),
s as (select *, ceil(0.2::double * n)::bigint as n_test from r)"""


FOLDS = {"regression": """t as (select *, rk - n_test as tr, n - n_test as nt from s),
f as (select *, nt // 5 as q, nt % 5 as rem from t),
d as (select *, rk < n_test as is_test, case when tr < rem * (q + 1) then tr // (q + 1) else rem + (tr - rem * (q + 1)) // q end as fold from f)""",
         "classification": "cc as (select y, count(*) as c from s where rk >= n_test group by y),\n"
         "st as (select y, c, coalesce(sum(c) over (order by y rows between unbounded preceding and 1 preceding), 0) as s from cc),\n"
         "al as (select y, " + ", ".join(f"(floor((s + c - 1 - {i}) / 5.0) - floor((s - 1 - {i}) / 5.0)) as a{i}" for i in range(4)) + " from st),\n"
         "rc as (select *, row_number() over (partition by y, rk < n_test order by h, k) - 1 as p from s),\n"
         "d as (select rc.*, rk < n_test as is_test, case when p < a0 then 0 when p < a0 + a1 then 1 when p < a0 + a1 + a2 then 2\n"
         "             when p < a0 + a1 + a2 + a3 then 3 else 4 end as fold from rc join al using (y))"}


def _forest_sql(trees: int, rows: str) -> str:
    """``sums(t, g, fold, y, w, wy)``: sampled weights of the rows by tree, group, fold and target."""
    steps = poisson_steps(1).tolist()
    weight = "case " + " ".join(f"when u < {x} then {i}" for i, x in enumerate(steps[:14])) + " else 14 end"
    part = lambda at: f"1 + ('0x' || substr(md5(t || '|42'), {at}, 8))::bigint % {PRIME - 1}"
    return f"""trees as (select t, {part(1)} as a, {part(9)} as b, {part(17)} as c from range({trees}) r(t)),
drawn as (select t, g, fold, y, ((id1 % {PRIME}) * a + ((id2 % {PRIME}) * b) % {PRIME} + c) % {PRIME} as u from {rows}, trees),
sums as (select t, g, fold, y, sum({weight})::double as w from drawn group by t, g, fold, y)"""


SIZES = "sizes as (select unnest([50, 100, 200]) as size)"

REGRESSION_RUN = f"""
with {_base_sql("regression")}, {FOLDS["regression"]},
train as (select * from d where not is_test), held as (select distinct fold as hold from train union all select -1), {SIZES},
{_forest_sql(200, "train")},
value as (select hold, t, g, sum(w * y) / sum(w) as v from sums join held on fold <> hold group by hold, t, g),
pred as (select hold, size, g, avg(v) as p from value, sizes where t < size group by hold, size, g),
score as (select hold, size, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2 from pred join train on fold = hold and train.g = pred.g group by hold, size),
mean as (select size, avg(r2) as r2 from score group by size),
best as (select size, r2 from mean order by round(r2, 12) desc, size limit 1),
test as (select y, p from d join pred on pred.g = d.g join best using (size) where is_test and hold = -1)
select count(*) as n, round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) as "R2", round(avg((y - p) * (y - p)), 4) as "MSE",
       round(sqrt(avg((y - p) * (y - p))), 4) as "RMSE", round(avg(abs(y - p)), 4) as "MAE",
       '{{"max_depth": 5, "min_samples_split": 2, "n_estimators": ' || any_value(size) || '}}' as params, round(any_value(r2), 8) as cv_score
from test, best"""


def _run(spark, sf, task):
    import json
    r = run_pipeline(spark, {}, task=task, key=KEYS, bundle=_bundle(spark, sf, task))
    return r.metrics.withColumn("params", F.lit(json.dumps(r.best["params"], sort_keys=True))).withColumn("cv_score", F.round(F.lit(r.best["mean_score"]), 8))


@register("X1_default_run_regression", REGRESSION_RUN)
def x1_default_run_regression(spark, sf):
    """The default run: profile, random forest, 24 combinations by 5 folds from one forest, refit, test metrics."""
    return _run(spark, sf, "regression")


CLASSIFICATION_RUN = f"""
with {_base_sql("classification")}, {FOLDS["classification"]},
train as (select * from d where not is_test), held as (select distinct fold as hold from train union all select -1), {SIZES},
{_forest_sql(200, "train")},
whole as (select hold, t, g, sum(w) as w from sums join held on fold <> hold group by hold, t, g),
value as (select hold, t, g, s.y as c, sum(s.w) / any_value(whole.w) as v from sums s join held on fold <> hold join whole using (hold, t, g) group by hold, t, g, s.y),
shares as (select hold, size, g, c, sum(v) as p from value, sizes where t < size group by hold, size, g, c),
pred as (select hold, size, g, arg_max(c, {{'p': p, 'first': -c}}) as c from shares group by hold, size, g),
score as (select hold, size, avg((y = c)::int) as a from pred join train on fold = hold and train.g = pred.g group by hold, size),
mean as (select size, avg(a) as a from score group by size),
best as (select size, a from mean order by round(a, 12) desc, size limit 1),
test as (select y as y_true, c as y_pred from d join pred on pred.g = d.g join best using (size) where is_test and hold = -1),
cls as (select y_true as c from test union select y_pred from test),
per as (select c, (select count(*) from test where y_true = c and y_pred = c) as tp,
               (select count(*) from test where y_pred = c) as np, (select count(*) from test where y_true = c) as nt from cls),
pr as (select c, tp, case when np > 0 then tp / np else 0.0 end as p, case when nt > 0 then tp / nt else 0.0 end as r from per)
select (select count(*) from test) as n, round(sum(tp) / (select count(*) from test), 4) as accuracy, round(avg(p), 4) as precision, round(avg(r), 4) as recall,
       round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 4) as f1,
       '{{"max_depth": 5, "min_samples_split": 2, "n_estimators": ' || (select size from best) || '}}' as params, round((select a from best), 8) as cv_score
from pr"""


@register("X1_default_run_classification", CLASSIFICATION_RUN)
def x1_default_run_classification(spark, sf):
    """The default run of a classification: stratified folds, random forest, accuracy of 24 combinations, refit, macro metrics."""
    return _run(spark, sf, "classification")


# ------------------------------------------------------------------ ensembles of group means and shares
def _groups(spark, sf, name, task, params=None):
    d = _rows(spark, sf, task)
    m = M.fit(d, ["x1", "x2"], "y", name, task, params, KEYS)
    p = m.predict(d.select("x1", "x2").distinct())
    return p.select("x1", "x2", F.round("prediction", 6).alias("prediction") if task == "regression" else F.col("prediction"))


def _sampled_mean(trees: int) -> str:
    return f"""with {_base_sql("regression")}, d as (select *, 0 as fold from s), {_forest_sql(trees, "d")},
value as (select t, g, sum(w * y) / sum(w) as v from sums group by t, g)
select (g // 2)::double as x1, (g % 2)::double as x2, round(avg(v), 6) as prediction from value group by g"""


def _sampled_class(trees: int) -> str:
    return f"""with {_base_sql("classification")}, d as (select *, 0 as fold from s), {_forest_sql(trees, "d")},
shares as (select g, y as c, sum(w / all_w) as p from (select *, sum(w) over (partition by t, g) as all_w from sums) group by g, y)
select (g // 2)::double as x1, (g % 2)::double as x2, ['large', 'medium', 'small'][arg_max(c, {{'p': p, 'first': -c}}) + 1] as prediction from shares group by g"""


MEANS = f"with {_base_sql('regression')} select (g // 2)::double as x1, (g % 2)::double as x2, round(avg(y), 6) as prediction from s group by g"
SHARES = f"""with {_base_sql("classification")}, c as (select g, y as c, count(*) as p from s group by g, y)
select (g // 2)::double as x1, (g % 2)::double as x2, ['large', 'medium', 'small'][arg_max(c, {{'p': p, 'first': -c}}) + 1] as prediction from c group by g"""

for _id, _name, _task, _sql in [
        ("M1_forest_of_groups", "RandomForestRegressor", "regression", _sampled_mean(100)),
        ("M4_extra_trees_of_groups", "ExtraTreesRegressor", "regression", MEANS),
        ("M12_bagging_of_groups", "BaggingRegressor", "regression", _sampled_mean(10)),
        ("M14_forest_of_groups", "RandomForestClassifier", "classification", _sampled_class(100)),
        ("M14b_tree_of_groups", "DecisionTreeClassifier", "classification", SHARES),
        ("M14c_bagging_of_groups", "BaggingClassifier", "classification", _sampled_class(10)),
        ("M17_extra_trees_of_groups", "ExtraTreesClassifier", "classification", SHARES)]:
    def _q(spark, sf, name=_name, task=_task):
        return _groups(spark, sf, name, task)
    _q.__doc__ = f"{_name} at its defaults on two columns of few values: what it predicts for each combination."
    register(_id, _sql)(_q)


# ------------------------------------------------------------------ boosting of group means and shares
def _boosted_mean(rate: float, penalty: float) -> str:
    return f"""with {_base_sql("regression")}, m as (select avg(y) as m from s), q as (select g, avg(y) as gm, count(*) as c from s group by g)
select (g // 2)::double as x1, (g % 2)::double as x2, round(m + (gm - m) * (1 - power(1 - {rate} * c / (c + {penalty}), 100)), 3) as prediction from q, m"""


for _id, _name, _rate, _penalty in [("M2", "GradientBoostingRegressor", 0.1, 0.0), ("M13", "XGBRegressor", 0.3, 1.0),
                                    ("M13b", "LGBMRegressor", 0.1, 0.0), ("M13c", "CatBoostRegressor", 0.03, 3.0)]:
    def _q(spark, sf, name=_name):
        return _groups(spark, sf, name, "regression", {"n_estimators": 100}).withColumn("prediction", F.round("prediction", 3))
    _q.__doc__ = f"{_name}, 100 rounds, on two columns of few values: every round takes its share of what is left of each group's mean."
    register(f"{_id}_boosted_means", _boosted_mean(_rate, _penalty))(_q)


def _softmax_rounds(rate: float, penalty: float, factor: float, prior: bool) -> str:
    """100 rounds of joint softmax boosting on the six groups: one Newton step a round for each class."""
    step = lambda k: f"f{k} + {rate} * (n{k} - n * e{k} / e) / ({factor} * n * (e{k} / e) * (1 - e{k} / e) + {penalty})"
    start = (lambda k: f"ln((select avg((y = {k})::int) from s))") if prior else (lambda k: "0.0::double")
    return f"""with recursive {_base_sql("classification")},
q as (select g, count(*)::double as n, {", ".join(f"sum((y = {k})::int)::double as n{k}" for k in range(3))} from s group by g),
it as (select g, 0 as turn, {", ".join(f"{start(k)} as f{k}" for k in range(3))} from q
       union all
       select g, turn + 1, {", ".join(step(k) for k in range(3))}
       from (select it.*, q.* exclude (g), {", ".join(f"exp(f{k}) as e{k}" for k in range(3))}, exp(f0) + exp(f1) + exp(f2) as e from it join q using (g) where turn < 100))
select (g // 2)::double as x1, (g % 2)::double as x2, {", ".join(f"round(f{k}, 3) as score{k}" for k in range(3))},
       ['large', 'medium', 'small'][case when f0 >= f1 and f0 >= f2 then 1 when f1 >= f2 then 2 else 3 end] as prediction from it where turn = 100"""


# A penalty on leaves can make a split not worth its gain, so the penalised learners need not tell all six groups apart in
# every round and this recursion does not state them; tests hold them equal to plain loops.
for _id, _name, _sql in [("M16", "GradientBoostingClassifier", _softmax_rounds(0.1, 0.0, 1.5, True)), ("M16b", "XGBClassifier", None),
                         ("M16c", "LGBMClassifier", _softmax_rounds(0.1, 0.0, 1.5, True)), ("M16d", "CatBoostClassifier", None)]:
    def _q(spark, sf, name=_name):
        d = _rows(spark, sf, "classification")
        m = M.fit(d, ["x1", "x2"], "y", name, "classification", {"n_estimators": 100}, KEYS)
        p = m.predict(d.select("x1", "x2").distinct()).withColumn("s", m.scores(d))
        return p.select("x1", "x2", *[F.round(F.col("s")[k], 3).alias(f"score{k}") for k in range(3)], "prediction")
    _q.__doc__ = f"{_name}, 100 rounds of three trees each by the joint softmax loss: scores and class of each combination."
    register(f"{_id}_softmax_scores", _sql)(_q)
