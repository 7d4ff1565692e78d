"""Logistic fits and searches that SQL can state: one feature of three values, two classes, Newton's method."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import splits as T
from fathom.plans import estimators as M
from fathom.plans import search as S
from fathom.plans.catalog import register, table
from fathom.plans.reg_trees import FOLDS, KEYS, SCORE, X1

TARGET = f"case when {SCORE} > 34 then 'high' else 'low' end"
GRID = S.param_grid("LogisticRegression", "classification")

ROWS = f"""o as (select {X1} as x, case when {SCORE} > 34 then 0 else 1 end as y,
                   l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey as k from lineitem),
h as (select *, md5(k || '|42') as h from o),
r as (select *, row_number() over (order by h, k) - 1 as rk, count(*) over () as n from h),
s as (select *, ceil(0.2::double * n)::bigint as n_test from r)"""


def _newton(counts: str, key: str) -> str:
    """25 Newton steps of every row of ``counts`` (key, c, n0..n2 rows and s0..s2 rows of class 1 by feature value)."""
    p = [f"1 / (1 + exp(-(w * {x} + b)))" for x in range(3)]
    total = lambda f: " + ".join(f(x) for x in range(3))
    gw, gb = total(lambda x: f"{x} * (n{x} * p{x} - s{x})"), total(lambda x: f"(n{x} * p{x} - s{x})")
    ww, wb, bb = (total(lambda x, f=f: f"{f(x)} * n{x} * p{x} * (1 - p{x})") for f in (lambda x: x * x, lambda x: x, lambda x: 1))
    return f"""it as (select {key}, c, 0.0::double as w, 0.0::double as b, 0 as turn from {counts}
       union all
       select {key}, c, w - (bb * gw - wb * gb) / (ww * bb - wb * wb), b - (ww * gb - wb * gw) / (ww * bb - wb * wb), turn + 1
       from (select *, ({gw}) + w / c as gw, ({gb}) as gb, ({ww}) + 1 / c as ww, ({wb}) as wb, ({bb}) as bb
             from (select it.*, q.* exclude ({key}, c), {", ".join(f"{e} as p{x}" for x, e in enumerate(p))}
                   from it join {counts} q using ({key}, c) where turn < 25)))"""


COUNTS = ", ".join(f"sum((x = {x})::int)::double as n{x}, sum((x = {x} and y = 1)::int)::double as s{x}" for x in range(3))


def _input(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*KEYS, f"cast({X1} as double) as x", f"{TARGET} as y")


@register("M18_logistic_one_feature", f"""
with recursive {ROWS}, q as (select 0 as hold, 1.0::double as c, {COUNTS} from s),
{_newton("q", "hold")}
select 'x' as term, round(w, 4) as value from it where turn = 25 union all select 'intercept', round(b, 4) from it where turn = 25""")
def m18_logistic_one_feature(spark, sf):
    """Logistic regression (C 1) on one feature: the weights at its optimum."""
    m = M.fit(_input(spark, sf), ["x"], "y", "LogisticRegression", "classification", {"tol": 1e-10, "max_iter": 1000})
    return spark.createDataFrame([("x", round(float(m.weights[0, 0]), 4)), ("intercept", round(float(m.weights[0, 1]), 4))], "term string, value double")


@register("T7_cv_logistic_one_feature", f"""
with recursive {ROWS}, {FOLDS["classification"]},
train as (select * from d where not is_test), held as (select distinct fold as hold from train),
grid as (select * from (values {", ".join(f"({i}, {float(c)!r}::double)" for i, c in enumerate(GRID["C"]))}) g(combo_id, c)),
q as (select hold, c, {COUNTS} from train join held on fold <> hold, grid group by hold, c),
{_newton("q", "hold")},
score as (select hold, c, avg((y = (w * x + b > 0)::int)::int) as a from it join train on fold = hold where turn = 25 group by hold, c)
select combo_id, round(avg(a), 8) as mean_score from score join grid using (c) group by combo_id""")
def t7_cv_logistic_one_feature(spark, sf):
    """5-fold accuracy of the default LogisticRegression grid: all 20 fits in the same passes."""
    train = T.split_and_folds(_input(spark, sf), KEYS, "y").where("split = 'train'")
    scores = S.scores_frame(spark, S.cv_score(train, ["x"], "y", "LogisticRegression", "classification", list(enumerate(S.expand_grid(GRID)))))
    return scores.select("combo_id", F.round("mean_score", 8).alias("mean_score"))
