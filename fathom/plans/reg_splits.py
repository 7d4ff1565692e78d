"""Registered queries for splits and folds."""

from __future__ import annotations

from fathom.operators import splits as T
from fathom.plans import inputs as I
from fathom.plans.catalog import register, table

_LI_ORDER = """
with o as (select l_orderkey, l_linenumber, l_orderkey || '|' || l_linenumber as k from lineitem),
h as (select *, md5(k || '|42') as h from o),
r as (select *, row_number() over (order by h, k) - 1 as rk, count(*) over () as n from h),
s as (select *, ceil(0.2::double * n)::bigint as n_test from r)"""


@register("T1_train_test_split", _LI_ORDER + """
select l_orderkey, l_linenumber, case when rk < n_test then 'test' else 'train' end as split from s""")
def t1_train_test_split(spark, sf):
    """lineitem split 80/20 by the seeded md5 order of (orderkey, linenumber); exact sizes."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return T.train_test_split(li, ["l_orderkey", "l_linenumber"], 0.2, 42)


@register("T2_kfold_assign", _LI_ORDER + """,
t as (select *, rk - n_test as tr, n - n_test as nt from s),
f as (select *, nt // 5 as q, nt % 5 as rem from t)
select l_orderkey, l_linenumber, case when rk < n_test then 'test' else 'train' end as split,
       case when rk < n_test then null
            when tr < rem * (q + 1) then (tr // (q + 1))::integer
            else (rem + (tr - rem * (q + 1)) // q)::integer end as fold
from f""")
def t2_kfold_assign(spark, sf):
    """lineitem: test split, then 5 contiguous folds of the ordered train rows."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return T.split_and_folds(li, ["l_orderkey", "l_linenumber"], None, 5, 0.2, 42)


def _alloc_sql(i: int) -> str:
    return f"(floor((s + c - 1 - {i}) / 5.0) - floor((s - 1 - {i}) / 5.0))"


@register("T3_stratified_kfold", f"""
with d as ({I.DOCS_SQL}),
o as (select doc_id, quality, cast(doc_id as varchar) as k from d),
h as (select *, md5(k || '|42') as h from o),
r as (select *, row_number() over (order by h, k) - 1 as rk, count(*) over () as n from h),
s0 as (select *, ceil(0.2::double * n)::bigint as n_test from r),
tr as (select * from s0 where rk >= n_test),
cc as (select quality, count(*) as c from tr group by 1),
st as (select quality, c, coalesce(sum(c) over (order by quality rows between unbounded preceding and 1 preceding), 0) as s from cc),
al as (select quality, {_alloc_sql(0)} as a0, {_alloc_sql(1)} as a1, {_alloc_sql(2)} as a2, {_alloc_sql(3)} as a3 from st),
rc as (select tr.*, row_number() over (partition by tr.quality order by h, k) - 1 as p from tr)
select doc_id, rc.quality, 'train' as split,
       (case when p < a0 then 0 when p < a0 + a1 then 1 when p < a0 + a1 + a2 then 2
             when p < a0 + a1 + a2 + a3 then 3 else 4 end)::integer as fold
from rc join al using (quality)
union all
select doc_id, quality, 'test', null::integer from s0 where rk < n_test""")
def t3_stratified_kfold(spark, sf):
    """Labelled documents: test split, then 5 folds stratified by quality."""
    d = I.docs(spark, sf).select("doc_id", "quality")
    return T.split_and_folds(d, ["doc_id"], "quality", 5, 0.2, 42)
