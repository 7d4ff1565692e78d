"""Registered queries for the distribution profile (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import profile as D
from fathom.plans import inputs as I
from fathom.plans.catalog import register, table


def _skew_sql(x: str) -> str:
    return f"case when count({x}) < 3 then 0.0 else coalesce(skewness({x}), 0.0) end"


# ------------------------------------------------------------------ D1, D2
@register("D1_class_counts", f"""
select o_orderpriority as class, count(*) as n,
       round(count(*) / (select count(*) from ({I.ORDERS_CLASS_SQL}))::double, 3) as ratio
from ({I.ORDERS_CLASS_SQL}) where o_orderpriority is not null group by 1""")
def d1_class_counts(spark, sf):
    """Order-priority counts; ratio over all orders including the null class."""
    return D.class_counts(I.orders_class(spark, sf), "o_orderpriority")


@register("D2_class_balance", f"""
with c as (
  select round(count(*) / (select count(*) from ({I.ORDERS_CLASS_SQL}))::double, 3) as ratio
  from ({I.ORDERS_CLASS_SQL}) where o_orderpriority is not null group by o_orderpriority)
select count(*) as n_classes,
       round(case when min(ratio) > 0 then max(ratio) / min(ratio) else 'inf'::double end, 2) as imbalance_ratio,
       (case when min(ratio) > 0 then max(ratio) / min(ratio) else 'inf'::double end) < 2.0 as balanced
from c""")
def d2_class_balance(spark, sf):
    """Number of classes, max/min of rounded ratios, balanced flag."""
    return D.class_balance(I.orders_class(spark, sf), "o_orderpriority")


# ------------------------------------------------------------------ D3, D4
@register("D3_target_summary", f"""
select count(x) as count, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std, round(min(x), 4) as min,
       round(quantile_cont(x, 0.25), 4) as p25, round(quantile_cont(x, 0.5), 4) as p50,
       round(quantile_cont(x, 0.75), 4) as p75, round(max(x), 4) as max, round({_skew_sql('x')}, 3) as skewness
from (select l_extendedprice as x from lineitem)""")
def d3_target_summary(spark, sf):
    """describe() of lineitem.l_extendedprice with exact interpolated quartiles and G1 skewness."""
    return D.target_summary(table(spark, sf, "lineitem"), "l_extendedprice")


@register("D3_target_summary_text", f"""
select count(x) as count, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std, round(min(x), 4) as min,
       round(quantile_cont(x, 0.25), 4) as p25, round(quantile_cont(x, 0.5), 4) as p50,
       round(quantile_cont(x, 0.75), 4) as p75, round(max(x), 4) as max, round({_skew_sql('x')}, 3) as skewness
from (select try_cast(value_text as double) as x from ({I.EVENTS_TEXT_SQL})) where x is not null and not isnan(x)""")
def d3_target_summary_text(spark, sf):
    """describe() of a text target holding junk: junk is coerced away first."""
    return D.target_summary(I.events_text(spark, sf), "value_text")


@register("D4_adjusted_skewness", f"""
select event_type, count(value) as n, round({_skew_sql('value')}, 6) as skewness
from events group by event_type""")
def d4_adjusted_skewness(spark, sf):
    """Bias-corrected skewness of event values per event type."""
    return D.grouped_skewness(table(spark, sf, "events"), "value", ["event_type"])


# ------------------------------------------------------------------ D5, D6
_D5_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_empty"]


def _d5_input(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                     F.lit(None).cast("double").alias("l_empty"))


def _d5_sql():
    parts = []
    for i, c in enumerate(_D5_COLS):
        x = "null::double" if c == "l_empty" else c
        parts.append(f"""select '{c}' as "column", {i} as ord, count({x}) as n, round(avg({x}), 4) as mean,
       round(stddev_samp({x}), 4) as std, round(min({x}), 4) as min, round(max({x}), 4) as max,
       count(distinct {x}) as n_unique, round({_skew_sql(x)}, 3) as skewness,
       case when count({x}) = 0 then 'all null' end as note from lineitem""")
    return "\nunion all\n".join(parts)


@register("D5_numeric_feature_stats", _d5_sql())
def d5_numeric_feature_stats(spark, sf):
    """Numeric feature stats of lineitem (text feature and absent feature skipped, all-null kept)."""
    return D.numeric_feature_stats(_d5_input(spark, sf), _D5_COLS[:4] + ["l_returnflag", "absent", "l_empty"])


@register("D6_categorical_feature_stats", """
with vc as (
  select 'c_mktsegment' as "column", c_mktsegment as value, count(*) as n from customer group by 2
  union all
  select 'c_name', c_name, count(*) from customer group by 2
  union all
  select 'c_nation', cast(c_nationkey as varchar), count(*) from customer group by 2),
nu as (select "column", count(*) as n_unique from vc group by 1),
r as (select *, row_number() over (partition by "column" order by n desc, value) as rank from vc)
select r."column", value, n, rank::integer as rank, n_unique from r join nu using ("column") where rank <= 10""")
def d6_categorical_feature_stats(spark, sf):
    """Top-10 values and distinct counts of customer text features (ties to the smaller value)."""
    c = table(spark, sf, "customer").select("c_mktsegment", "c_name",
                                             F.col("c_nationkey").cast("string").alias("c_nation"), "c_acctbal")
    return D.categorical_feature_stats(c, ["c_mktsegment", "c_name", "c_nation", "c_acctbal"])


# ------------------------------------------------------------------ D7, D8
def _hist_sql(src: str, cols: list[str], bins: int) -> str:
    long = "\nunion all\n".join(f"select '{c}' as \"column\", {c}::double as value from ({src})" for c in cols)
    b = f"{bins}::double"
    return f"""
with v as (select * from ({long}) where value is not null and not isnan(value)),
r0 as (select "column", min(value) as mn, max(value) as mx from v group by 1),
r as (select "column", case when mn = mx then mn - 0.5 else mn end as lo,
             case when mn = mx then mx + 0.5 else mx end as hi from r0),
g as (select "column", lo, hi, (hi - lo) / {b} as step, {b} / (hi - lo) as norm from r),
b0 as (select v."column", v.value as x, g.lo, g.step,
              least(floor((v.value - g.lo) * g.norm), {bins - 1})::integer as b
       from v join g using ("column")),
b1 as (select "column", case when x < b::double * step + lo then b - 1
                             when b < {bins - 1} and x >= (b + 1)::double * step + lo then b + 1
                             else b end as bin from b0),
c as (select "column", bin, count(*) as n from b1 group by 1, 2),
grid as (select g."column", g.lo, g.hi, g.step, s.bin::integer as bin from g, range(0, {bins}) s(bin))
select grid."column", grid.bin, round(grid.bin::double * step + lo, 6) as lo,
       round(case when grid.bin = {bins - 1} then hi else (grid.bin + 1)::double * step + lo end, 6) as hi,
       coalesce(c.n, 0) as n
from grid left join c on grid."column" = c."column" and grid.bin = c.bin"""


@register("D7_target_histogram", _hist_sql("select l_extendedprice from lineitem", ["l_extendedprice"], 30))
def d7_target_histogram(spark, sf):
    """30-bin histogram of the regression target (numpy bin edges, last bin closed)."""
    return D.target_histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30)


@register("D7_class_bars", f"""
select o_orderpriority as class, count(*) as n,
       round(count(*) / (select count(*) from ({I.ORDERS_CLASS_SQL}))::double, 3) as ratio
from ({I.ORDERS_CLASS_SQL}) where o_orderpriority is not null group by 1""")
def d7_class_bars(spark, sf):
    """Bar data of a class target: the class counts in class order."""
    return D.class_counts(I.orders_class(spark, sf), "o_orderpriority")


_D8_FEATURES = ["l_quantity", "l_returnflag", "l_discount", "l_tax", "l_extendedprice", "l_const",
                "l_linenumber", "l_orderkey"]


@register("D8_feature_histograms", _hist_sql(
    "select l_quantity, l_discount, l_tax, l_extendedprice, 7.0 as l_const, l_linenumber, l_orderkey from lineitem",
    ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_const", "l_linenumber", "l_orderkey"], 25))
def d8_feature_histograms(spark, sf):
    """25-bin histograms of all features (text one skipped, constant one widened)."""
    li = table(spark, sf, "lineitem").withColumn("l_const", F.lit(7.0))
    return D.feature_histograms(li, _D8_FEATURES, 25)


# ------------------------------------------------------------------ D9, D10
@register("D9_flags_regression", f"""
with t as (select round({_skew_sql('value')}, 3) as s from events),
f as (select 'user_id' as "column", round({_skew_sql('user_id')}, 3) as s from events
      union all select 'event_id', round({_skew_sql('event_id')}, 3) from events)
select 'target' as scope, 'value' as "column", 'Target is skewed — consider log transform or robust scaler.' as flag
from t where abs(s) > 1
union all
select 'feature', "column", 'skewed' from f where abs(s) > 0.5""")
def d9_flags_regression(spark, sf):
    """Rule flags of a regression profile: skewed target (events.value) and features."""
    e = table(spark, sf, "events")
    ts = D.target_summary(e, "value")
    fs = D.numeric_feature_stats(e, ["user_id", "event_id"])
    return D.data_flags(ts, fs, None, "value")


@register("D9_flags_classification", f"""
with c as (
  select round(count(*) / (select count(*) from ({I.DOCS_SQL}))::double, 3) as ratio
  from ({I.DOCS_SQL}) where quality is not null group by quality),
b as (select case when min(ratio) > 0 then max(ratio) / min(ratio) else 'inf'::double end as imb from c)
select 'feature' as scope, 'n_chars' as "column", 'skewed' as flag from ({I.DOCS_SQL})
having abs(round({_skew_sql('n_chars')}, 3)) > 0.5
union all
select 'target', 'quality', case when imb < 2.0 then 'balanced'
       else 'imbalanced — consider class_weight or oversampling' end from b""")
def d9_flags_classification(spark, sf):
    """Rule flags of a classification profile: class imbalance of quality, skewed n_chars."""
    d = I.docs(spark, sf)
    fs = D.numeric_feature_stats(d, ["n_chars", "lang", "source"])
    return D.data_flags(None, fs, D.class_balance(d, "quality"), "quality")


def _num_sql(x: str, d: int) -> str:
    """SQL twin of ``numeric_text``: Python's print of round(x, d)."""
    r = f"round(({x})::double, {d})"
    return (f"case when {r} is null then null when isnan({r}) then 'nan' else "
            f"regexp_replace(regexp_replace(printf('%.{d}f', {r}), '0+$', ''), '\\.$', '.0') end")


def _summary_regression_sql() -> str:
    feats = ["l_quantity", "l_discount", "l_tax"]
    flines = "\nunion all\n".join(
        f"""select {100 + i} as ord, '  {c}: mean=' || {_num_sql(f'avg({c})', 4)} || ', std=' ||
       {_num_sql(f'stddev_samp({c})', 4)} || ', range=[' || {_num_sql(f'min({c})', 4)} || ', ' ||
       {_num_sql(f'max({c})', 4)} || '], skew=' || {_num_sql(f'({_skew_sql(c)})', 3)} ||
       case when abs(round({_skew_sql(c)}, 3)) > 0.5 then ' (skewed)' else '' end as line from lineitem"""
        for i, c in enumerate(feats))
    x = "l_extendedprice"
    return f"""
with lines as (
select 0 as ord, '=== Data Distribution Summary ===' as line
union all
select 1, 'Target: mean=' || {_num_sql(f'avg({x})', 4)} || ', std=' || {_num_sql(f'stddev_samp({x})', 4)} ||
       ', range=[' || {_num_sql(f'min({x})', 4)} || ', ' || {_num_sql(f'max({x})', 4)} || '], skewness=' ||
       {_num_sql(f'({_skew_sql(x)})', 3)} from lineitem
union all
select 2, 'Target is skewed — consider log transform or robust scaler.' from lineitem
having abs(round({_skew_sql(x)}, 3)) > 1
union all
select 10, chr(10) || 'Features:'
union all
{flines}
union all
select 103, '  l_returnflag: categorical, ' || count(distinct l_returnflag) || ' unique values' from lineitem
union all
select 1000000, chr(10) || 'Based on this distribution, recommend models suited to: class imbalance (if any), skewed features, high-dimensionality, or nonlinearity.'
)
select string_agg(line, chr(10) order by ord) as summary from lines"""


@register("D10_summary_regression", _summary_regression_sql())
def d10_summary_regression(spark, sf):
    """Report text of a regression profile of lineitem (bool/text features as categorical)."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag",
                                              "l_extendedprice")
    return D.summary_text(li, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_extendedprice")


@register("D10_summary_classification", f"""
with d as ({I.DOCS_SQL}),
c as (select quality as k, count(*) as n, round(count(*) / (select count(*) from d)::double, 3) as ratio
      from d where quality is not null group by 1),
b as (select count(*) as n_classes,
             case when min(ratio) > 0 then max(ratio) / min(ratio) else 'inf'::double end as imb from c),
lines as (
select 0 as ord, '=== Data Distribution Summary ===' as line
union all select 1, 'Target: ' || n_classes || ' classes.' from b
union all select 2, 'Class counts: {{' || string_agg(k || ': ' || n, ', ' order by k) || '}}' from c
union all select 3, 'Class ratios: {{' || string_agg('''' || k || ''': ' || {_num_sql('ratio', 3)}, ', ' order by k) || '}}' from c
union all select 4, 'Class imbalance ratio (max/min): ' || {_num_sql('imb', 2)} || ' (' ||
       case when imb < 2.0 then 'balanced' else 'imbalanced — consider class_weight or oversampling' end || ')' from b
union all select 10, chr(10) || 'Features:'
union all select 100, '  n_chars: mean=' || {_num_sql('avg(n_chars)', 4)} || ', std=' ||
       {_num_sql('stddev_samp(n_chars)', 4)} || ', range=[' || {_num_sql('min(n_chars)', 4)} || ', ' ||
       {_num_sql('max(n_chars)', 4)} || '], skew=' || {_num_sql(f"({_skew_sql('n_chars')})", 3)} ||
       case when abs(round({_skew_sql('n_chars')}, 3)) > 0.5 then ' (skewed)' else '' end from d
union all select 101, '  lang: categorical, ' || count(distinct lang) || ' unique values' from d
union all select 102, '  source: categorical, ' || count(distinct source) || ' unique values' from d
union all select 1000000, chr(10) || 'Based on this distribution, recommend models suited to: class imbalance (if any), skewed features, high-dimensionality, or nonlinearity.'
)
select string_agg(line, chr(10) order by ord) as summary from lines""")
def d10_summary_classification(spark, sf):
    """Report text of a classification profile of documents' quality labels."""
    return D.summary_text(I.docs(spark, sf), I.DOCS_FEATURES, "quality", task="classification")


@register("D8_feature_bars", """
with vc as (
  select 'l_returnflag' as "column", l_returnflag as value, count(*) as n from lineitem group by 2
  union all
  select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2),
nu as (select "column", count(*) as n_unique from vc group by 1),
r as (select *, row_number() over (partition by "column" order by n desc, value) as rank from vc)
select r."column", value, n, rank::integer as rank, n_unique from r join nu using ("column") where rank <= 10""")
def d8_feature_bars(spark, sf):
    """Bar data of the text features among the first six plotted features (top 10 each)."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_discount", "l_linestatus")
    return D.feature_bars(li, ["l_quantity", "l_returnflag", "l_discount", "l_linestatus"])
