import math

import pytest
from pyspark.sql import functions as F

from fathom.operators import profile as D
from fathom.functions.stats import adjusted_skewness


def one_col(spark, values, name="x", typ="double"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {typ}")


def test_adjusted_skewness_matches_pandas_g1(spark):
    df = one_col(spark, [1.0, 2.0, 10.0, 4.0, 4.5])
    assert df.agg(adjusted_skewness("x")).first()[0] == pytest.approx(1.3402673, abs=1e-7)


@pytest.mark.parametrize("values", [[1.0, 1.0, 1.0], [1.0, 2.0], [5.0]])
def test_adjusted_skewness_degenerate_is_zero(spark, values):
    assert one_col(spark, values).agg(adjusted_skewness("x")).first()[0] == 0.0


def test_target_summary_single_value_has_null_std(spark):
    r = D.target_summary(one_col(spark, [3.0]), "x").first()
    assert r["count"] == 1 and r["std"] is None and r["p25"] == 3.0 and r["skewness"] == 0.0


def test_target_summary_ignores_text(spark):
    df = one_col(spark, ["1", "2", "x", None, "NaN", "4"], typ="string")
    r = D.target_summary(df, "x").first()
    assert r["count"] == 3 and r["mean"] == pytest.approx(7 / 3, abs=1e-4)


def test_quartiles_interpolate_like_pandas(spark):
    import numpy as np
    vals = [float(v) for v in np.random.default_rng(1).normal(size=1001)] + [7.0] * 400
    r = D.target_summary(one_col(spark, vals), "x").first()
    for p, k in ((25, "p25"), (50, "p50"), (75, "p75")):
        assert r[k] == pytest.approx(round(float(np.percentile(vals, p)), 4), abs=1e-4)


def test_order_statistics_refine_past_one_pass(spark):
    from fathom.operators.quantiles import order_statistics
    vals = [float(i % 977) + i * 1e-6 for i in range(20000)]
    df = one_col(spark, vals)
    got = order_statistics(df, "x", [0, 5000, 19999], bins=16, collect_limit=50)
    s = sorted(vals)
    assert got == {0: s[0], 5000: s[5000], 19999: s[19999]}


def test_class_counts_total_includes_null_target(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "y string")
    rows = {r["class"]: (r["n"], r["ratio"]) for r in D.class_counts(df, "y").collect()}
    assert rows == {"a": (2, 0.5), "b": (1, 0.25)}


def test_class_balance_tiny_class_is_infinite(spark):
    df = spark.createDataFrame([("a",)] * 2500 + [("b",)], "y string")
    r = D.class_balance(df, "y").first()
    assert r["n_classes"] == 2 and math.isinf(r["imbalance_ratio"]) and r["balanced"] is False


def test_histogram_constant_column_and_max_value(spark):
    h = D.target_histogram(one_col(spark, [4.0] * 5), "x", 30).where("n > 0").collect()
    assert [(r["bin"], r["n"]) for r in h] == [(15, 5)]
    h25 = D.histograms(one_col(spark, [4.0] * 3).select(F.lit("x").alias("column"), F.col("x").alias("value")), 25)
    assert [(r["bin"], r["n"]) for r in h25.where("n > 0").collect()] == [(12, 3)]
    h2 = D.target_histogram(one_col(spark, [0.0, 1.0, 2.0, 3.0]), "x", 3).collect()
    assert [r["n"] for r in h2] == [1, 1, 2]


def test_numeric_feature_stats_all_null_and_missing(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, None, "b")], "a double, b double, c string")
    rows = D.numeric_feature_stats(df, ["a", "b", "c", "zzz"]).collect()
    assert [r["column"] for r in rows] == ["a", "b"]
    assert rows[1]["note"] == "all null" and rows[1]["mean"] is None
    assert rows[0]["n_unique"] == 2


def test_categorical_top_values_ties_to_smaller_value(spark):
    vals = [("z",)] * 3 + [(chr(97 + i),) for i in range(20)]
    df = spark.createDataFrame(vals, "c string")
    rows = D.categorical_feature_stats(df, ["c"]).collect()
    assert [r["value"] for r in rows][:3] == ["z", "a", "b"]
    assert len(rows) == 10 and rows[0]["n_unique"] == 21


def test_alloy_golden_statistics(spark, alloy):
    r = D.target_summary(alloy, "hardness_HV").first()
    assert (r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"], r["skewness"]) == \
        (200, 175.4713, 11.6511, 147.9555, 166.6897, 175.2041, 183.3961, 208.8997, 0.266)
    h = [x["n"] for x in D.target_histogram(alloy, "hardness_HV", 30).collect()]
    assert h == [1, 0, 2, 5, 3, 7, 7, 14, 10, 9, 15, 13, 8, 13, 12, 10, 14, 14, 10, 6, 12, 3, 3, 2, 2, 0, 1, 0, 1, 3]
    h2 = D.feature_histograms(alloy, ["process_time_h"], 25).collect()
    assert [x["n"] for x in h2] == [8, 8, 6, 9, 12, 7, 11, 6, 7, 5, 11, 8, 6, 6, 9, 8, 10, 6, 7, 11, 12, 6, 6, 11, 4]
    fs = {x["column"]: x for x in D.numeric_feature_stats(alloy, ["Al_conc_wt_pct", "process_time_h"]).collect()}
    assert fs["Al_conc_wt_pct"]["mean"] == 3.194 and fs["Al_conc_wt_pct"]["skewness"] == -0.073


def test_summary_text_lines(spark, alloy):
    feats = ["Al_conc_wt_pct", "Ti_conc_wt_pct", "V_conc_wt_pct", "process_temperature_C", "process_time_h"]
    text = D.summary_text(alloy, feats, "hardness_HV").first()["summary"]
    lines = text.split("\n")
    assert lines[0] == "=== Data Distribution Summary ==="
    assert lines[1] == "Target: mean=175.4713, std=11.6511, range=[147.9555, 208.8997], skewness=0.266"
    assert lines[3] == "Features:"
    assert lines[4].startswith("  Al_conc_wt_pct: mean=3.194, std=1.7072, range=[0.0119, 5.9955], skew=-0.073")
    assert text.endswith("or nonlinearity.")


def test_boolean_values_print_like_python(spark):
    df = spark.createDataFrame([(True,), (False,), (True,), (None,)], "b boolean")
    rows = D.categorical_feature_stats(df, ["b"]).collect()
    assert [(r["value"], r["n"]) for r in rows] == [("True", 2), ("False", 1)]


def test_order_statistics_of_infinities_and_heavy_tails(spark):
    import numpy as np
    from fathom.operators.quantiles import interpolated_quantiles, order_statistics_of
    inf = float("inf")
    a = [inf] + [float(i) for i in range(998)] + [-inf]
    b = [(-1.0) ** i * 10.0 ** (i % 600 - 300) for i in range(1000)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, `b b` double").repartition(3)
    df = df.union(spark.createDataFrame([(None, float("nan")), (float("nan"), None)], df.schema))
    ranks = [0, 1, 250, 500, 998, 999]
    for limit in (0, 50_000):
        got = order_statistics_of(df, {"a": ranks, "b b": ranks}, collect_limit=limit)
        assert got["a"] == {r: sorted(a)[r] for r in ranks} and got["b b"] == {r: sorted(b)[r] for r in ranks}
    assert interpolated_quantiles(df, "a", [0.0, 0.5, 1.0], collect_limit=10) == {0.0: -inf, 0.5: float(np.median(a)), 1.0: inf}
    hot = spark.range(1000).selectExpr("if(id < 700, 5D, id) as x")
    assert order_statistics_of(hot, {"x": [10, 699, 700]}, collect_limit=0)["x"] == {10: 5.0, 699: 5.0, 700: 700.0}


def test_target_summary_with_an_infinity(spark):
    inf = float("inf")
    r = D.target_summary(one_col(spark, [float(i) for i in range(999)] + [inf]), "x").first()
    assert (r["count"], r["max"], r["mean"], r["p50"]) == (1000, inf, inf, 499.5) and r["std"] != r["std"]
    assert "range=[0" in D.summary_text(one_col(spark, [1.0, inf, 0.0]).withColumnRenamed("x", "y"), [], "y").first()[0]
