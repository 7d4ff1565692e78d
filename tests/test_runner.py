import pytest

from fathom.plans.runner import compare_models, run_pipeline
from fathom.sources.tables import load_table

FEATS = ["Al_conc_wt_pct", "Ti_conc_wt_pct", "V_conc_wt_pct", "process_temperature_C", "process_time_h"]


def test_full_run_with_search(spark, alloy):
    r = run_pipeline(spark, {"df": alloy, "path": "alloy.csv"}, fixed_model="Ridge")
    assert r.suggestion[0] == "Ridge"
    assert r.best["params"]["alpha"] in (0.01, 0.1, 1.0, 10.0)
    m = r.metrics.first()
    assert m["n"] == 40 and m["R2"] > 0.6
    assert r.interpretation.first()["verdict"].startswith("Model: Ridge | Task: regression")
    assert len(r.steps) == 4


def test_plan_without_train_skips_later_steps(spark, alloy):
    r = run_pipeline(spark, {"df": alloy, "path": "alloy.csv"}, fixed_model="Ridge",
                     plan=[("select_model", "pick"), ("evaluate", "eval"), ("interpret", "say")])
    assert r.metrics is None and r.interpretation is None and r.suggestion[0] == "Ridge"


def test_unknown_fixed_model_lists_valid_names(spark, alloy):
    with pytest.raises(ValueError, match="Valid: \\['AdaBoostRegressor'"):
        run_pipeline(spark, {"df": alloy, "path": "alloy.csv"}, fixed_model="NoSuchModel")


def test_compare_models_orders_best_first(spark, alloy):
    b = load_table(spark, {"df": alloy, "path": "alloy.csv"})
    rows = compare_models(spark, b, ["Lasso", "LinearRegression"]).collect()
    assert [r["model"] for r in rows] == sorted([r["model"] for r in rows], key=lambda m: -[x["R2"] for x in rows if x["model"] == m][0])
