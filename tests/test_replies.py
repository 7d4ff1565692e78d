from fathom.operators import replies as L


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, response string")
    return L.suggestions(df).orderBy("id", "pos").collect()


def test_json_array_and_package_rules(spark):
    t = ('```json\n[{"model_name": "Ridge", "package": "sklearn.linear_model", "import_path": "x", "reason": "r"},'
         ' {"model_name": "XGBRegressor", "package": "xgboost", "reason": "q"}]\n```')
    rows = run(spark, [t])
    assert [(r["model_name"], r["package"], r["import_path"]) for r in rows] == [
        ("Ridge", "scikit-learn", "sklearn.linear_model.Ridge"), ("XGBRegressor", "xgboost", "xgboost.XGBRegressor")]


def test_old_line_format_and_prose_get_default(spark):
    rows = run(spark, ["MODEL: XGBRegressor\nPACKAGE: xgboost", "1. Load the data\n2. Train"])
    assert [(r["id"], r["model_name"]) for r in rows] == [(0, "RandomForestRegressor"), (1, "RandomForestRegressor")]


def test_mixed_array(spark):
    t = ('```\n[{"model_name": "Lasso", "package": "sklearn", "reason": "see [b]"}, 42, '
         '{"model_name": "catty", "package": "x", "import_path": "catboost.Foo", "reason": null}, '
         '{"model_name": "nopath", "package": "x", "reason": "y"}, {"model_name": "Ridge"}]\n``` then [more]')
    rows = run(spark, [t])
    assert [(r["pos"], r["model_name"], r["package"], r["reason"]) for r in rows] == [
        (0, "Lasso", "scikit-learn", "see [b]"), (2, "catty", "catboost", None)]


def test_unbalanced_bracket_yields_default(spark):
    rows = run(spark, ['[{"model_name": "Lasso", "package": "s", "reason": "a [ b"}'])
    assert rows[0]["model_name"] == "RandomForestRegressor"


def test_single_object(spark):
    rows = run(spark, ['Sure! {"model_name": "SVC", "package": "scikit-learn", "reason": "margin"} done'])
    assert [(r["model_name"], r["import_path"]) for r in rows] == [("SVC", "sklearn.svm.SVC")]


def test_import_path_without_dot(spark):
    rows = run(spark, ['[{"model_name": "M", "package": "p", "import_path": "solo", "reason": "r"}]'])
    assert rows[0]["package"] == "solo"


def test_plan_parsing_and_default(spark):
    t = ('[{"action": "select_model", "description": "pick"}, {"action": "report"}, '
         '{"action": "train"}, {"action": "evaluate", "description": null}]')
    df = spark.createDataFrame([(0, t), (1, "no plan here")], "id long, response string")
    plan = L.parse_plan(df).orderBy("id", "pos").collect()
    assert [(r["id"], r["action"], r["description"]) for r in plan[:3]] == [
        (0, "select_model", "pick"), (0, "train", ""), (0, "evaluate", "None")]
    assert [r["action"] for r in plan if r["id"] == 1] == list(L.PLAN_ACTIONS)
    steps = L.plan_descriptions(L.parse_plan(df)).where("id = 1").orderBy("pos").collect()
    assert steps[0]["step"] == "Select ML model based on data distribution"


def test_package_rules_for_known_and_unknown_models(spark):
    t = ('[{"model_name": "XGBRegressor", "package": "xgboost.sklearn", "reason": "a"},'
         ' {"model_name": "Ridge", "package": " SKLEARN ", "reason": "b"},'
         ' {"model_name": "Mine", "package": "x", "import_path": "sklearn.custom.Mine", "reason": "c"},'
         ' {"model_name": "Other", "package": "x", "import_path": "lightgbm.Other", "reason": "d"}]')
    rows = run(spark, [t])
    assert [(r["model_name"], r["package"], r["import_path"]) for r in rows] == [
        ("XGBRegressor", "scikit-learn", "xgboost.XGBRegressor"),
        ("Ridge", "scikit-learn", "sklearn.linear_model.Ridge"),
        ("Mine", "scikit-learn", "sklearn.custom.Mine"),
        ("Other", "lightgbm", "lightgbm.Other")]


def test_invalid_json_and_non_array_yield_default(spark):
    rows = run(spark, ['[{"model_name": "Ridge", "package": "s", "reason": }]', '[1, 2, 3]'])
    assert [(r["id"], r["model_name"]) for r in rows] == [(0, "RandomForestRegressor"), (1, "RandomForestRegressor")]
