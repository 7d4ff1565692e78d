import os

import pytest
from pyspark.sql import functions as F

from fathom.bundle import DatasetRoles
from fathom.operators import prepare as P
from fathom.sources.csv import csv_source
from fathom.sources.synthetic import synthetic_alloy_range


def write(tmp_path, text):
    p = os.path.join(tmp_path, "t.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_type_inference_follows_pandas(spark, tmp_path):
    p = write(str(tmp_path), "i,f,b,d,na,m\n1,1.5,True,2024-01-01,NA,1\n2,2,False,2024-01-02,x,\n")
    df = csv_source(spark, p)
    assert [f.dataType.simpleString() for f in df.schema.fields] == \
        ["bigint", "double", "boolean", "string", "string", "double"]
    rows = df.orderBy("i").collect()
    assert rows[0]["na"] is None and rows[1]["na"] == "x" and rows[1]["m"] is None


def test_csv_bool_with_nulls_stays_text(spark, tmp_path):
    p = write(str(tmp_path), "b,y\ntrue,1\n,2\nFALSE,3\n")
    df = csv_source(spark, p)
    assert df.schema["b"].dataType.simpleString() == "string"
    assert [r["b"] for r in df.orderBy("y").collect()] == ["True", None, "False"]


def test_csv_missing_path_raises(spark):
    with pytest.raises(ValueError):
        csv_source(spark, None)
    with pytest.raises(FileNotFoundError):
        csv_source(spark, "/nonexistent/file.csv")


def test_synthetic_is_seeded_and_layout_free(spark):
    a = synthetic_alloy_range(spark, 300, random_seed=7).df
    b = synthetic_alloy_range(spark, 300, random_seed=7).df.repartition(13)
    assert sorted(a.collect()) == sorted(b.collect())
    r = a.agg(F.min("Al_conc_wt_pct"), F.max("Al_conc_wt_pct"), F.min("process_time_h")).first()
    assert 0 <= r[0] and r[1] <= 6 and r[2] >= 0.5


def test_drop_missing_counts_unused_column_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, float("nan"), "u"), (3.0, 4.0, "v")], "a double, b double, c string")
    kept, counts = P.drop_missing(df)
    assert kept.count() == 1
    assert tuple(counts.first()) == (3, 1, 2)


def test_resolve_roles_precedence():
    cols = ["a", "b", "c"]
    assert P.resolve_roles(cols, {"target": "b", "features": ["a"]}) == (["a"], "b")
    assert P.resolve_roles(cols, {"target": "b"}) == (["a", "c"], "b")
    assert P.resolve_roles(cols, {"features": ["a"]}) == (["a", "b"], "c")
    syn = list(P.SYNTHETIC_FEATURES) + ["x", P.SYNTHETIC_TARGET]
    assert P.resolve_roles(syn, {}) == (list(P.SYNTHETIC_FEATURES), P.SYNTHETIC_TARGET)


def test_label_encode_dense_ordered_with_nan_class(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4), ("é", 5)], "s string, k int")
    enc, d = P.label_encode(df, ["s", "k"])
    assert [r["s"] for r in enc.orderBy("k").collect()] == [1, 0, 2, 1, 3]
    assert [(r["code"], r["class"]) for r in d.orderBy("code").collect()] == [(0, "a"), (1, "b"), (2, "nan"), (3, "é")]


def test_label_encode_range_partitioned_path(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_IN_ONE_TASK_LIMIT", 10)
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(500)] + [("v0001",)], "s string")
    enc, d = P.label_encode(df, ["s"])
    codes = sorted(r["code"] for r in d.collect())
    assert codes == list(range(500))
    assert enc.where("s = 1").count() == 2


def test_contract_violations_and_raise(spark):
    roles = DatasetRoles(("a", "zz"), "t", {"a": "m"}, "src", "desc")
    assert P.contract_violations(["a", "t"], roles) == [("missing_feature", "zz"), ("missing_unit", "zz"),
                                                       ("missing_unit", "t")]
    df = spark.createDataFrame([(1, 2)], "a int, t int")
    with pytest.raises(ValueError, match="Missing feature columns"):
        P.validate_contract(df, roles)
    P.validate_contract(df, DatasetRoles(("a",), "t", {}, "s", "d"))
    with pytest.raises(ValueError, match="source"):
        P.validate_contract(df, DatasetRoles(("a",), "t", {}, "", "d"))


def test_default_units():
    assert P.default_units(list(P.SYNTHETIC_FEATURES), P.SYNTHETIC_TARGET, {}) == P.SYNTHETIC_UNITS
    assert P.default_units(["a"], "b", {}) == {}
    assert P.default_units(["a"], "b", {"a": "m"}) == {"a": "m"}


def test_profile_columns(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, "y"), (3, "y")], "a int, b string")
    rows = {r["column"]: r for r in P.profile_columns(df).collect()}
    assert (rows["a"]["n_unique"], rows["a"]["null_pct"]) == (3, 0.0)
    assert (rows["b"]["n_unique"], rows["b"]["null_pct"]) == (2, 25.0)


def test_loader_attaches_roles_and_units(spark, alloy):
    from fathom.sources.tables import load_table
    b = load_table(spark, {"df": alloy, "path": "alloy.csv"})
    assert b.df.schema["hardness_HV"].metadata == {"role": "target", "unit": "HV"}
    assert b.df.schema["Al_conc_wt_pct"].metadata["role"] == "feature"
    assert b.roles.description.startswith("Dataset loaded from 'alloy.csv'")


def test_drop_missing_computes_each_column_once(spark):
    """Synthetic rows take 7 draws: 5 for the features, and all 7 for the target."""
    kept, _ = P.drop_missing(synthetic_alloy_range(spark, 5, random_seed=7).df)
    plan = kept.agg(F.count(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 12 and kept.count() == 5


def test_csv_fields_are_taken_apart_once(spark, tmp_path, monkeypatch):
    from fathom.sources import csv as C
    kept, written = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: kept.append(name) or written(df, name))
    p = write(str(tmp_path), 'a,b,c,d\n1,"x\ny",1e3, .5 \n2,"z",-7.,+INF\nNA,"5d",0x1p3,nan\n')
    df = csv_source(spark, p)
    assert kept == ["csv_fields"] and "from_csv" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["double", "string", "string", "double"]
    rows = {r.b: r for r in df.collect()}
    assert rows["x\ny"].d == 0.5 and rows["z"].d == float("inf") and rows["5d"].a is None and rows["5d"].c == "0x1p3"
