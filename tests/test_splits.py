import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import splits as T


def table(spark, n, classes=3, parts=8):
    rows = [(i, f"c{(i * 7) % classes if i % 11 else 0}") for i in range(n)]
    return spark.createDataFrame(rows, "k long, y string").repartition(parts)


def test_split_sizes_exact(spark):
    for n in (1, 5, 199, 1000):
        s = T.train_test_split(table(spark, n), ["k"], 0.2, 42)
        counts = {r["split"]: r["c"] for r in s.groupBy("split").agg(F.count("*").alias("c")).collect()}
        assert counts.get("test", 0) == int(np.ceil(0.2 * n)) and counts.get("train", 0) == n - int(np.ceil(0.2 * n))


def test_alloy_split_sizes(spark, alloy):
    s = T.split_and_folds(alloy, alloy.columns)
    c = {(r["split"], r["fold"]): r["n"] for r in s.groupBy("split", "fold").agg(F.count("*").alias("n")).collect()}
    assert c[("test", None)] == 40 and all(c[("train", f)] == 32 for f in range(5))


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_split_does_not_depend_on_partitioning(spark, parts):
    base = sorted(tuple(r) for r in T.split_and_folds(table(spark, 700, parts=3), ["k"]).collect())
    other = sorted(tuple(r) for r in T.split_and_folds(table(spark, 700, parts=parts), ["k"]).collect())
    assert base == other


def test_folds_disjoint_covering_balanced(spark):
    s = T.split_and_folds(table(spark, 1003), ["k"])
    train = s.where("split = 'train'")
    sizes = sorted(r["n"] for r in train.groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert sum(sizes) == train.count() == 1003 - 201
    assert max(sizes) - min(sizes) <= 1
    assert train.select("k").distinct().count() == train.count()
    # first n mod k folds get the extra row
    by_fold = {r["fold"]: r["n"] for r in train.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert [by_fold[f] for f in range(5)] == T.fold_sizes(802, 5)


def test_folds_follow_the_split_order(spark):
    s = T.split_and_folds(table(spark, 300), ["k"])
    rows = s.withColumn("h", F.md5(F.concat(F.col("k").cast("string"), F.lit("|42")))).collect()
    ordered = sorted(rows, key=lambda r: (r["h"], str(r["k"])))
    assert [r["split"] for r in ordered] == ["test"] * 60 + ["train"] * 240
    folds = [r["fold"] for r in ordered[60:]]
    assert folds == sorted(folds)


def sklearn_stratified_allocation(y_sorted_codes, k):
    n_classes = max(y_sorted_codes) + 1
    return np.asarray([np.bincount(y_sorted_codes[i::k], minlength=n_classes) for i in range(k)])


def test_stratified_allocation_matches_bincount_rule():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = rng.integers(1, 40, size=rng.integers(2, 6))
        codes = np.repeat(np.arange(len(counts)), counts)
        want = sklearn_stratified_allocation(codes, 5)
        got = T.stratified_allocation(list(enumerate(int(c) for c in counts)), 5)
        for cls in range(len(counts)):
            assert got[cls] == list(want[:, cls])


def test_stratified_folds_are_contiguous_per_class(spark):
    s = T.split_and_folds(table(spark, 500), ["k"], label="y")
    train = s.where("split = 'train'")
    counts = sorted((r["y"], r["n"]) for r in train.groupBy("y").agg(F.count("*").alias("n")).collect())
    alloc = T.stratified_allocation(counts, 5)
    got = {(r["y"], r["fold"]): r["n"] for r in train.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    for cls, sizes in alloc.items():
        assert [got.get((cls, f), 0) for f in range(5)] == sizes


def test_duplicate_keys_straddling_a_cut(spark, monkeypatch):
    monkeypatch.setattr(T, "EXACT_LIMIT", 5)
    rows = [(1, "same")] * 40 + [(i, f"o{i}") for i in range(2, 62)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(7)
    s = T.train_test_split(df, ["k"], 0.2, 42)
    assert s.where("split = 'test'").count() == 20
    f = T.split_and_folds(df, ["k"])
    sizes = {r["fold"]: r["n"] for r in f.where("split = 'train'").groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert [sizes[i] for i in range(5)] == T.fold_sizes(80, 5)


def test_refinement_with_small_exact_limit(spark, monkeypatch):
    monkeypatch.setattr(T, "EXACT_LIMIT", 3)
    s = T.train_test_split(table(spark, 5000), ["k"], 0.2, 42)
    assert s.where("split = 'test'").count() == 1000


def test_folds_of_many_classes(spark, monkeypatch):
    from collections import Counter
    monkeypatch.setattr(T, "EXACT_LIMIT", 200)
    rows = [(i, i % 1100 if i < 4000 else 7 if i < 4500 else None) for i in range(4600)]
    out = T.stratified_kfold_assign(spark.createDataFrame(rows, "id long, c int").repartition(3), "c", ["id"], 5).collect()
    counts = Counter(c for _, c in rows if c is not None)
    want = T.stratified_allocation(sorted(counts.items()), 5)
    got = Counter((r.c, r.fold) for r in out if r.c is not None)
    assert all(got[c, f] == want[c][f] for c in counts for f in range(5)) and len(out) == len(rows)
    # inside a class the folds follow the rows' order
    order = T.with_order(spark.createDataFrame(rows, "id long, c int").where("c = 7"), ["id"]).orderBy("_h", "_k").collect()
    fold = {r.id: r.fold for r in out}
    assert [fold[r.id] for r in order] == sorted(fold[r.id] for r in order)
