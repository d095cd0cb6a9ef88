import pytest
from pyspark.sql import functions as F

from tabrig.operators import prep as P
from tabrig.operators import split as M
from tabrig.operators import task as T
from tabrig.sources.tables import load


def test_task_rules_on_loan(loan):
    assert T.detect_task(loan, "Loan_Approved").first()["problem_type"] == "classification"
    r = T.infer_task(loan, "Loan_Approved").first()
    assert r["task_type"] == "classification" and r["confidence"] == 0.706
    r2 = T.infer_task(loan, "Income").first()  # 20 distinct integers: still "low cardinality"
    assert r2["task_type"] == "classification" and r2["is_integer_like"] is True
    assert r2["reason"].startswith("Integer-like numeric with low cardinality") and r2["confidence"] == 0.643
    assert T.task_hint(loan, "Loan_Approved").first()["task_hint"] == "classification"


def test_two_value_float_target(spark):
    d = spark.createDataFrame([(float(i % 2) + 0.5,) for i in range(100)], "t double")
    r = T.infer_task(d, "t").first()
    assert r["task_type"] == "classification" and r["is_integer_like"] is False


def test_model_portfolios():
    assert T.model_portfolio("classification", "most_explainable") == ["logistic_regression", "decision_tree"]
    assert len(T.model_portfolio("regression")) == 4
    try:
        T.model_portfolio("clustering")
    except ValueError:
        pass
    else:
        raise AssertionError


def test_split_partition_invariant_and_complete(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    a = {r[0] for r in M.split(o, "o_orderkey")[1].collect()}
    b = {r[0] for r in M.split(o.repartition(7), "o_orderkey")[1].collect()}
    assert a == b
    tr, te = M.split(o, "o_orderkey")
    keys_tr = {r[0] for r in tr.select("o_orderkey").collect()}
    assert keys_tr.isdisjoint(a) and len(keys_tr | a) == o.count()


def test_stratified_quotas_exact(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    m = M.mark_split_stratified(o, "o_orderstatus", "o_orderkey", 0.2)
    n = o.count()
    assert m.where("is_test").count() == -(-n * 2 // 10)
    per = {r[0]: (r[1], r[2]) for r in m.groupBy("o_orderstatus").agg(F.count("*"), F.count_if("is_test")).collect()}
    for c, (tot, test) in per.items():
        assert abs(test - tot * 0.2) <= 1, c
    assert M.can_stratify(o, "o_orderstatus", "classification")
    assert not M.can_stratify(o, "o_orderstatus", "regression")


def test_stratified_split_samples_a_missing_class(spark):
    rows = [(i, ["a", "b", None][i % 3]) for i in range(300)]
    d = spark.createDataFrame(rows, "k long, y string")
    got = {r[0]: r[1] for r in M.mark_split_stratified(d, "y", "k", 0.2).groupBy("y").agg(F.count_if("is_test")).collect()}
    assert got == {"a": 20, "b": 20, None: 20}
    q = {r[0]: r["t_c"] for r in M.stratified_quotas(d.where("k < 10"), "y", 0.2).collect()}
    assert sum(q.values()) == 2


@pytest.mark.parametrize("hashes", [None, 1, 3, 1 << 20])
def test_stratified_threshold_equals_ranking_all_rows(spark, monkeypatch, hashes):
    """With few different hashes the key decides; dotted names, a null class, classes of one row."""
    if hashes:
        monkeypatch.setattr(M, "hash_u32", lambda key, seed=42: F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), F.lit(hashes)))
    rows = [(f"k{i * 7919 % 1000:04d}", ["a", "b", None, "a.b"][i % 4] if i else "one") for i in range(1000)]
    df = spark.createDataFrame(rows, "`k.x` string, `y.x` string").repartition(7)
    got = {r[0]: (r[1], r[2]) for r in M.mark_split_stratified(df, "y.x", "k.x", 0.3).collect()}
    u = {r[0]: r[1] for r in df.select("`k.x`", M.hash_u32("k.x", 42)).collect()}
    quota = {r[0]: r["t_c"] for r in M.stratified_quotas(df, "y.x", 0.3).collect()}
    assert sum(quota.values()) == 300 and len(got) == 1000
    for c, t in quota.items():
        order = sorted((u[k], k) for k, y in rows if y == c)
        assert {k for _, k in order[:t]} == {k for k, (y, test) in got.items() if y == c and test}


def test_stratified_marks_are_one_map_only_pass(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    plan = M.mark_split_stratified(o, "o_orderstatus", "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_stratified_split_of_many_classes(spark, monkeypatch):
    monkeypatch.setattr(M, "THRESHOLDS_BROADCAST", 3)
    df = spark.range(4000).selectExpr("id AS k", "id % 500 AS y")
    got = M.mark_split_stratified(df, "y", "k", 0.25)
    assert got.where("is_test").count() == 1000 and got.count() == 4000
    assert got.limit(0).count() == 0 and M.mark_split_stratified(df.limit(0), "y", "k").count() == 0


def test_preprocessor_unseen_category_and_zero_std(spark, tmp_path):
    train = spark.createDataFrame([(1, 5.0, "a"), (2, 5.0, "b"), (3, None, "a")], "k long, x double, c string")
    prep = P.build_preprocessor(train, row_key="k")
    assert prep.feature_names == ["x", "c_a", "c_b"]
    assert prep.stats["scale"]["x"] == (5.0, 1.0)  # zero std -> divide by 1
    new = spark.createDataFrame([(9, 7.0, "zzz"), (10, None, None)], "k long, x double, c string")
    out = {r["k"]: r for r in P.to_wide(prep.transform(new), prep, ["k"]).collect()}
    assert (out[9]["x"], out[9]["c_a"], out[9]["c_b"]) == (2.0, 0.0, 0.0)  # unseen -> zeros
    assert (out[10]["x"], out[10]["c_a"]) == (0.0, 1.0)  # imputed median / mode
    from tabrig.sources.io import load_model, save_model
    path = str(tmp_path / "prep")
    save_model(prep.model, path)
    again = load_model(path).transform(new).select("features").collect()
    assert again == prep.transform(new).select("features").collect()


def test_transform_requires_fitted_and_columns(spark):
    df = spark.createDataFrame([(1, 1.0)], "k long, x double")
    try:
        P.transform(None, df)
    except RuntimeError:
        pass
    else:
        raise AssertionError
    prep = P.build_preprocessor(df, row_key="k")
    try:
        P.transform(prep, df.drop("x"), row_key="k")
    except ValueError as e:
        assert "Missing expected columns" in str(e)
    else:
        raise AssertionError
