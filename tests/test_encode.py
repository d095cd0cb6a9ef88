import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabrig.operators import prep as P
from tabrig.operators.encode import TableEncoder, category_dictionary, category_values
from tabrig.operators.task import infer_task
from tabrig.sources.io import load_model, save_model


def table(spark):
    rows = [(1, 1.0, 10, "b", "x", None), (2, None, 20, "a", None, None), (3, float("nan"), 30, None, "x", None), (4, 3.0, None, "b", "y", None)]
    return spark.createDataFrame(rows, "k long, `x.1` double, n long, `c.1` string, d string, empty string")


def by_row(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], {})[r[1]] = round(r[2], 9)
    return out


def test_vectors_and_long_form_agree(spark):
    df = table(spark)
    prep = P.build_preprocessor(df, row_key="k")
    names = prep.feature_names
    assert names == ["x.1", "n", "c.1_a", "c.1_b", "d_x", "d_y"] and prep.dropped == ["empty"]
    assert prep.encoder.width == 6 and [r["feature"] for r in P.feature_names(prep).orderBy("idx").collect()] == names
    long = by_row(prep.encoder.long_features(df, "k").collect())
    for r in prep.transform(df).collect():
        want = dict.fromkeys(names, 0.0) | long[r["k"]]
        assert [round(v, 9) for v in r["features"].toArray()] == [want[n] for n in names]
    assert P.transform(prep, df, "k").columns == ["k", *names]


def test_unknown_null_and_repeated_rows(spark):
    prep = P.build_preprocessor(table(spark), row_key="k")
    rows = [(7, 2.0, 1, "zz", None, None), (8, None, None, None, "y", None), (8, None, None, None, "y", None)]
    new = spark.createDataFrame(rows, "k long, `x.1` double, n long, `c.1` string, d string, empty string")
    hits = {k: {f for f in v if "_" in f} for k, v in by_row(prep.encoder.long_features(new, "k").collect()).items()}
    assert hits == {7: {"d_x"}, 8: {"c.1_b", "d_y"}}
    assert prep.transform(new).count() == 3 and P.transform_long(prep, new, "k").where("k = 8").count() == 4
    assert prep.transform(new.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        P.transform_long(None, new, "k")


def test_numbers_alone_make_dense_vectors(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "k long, x double")
    prep = P.build_preprocessor(df, row_key="k")
    assert [list(r["features"]) for r in prep.transform(df).orderBy("k").collect()] == [[-1.0], [1.0]]
    assert prep.transform(df).where("k > 1").first()["features"].toArray().tolist() == [1.0]


def test_dictionary_is_numbered_by_column_and_value(spark):
    df = spark.createDataFrame([(i, f"v{i % 700:04d}", "hot" if i % 3 else f"w{i}") for i in range(2100)], "k long, a string, b string")
    values = category_values(df, ["b", "a"])
    got, sizes = category_dictionary(values, ["b", "a"], 5)
    assert sizes == {"b": 701, "a": 700}
    rows = got.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(5, 5 + 1401))
    want = [("b", v) for v in sorted({r["b"] for r in df.collect()})] + [("a", f"v{i:04d}") for i in range(700)]
    assert [(r["column_name"], r["v"]) for r in rows] == want


def test_nearly_unique_column_stays_a_table(spark):
    """As many values as rows: nothing of them is in the encoder's own state."""
    df = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("value-"), "id").alias("c"), (F.col("id") % 7).alias("n"))
    prep = P.build_preprocessor(df, row_key="k")
    assert prep.encoder.width == 20_001 and len(str(prep.stats)) < 500
    assert prep.encoder.long_features(df, "k").count() == 40_000
    r = prep.transform(df.where("k = 123")).first()["features"]
    assert r.size == 20_001 and len(r.indices) == 2 and r.values[1] == 1.0


def test_saved_and_loaded(spark, tmp_path):
    df = table(spark)
    prep = P.build_preprocessor(df, row_key="k")
    save_model(prep.model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    assert isinstance(again, PipelineModel) and isinstance(again.stages[0], TableEncoder)
    assert again.stages[0].numeric == prep.encoder.numeric and again.stages[0].uid == prep.encoder.uid
    assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, prep.transform(df).collect()))
    save_model(again, str(tmp_path / "m2"))  # what was loaded can be saved
    assert load_model(str(tmp_path / "m2")).transform(df).count() == 4


def test_dotted_names_in_inference_alignment_and_jobs(spark):
    from tabrig.plans import run_experiment_b
    rows = [(i, float(i * 7 % 60), "ab"[i % 2], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, ["k", "a.1", "c.x", "y.t"])
    assert infer_task(df, "y.t").first()["task_type"] == "classification"
    assert P.align_columns(df, ["c.x", "a.1"]).columns == ["c.x", "a.1"]
    ft = P.fit_transform(df, "y.t", "k")
    assert ft.features.columns == ["k", "a.1", "c.x_a", "c.x_b"] and ft.features_long.count() == 120
    assert P.transform(ft.preprocessor, df.drop("y.t"), "k").count() == 60
    out = run_experiment_b(df, "y.t", "dotted", "k", params={"num_trees": 3, "gbt_iters": 3, "max_depth": 3})
    assert out["task"] == "classification" and not out["errors"]
