import pytest
from pyspark.sql import functions as F

from tabrig.operators import review as R
from tabrig.operators.train import train_portfolio
from tabrig.sources import history as H
from tabrig.sources.io import check_dataset, read_table_csv, write_table_csv
from tabrig.sources.tables import dirty_orders, load


def test_review_b_flags_leakage(spark):
    rows = [(i, f"c{i % 3}", i % 3, "yes" if i % 3 == 0 else "no") for i in range(300)]
    d = spark.createDataFrame(rows, "k long, grp string, num long, t string").withColumn("copy", F.col("t"))
    found = [(r["rule"], r["column_name"]) for r in R.review_b(d, "t", row_key="k").collect()]
    assert ("exact_match", "copy") in found
    assert ("group_purity", "grp") in found and ("group_purity", "num") in found


def test_review_b_small_and_loan(loan):
    rows = R.review_b(loan, "Loan_Approved", top_accuracy=0.99).collect()
    rules = [r["rule"] for r in rows]
    assert rules[0] == "size" and "very small" in rows[0]["finding"]
    assert "score" in rules


def test_review_a_messages(loan):
    rows = R.review_a(loan, "Loan_Approved", "classification", 0.99, "most_explainable").collect()
    assert [r["rule"] for r in rows] == ["size", "score", "goal"]
    assert R.business_recommendation(None, None).startswith("Run the full experiment")


def test_portfolio_beats_baseline_on_signal(spark, sf):
    li = load(spark, sf, "lineitem").select(
        "l_extendedprice", "l_discount", "l_returnflag",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    tr = train_portfolio(li, "revenue", ["linear_regression", "decision_tree_regressor"], "regression")
    r2 = {r["model"]: r["r2"] for r in tr.metrics.collect()}
    assert r2["linear_regression"] > 0.95 and r2["decision_tree_regressor"] > 0.5
    tr.unpersist()


def test_portfolio_b_records_failures(spark, sf):
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars", "lang",
                                                                                       "quality")
    tr = train_portfolio(d, "quality", ["logistic_regression", "no_such_model"], "classification", "doc_id",
                         mode="B")
    m = {r["model"]: r for r in tr.metrics.collect()}
    assert m["no_such_model"]["error"] and m["logistic_regression"]["accuracy"] is not None
    with pytest.raises(ValueError):
        train_portfolio(d, "quality", ["no_such_model"], "classification", "doc_id", mode="A")


def test_history_upsert_and_append(spark):
    h = spark.createDataFrame([("e1", 1, "a"), ("e2", 2, "b")], "experiment_id string, ingest_seq long, v string")
    new = spark.createDataFrame([("e1", 3, "c")], "experiment_id string, ingest_seq long, v string")
    got = {r["experiment_id"]: r["v"] for r in H.history_upsert(h, new).collect()}
    assert got == {"e1": "c", "e2": "b"}
    empty = H.history_upsert(None, new)
    assert empty.count() == 1
    batch = spark.createDataFrame([("x", 2), ("y", 1)], "name string, t long")
    log = spark.createDataFrame([(5, "old")], "id long, name string")
    ids = {r["name"]: r["id"] for r in H.history_append(log, batch, ["t"]).collect()}
    assert ids == {"y": 6, "x": 7}


def test_csv_roundtrip_with_na_tokens(spark, sf, tmp_path):
    d = dirty_orders(spark, sf)
    path = write_table_csv(d, str(tmp_path / "dirty"))
    back = read_table_csv(spark, path)
    types = dict(back.dtypes)
    assert types["price"] == "double" and types["rid"] == "bigint" and types["status"] == "string"
    assert back.where(F.col("price").isNull()).count() == d.where(F.col("price").isNull()).count()
    with pytest.raises(ValueError):
        check_dataset(back, "nope")
    with pytest.raises(ValueError):
        check_dataset(back.select("rid"))


def test_stream_scoring(spark, tmp_path):
    from tabrig.operators.prep import build_preprocessor
    from tabrig.streaming import score_stream
    train = spark.createDataFrame([(1, 1.0, "a"), (2, 3.0, "b")], "k long, x double, c string")
    prep = build_preprocessor(train, row_key="k")
    src = tmp_path / "in"
    train.write.parquet(str(src))
    stream = spark.readStream.schema(train.schema).parquet(str(src))
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegression
    lr = LinearRegression(featuresCol="features", labelCol="x").fit(prep.transform(train))
    model = PipelineModel(stages=list(prep.model.stages) + [lr])
    q = score_stream(stream, model, ["k"]).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM scored").count() == 2


def test_csv_dialect_and_number_patterns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,x.1,a,flag,text\n1,1d,1.5,true,"x ""q"" y"\n2,2f,-2e3,,"two\nlines"\n3,7d,.5,false,z\n')
    back = read_table_csv(spark, str(path))
    assert dict(back.dtypes) == {"id": "bigint", "x.1": "string", "a": "double", "flag": "string", "text": "string", "_row_id": "bigint"}
    rows = back.orderBy("id").collect()
    assert [r["text"] for r in rows] == ['x "q" y', "two\nlines", "z"]
    from tabrig.operators.profile import describe_numeric, duplicate_count, missing_by_column
    assert {r["column_name"]: r["missing"] for r in missing_by_column(back, "_row_id").collect()}["x.1"] == 0
    assert duplicate_count(back, "_row_id").first()[0] == 0
    assert describe_numeric(back, "_row_id").count() == 2


def test_dotted_columns_clean_and_encode(spark):
    rows = [(i, float(i % 3), "ab"[i % 2], i % 2) for i in range(12)] + [(12, 0.0, "a", 0)]
    df = spark.createDataFrame(rows, ["k", "a.1", "c.x", "y.t"])
    from tabrig.operators.clean import clean
    from tabrig.operators.prep import build_preprocessor
    res = clean(df, "y.t", "k")
    assert res.summary["rows_removed"] == 7 and res.log.count() == 7
    prep = build_preprocessor(df, target="y.t", row_key="k")
    assert prep.feature_names == ["a.1", "c.x_a", "c.x_b"]


def test_many_categories_and_classes_are_kept(spark):
    from tabrig.operators.prep import build_preprocessor
    df = spark.createDataFrame([(i, f"v{i:05d}", float(i)) for i in range(1500)], "k long, c string, x double")
    prep = build_preprocessor(df, row_key="k")
    assert len(prep.feature_names) == 1501 and not prep.dropped
    from tabrig.operators.train import label_index
    idx = {r[0]: r[1] for r in label_index(df, "c").collect()}
    assert len(idx) == 1500 and idx["v00007"] == 7.0


def test_shared_dir_refuses_local_disk_on_a_cluster():
    from tabrig.session import shared_dir

    class _Conf:
        def get(self, key, default=None):
            return default

    class _Ctx:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class _Spark:
        sparkContext = _Ctx()
        conf = _Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Spark())
    _Ctx.getCheckpointDir = lambda self: "hdfs://shared/ckpt/"
    assert shared_dir(_Spark(), "x").startswith("hdfs://shared/ckpt/x-")


def test_history_inserts_write_only_their_own_rows(spark, tmp_path):
    """Two writers at once, a later version of a key, a column that comes later; then compaction."""
    import os
    from concurrent.futures import ThreadPoolExecutor
    path = str(tmp_path / "history")

    def files():
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    def insert(rows, columns="experiment_id string, v long, ingest_seq long"):
        H.history_insert(spark.createDataFrame(rows, columns).coalesce(1), path)

    insert([("a", 1, 1), ("b", 1, 1)])
    before = files()
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(insert, [[("a", 2, 2)], [("c", 3, 2)]]))
    after = files()
    assert {f: t for f, t in after.items() if f in before} == before and len(after) == len(before) + 2
    insert([("c", 4, 3, "late")], "experiment_id string, v long, ingest_seq long, note string")
    got = {r["experiment_id"]: (r["v"], r["note"]) for r in H.history_read(spark, path).collect()}
    assert got == {"a": (2, None), "b": (1, None), "c": (4, "late")}
    compacted = H.history_compact(spark, path)
    assert {r["experiment_id"]: r["v"] for r in H.history_read(spark, compacted).collect()} == {"a": 2, "b": 1, "c": 4}
    assert spark.read.parquet(compacted).count() == 3 and compacted != path


def test_record_and_report_of_pipeline_b(spark, sf, tmp_path):
    import json
    from tabrig.plans import run_experiment_b
    from tabrig.sources.tables import load
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "lang").join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    out = run_experiment_b(docs, "quality", "b", "doc_id", params={"num_trees": 3, "gbt_iters": 3, "max_depth": 3}, output_path=str(tmp_path))
    sections = {r["section"] for r in out["report"].select("section").distinct().collect()}
    assert sections == {"Dataset Summary", "Cleaning Summary", "Model Comparison", "Winner", "Feature Importance", "Review Recommendations"}
    record = out["history_rows"].first()
    best, models = json.loads(record["best_model"]), json.loads(record["models"])
    assert best["name"] == out["leaderboard"].where("rank = 1").first()["model"] and "accuracy" in best["metrics"]
    assert json.loads(record["metrics"]) == best["metrics"] and len(models) == 4
    assert all(spark.read.parquet(p).count() for p in json.loads(record["report_paths"]).values()) and json.loads(record["report_paths"])
    out["train"].unpersist()


def test_candidates_are_fitted_in_tasks_by_rows(spark, monkeypatch):
    """Few rows in many partitions go to one task, many in few partitions to as many as there are cores."""
    from tabrig.operators import train as tr
    assert tr.fit_tasks(0, 8) == 1 and tr.fit_tasks(25_000, 8) == 3 and tr.fit_tasks(10**6, 8) == 8 and tr.fit_tasks(10**7, 8) == 50
    seen = {}

    def fit_all(models, estimator, train):
        seen.update(parts=train.rdd.getNumPartitions(), rows=sorted(tuple(r) for r in train.select("id", "_label").collect()),
                    kept={m: estimator(m).getCacheNodeIds() for m in models if m != "logistic_regression"})
        return {m: (None, None, ValueError("not fitted")) for m in models}

    monkeypatch.setattr(tr, "_fit_all", fit_all)
    df = spark.range(0, 400, 1, 16).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    models = ["logistic_regression", "decision_tree", "random_forest", "gradient_boosting"]
    for most in (10_000, 100):
        monkeypatch.setattr(tr, "TASK_ROWS", most)
        got = tr.train_portfolio(df, "y", models, "classification", "id", mode="B")
        assert seen["parts"] == tr.fit_tasks(got.train_rows, spark.sparkContext.defaultParallelism)
        assert len(seen["rows"]) == got.train_rows and got.train_rows + got.test_rows == 400
        got.unpersist()
    assert seen["kept"] == {"decision_tree": True, "random_forest": True, "gradient_boosting": False}
