import pytest
from pyspark.sql import functions as F

from tabrig.plans import analyze_dataset, run_experiment_a, run_experiment_b
from tabrig.plans.experiment import outputs_long
from tabrig.sources.tables import dirty_orders, load

SMALL = {"num_trees": 5, "gbt_iters": 5, "max_depth": 4}


def _docs(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return d.join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def test_experiment_a_end_to_end(spark, sf):
    out = run_experiment_a(_docs(spark, sf), "quality", "highest_accuracy", 0.2, "document quality",
                           "documents", row_key="doc_id", params=SMALL)
    assert out["task"] == "classification" and len(out["models"]) == 4
    lb = out["leaderboard"].orderBy("rank").collect()
    assert [r["rank"] for r in lb] == [1, 2, 3, 4] and lb[0]["model"] == out["best_model"]
    assert all(0.0 <= r["accuracy"] <= 1.0 for r in lb)
    sections = {r["section"] for r in out["report"].select("section").distinct().collect()}
    assert {"Dataset", "Quality", "Problem", "Leaderboard", "Review"} <= sections
    assert out["history"].count() == 1
    assert out["charts"]["confusion"].count() == 4  # 2 labels x 2 labels
    out["train"].unpersist()


def test_experiment_b_end_to_end(spark, sf):
    out = run_experiment_b(_docs(spark, sf), "quality", "docs", row_key="doc_id", params=SMALL)
    assert out["task"] == "classification"
    rec = out["recommendation"].first()["recommendation"]
    assert rec.startswith("Best model: ")
    assert out["history_rows"].first()["id"] == 1
    out["train"].unpersist()


def test_analyze_dataset(spark, sf):
    out = analyze_dataset(dirty_orders(spark, sf), "status", "rid")
    assert out["duplicates"].first()[0] == 150
    assert out["preview"].count() == 100
    assert out["target_distribution"].where(F.col("label").isNull()).count() == 1


def test_all_outputs_in_long_form(spark, sf):
    import __spark_entry__ as E
    got = E.queries()["j03_analyze_dataset_dirty_orders"](spark, sf)
    assert got.columns == ["output", "ord", "name", "value"]
    names = {r["output"] for r in got.select("output").distinct().collect()}
    want = analyze_dataset(dirty_orders(spark, sf), "status", "rid")
    assert names == set(want) and len(names) == 8
    cells = got.where("output = 'preview'").groupBy("ord").count().collect()
    assert len(cells) == 100 and {r["count"] for r in cells} == {len(want["preview"].columns)}
    assert got.where("output = 'duplicates'").collect()[0]["value"] == "150"


def test_outputs_of_a_job_are_whole(spark, sf):
    out = run_experiment_b(_docs(spark, sf), "quality", "docs", row_key="doc_id", params=SMALL)
    names = {r["output"] for r in outputs_long(spark, out).select("output").distinct().collect()}
    assert {"strategy", "models", "metrics", "leaderboard", "recommendation", "review", "charts.missing", "charts.comparison",
            "charts.confusion", "charts.roc", "importances", "history_rows", "train.predictions"} <= names
    out["train"].unpersist()


def test_checks_and_bench_train_the_whole_portfolio(spark, sf, monkeypatch):
    import bench
    from tabrig.checks import q_review
    from tabrig.operators import task, train
    seen = {}

    def portfolio(df, target, models, *a, **kw):
        seen["v04"] = models
        raise InterruptedError

    def experiment(df, target, goal, *a, **kw):
        seen["j1"] = (task.model_portfolio("classification", goal), df.columns)
        raise InterruptedError

    monkeypatch.setattr(train, "train_portfolio", portfolio)
    monkeypatch.setattr(bench, "run_experiment_a", experiment)
    with pytest.raises(InterruptedError):
        q_review.v04(spark, sf)
    with pytest.raises(InterruptedError):
        bench.workloads(spark, sf)["j1_experiment"]()
    models = task.model_portfolio("classification")
    assert seen == {"v04": models, "j1": (models, load(spark, sf, "lineitem").columns)} and len(models) == 4
