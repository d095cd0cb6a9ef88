"""Registered checks: training (M4-M17), model files (S3) and the jobs.
Model scores are not comparable with another library's trees, so these are
rows-only checks, except ordinary least squares (M8), which has an exact SQL form."""

from __future__ import annotations

from ..operators import task as T
from ..operators.train import fit_linear_regression, train_portfolio
from ..plans.experiment import analyze_dataset, outputs_long, run_experiment_a, run_experiment_b
from ..sources import tables as S
from .registry import register


def _docs(spark, sf):
    d = S.load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return d.join(S.load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@register("m08_linear_regression_ols",
          "SELECT regr_slope(l_extendedprice, l_quantity) AS slope, "
          "regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem",
          rounded=["slope", "intercept"], decimals=2)
def m08(spark, sf):
    return fit_linear_regression(S.load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register("m12_train_portfolio_quality")
def m12(spark, sf):
    models = T.model_portfolio("classification")
    tr = train_portfolio(_docs(spark, sf), "quality", models, "classification", "doc_id")
    return tr.metrics.drop("training_seconds")


@register("m13_train_models_b_quality")
def m13(spark, sf):
    models = T.model_portfolio("classification")
    tr = train_portfolio(_docs(spark, sf), "quality", models, "classification", "doc_id", mode="B")
    return tr.metrics.drop("training_seconds")


@register("m14_predict_quality")
def m14(spark, sf):
    tr = train_portfolio(_docs(spark, sf), "quality", T.model_portfolio("classification"), "classification",
                         "doc_id")
    return tr.predictions


@register("m16_feature_importance_quality")
def m16(spark, sf):
    tr = train_portfolio(_docs(spark, sf), "quality", T.model_portfolio("classification"), "classification",
                         "doc_id")
    return tr.importances


@register("m17_feature_importance_b_quality")
def m17(spark, sf):
    tr = train_portfolio(_docs(spark, sf), "quality", T.model_portfolio("classification"), "classification",
                         "doc_id", mode="B")
    return tr.importances


@register("m12_train_portfolio_regression_docs")
def m12r(spark, sf):
    d = S.load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    models = T.model_portfolio("regression")
    tr = train_portfolio(d, "n_chars", models, "regression", "doc_id")
    return tr.metrics.drop("training_seconds")


@register("j01_run_experiment_a_quality")
def j01(spark, sf):
    out = run_experiment_a(_docs(spark, sf), "quality", "highest_accuracy", 0.2, "document quality",
                           "documents", row_key="doc_id")
    return outputs_long(spark, out)


@register("j01_run_experiment_a_report")
def j01b(spark, sf):
    out = run_experiment_a(_docs(spark, sf), "quality", "highest_accuracy", 0.2, "document quality",
                           "documents", row_key="doc_id")
    return out["report"]


@register("j02_run_experiment_b_quality")
def j02(spark, sf):
    out = run_experiment_b(_docs(spark, sf), "quality", "docs", row_key="doc_id")
    return outputs_long(spark, out)


@register("j03_analyze_dataset_dirty_orders")
def j03(spark, sf):
    out = analyze_dataset(S.dirty_orders(spark, sf), "status", "rid")
    return outputs_long(spark, out)
