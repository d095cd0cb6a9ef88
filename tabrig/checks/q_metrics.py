"""Registered checks: metrics (E1-E14, M18, M19) and ranking (L1-L10) on the
rule-based prediction views (no training involved)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as E
from ..operators import rank as L
from ..sources import tables as S
from .registry import register
from .views import PRED_MODELS, PRED_ORDERS, PRED_PRICE, PRED_QUALITY, with_views

CLS_METRICS = ["accuracy", "precision", "recall", "f1", "f1_weighted", "matthews_corrcoef", "roc_auc"]
REG_METRICS = ["mae", "mse", "rmse", "r2", "mape"]


def cls_metric_ctes(src: str, grp: str = "model") -> str:
    """CTEs computing per-group classification metrics from ``src`` into ``cm``."""
    return f"""
P AS (SELECT {grp} AS g, label, prediction, score FROM {src}),
cells AS (SELECT g, CAST(label AS VARCHAR) AS a, CAST(CAST(prediction AS {{LT}}) AS VARCHAR) AS p,
                 count(*) AS n FROM P GROUP BY ALL),
t AS (SELECT g, a AS lbl, sum(n) AS sup, sum(CASE WHEN a = p THEN n ELSE 0 END) AS tp FROM cells GROUP BY ALL),
pp AS (SELECT g, p AS lbl, sum(n) AS pn FROM cells GROUP BY ALL),
pl AS (SELECT coalesce(t.g, pp.g) AS g, coalesce(t.lbl, pp.lbl) AS lbl, CAST(coalesce(tp, 0) AS DOUBLE) AS tp,
              CAST(coalesce(sup, 0) AS DOUBLE) AS sup, CAST(coalesce(pn, 0) AS DOUBLE) AS pn
       FROM t FULL JOIN pp ON t.g = pp.g AND t.lbl = pp.lbl),
plm AS (SELECT *, CASE WHEN pn = 0 THEN 0.0 ELSE tp / pn END AS prec,
               CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS rec,
               CASE WHEN sup + pn = 0 THEN 0.0 ELSE 2.0 * tp / (sup + pn) END AS f1 FROM pl),
agg AS (SELECT g, sum(sup) AS s, sum(tp) AS c, sum(sup * prec) AS wp, sum(sup * rec) AS wr,
               sum(sup * f1) AS wf, sum(pn * sup) AS pt, sum(pn * pn) AS ppp, sum(sup * sup) AS tt
        FROM plm GROUP BY g),
lab AS (SELECT g, max(label) AS hi, count(DISTINCT label) AS k, count(score) AS sc FROM P GROUP BY g),
sg AS (SELECT P.g, score, sum(CASE WHEN label = hi THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN label = hi THEN 0 ELSE 1 END) AS neg
       FROM P JOIN lab ON P.g = lab.g WHERE score IS NOT NULL AND k = 2 GROUP BY ALL),
cg AS (SELECT *, sum(neg) OVER (PARTITION BY g ORDER BY score ROWS UNBOUNDED PRECEDING) AS cneg FROM sg),
auc AS (SELECT g, sum(pos * (cneg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM cg GROUP BY g),
cm AS (SELECT agg.g, c / s AS accuracy, wp / s AS precision, wr / s AS recall, wf / s AS f1,
              wf / s AS f1_weighted,
              CASE WHEN (s * s - ppp) * (s * s - tt) = 0 THEN 0.0
                   ELSE (c * s - pt) / sqrt((s * s - tt) * (s * s - ppp)) END AS matthews_corrcoef,
              CASE WHEN k = 2 AND sc > 0 THEN coalesce(auc, 0.0) ELSE 0.0 END AS roc_auc
       FROM agg JOIN lab ON agg.g = lab.g LEFT JOIN auc ON agg.g = auc.g)"""


def reg_metric_ctes(src: str) -> str:
    return f"""
rm AS (SELECT model AS g, avg(abs(label - prediction)) AS mae, avg((label - prediction) ^ 2) AS mse,
              sqrt(avg((label - prediction) ^ 2)) AS rmse,
              CASE WHEN var_pop(label) * count(label) = 0
                   THEN CASE WHEN sum((label - prediction) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
                   ELSE 1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(label)) END AS r2,
              coalesce(avg(abs((label - prediction) / label)) FILTER (WHERE label <> 0), 0.0) AS mape
       FROM {src} GROUP BY model)"""


_QUAL = with_views(PRED_QUALITY) + "," + cls_metric_ctes("pred_quality", "0").replace("{LT}", "INTEGER")
_MODELS = with_views(PRED_MODELS) + "," + cls_metric_ctes("pred_models").replace("{LT}", "INTEGER")
_ORDERS = with_views(PRED_ORDERS) + "," + cls_metric_ctes("pred_orders").replace("{LT}", "VARCHAR")
_PRICE = with_views(PRED_PRICE) + "," + reg_metric_ctes("pred_price")


@register("e07_confusion_matrix_quality",
          _QUAL + """
SELECT x.a AS actual, y.a AS predicted, coalesce(c.n, 0) AS n
FROM (SELECT a FROM cells UNION SELECT p FROM cells) x(a) JOIN (SELECT a FROM cells UNION SELECT p FROM cells) y(a)
  ON TRUE LEFT JOIN cells c ON c.a = x.a AND c.p = y.a""")
def e07(spark, sf):
    return E.confusion_matrix(S.pred_quality(spark, sf))


@register("e07_confusion_matrix_orders",
          _ORDERS + """,
L AS (SELECT g, a AS l FROM cells UNION SELECT g, p FROM cells)
SELECT x.g AS model, x.l AS actual, y.l AS predicted, coalesce(c.n, 0) AS n
FROM L x JOIN L y ON x.g = y.g LEFT JOIN cells c ON c.g = x.g AND c.a = x.l AND c.p = y.l""")
def e07b(spark, sf):
    return E.confusion_matrix(S.pred_orders(spark, sf), ["model"])


@register("m18_classification_metrics_quality",
          _QUAL + "\nSELECT " + ", ".join(CLS_METRICS) + " FROM cm", rounded=CLS_METRICS)
def m18a(spark, sf):
    return E.classification_metrics(S.pred_quality(spark, sf))


@register("m18_classification_metrics_models",
          _MODELS + "\nSELECT g AS model, " + ", ".join(CLS_METRICS) + " FROM cm", rounded=CLS_METRICS)
def m18b(spark, sf):
    return E.classification_metrics(S.pred_models(spark, sf), ["model"])


@register("m18_classification_metrics_orders",
          _ORDERS + "\nSELECT g AS model, " + ", ".join(CLS_METRICS) + " FROM cm", rounded=CLS_METRICS)
def m18c(spark, sf):
    return E.classification_metrics(S.pred_orders(spark, sf), ["model"])


@register("m18_classification_metrics_b_models",
          _MODELS + "\nSELECT cm.g AS model, accuracy, f1, CASE WHEN k = 2 AND sc > 0 THEN roc_auc END AS roc_auc "
                    "FROM cm JOIN lab ON cm.g = lab.g", rounded=["accuracy", "f1", "roc_auc"])
def m18d(spark, sf):
    return E.classification_metrics_b(S.pred_models(spark, sf), ["model"])


@register("e01_accuracy", _QUAL + "\nSELECT accuracy FROM cm", rounded=["accuracy"])
def e01(spark, sf):
    return E.classification_metrics(S.pred_quality(spark, sf)).select("accuracy")


@register("e05_matthews_corrcoef", _QUAL + "\nSELECT matthews_corrcoef FROM cm", rounded=["matthews_corrcoef"])
def e05(spark, sf):
    return E.classification_metrics(S.pred_quality(spark, sf)).select("matthews_corrcoef")


@register("e06_roc_auc_models", _MODELS + "\nSELECT g AS model, roc_auc FROM cm", rounded=["roc_auc"])
def e06(spark, sf):
    return E.roc_auc(S.pred_models(spark, sf), ["model"])


@register("e08_classification_report_orders",
          _ORDERS + """
SELECT g AS model, lbl AS label, prec AS precision, rec AS recall, f1 AS f1_score, sup AS support,
       CAST(NULL AS DOUBLE) AS score FROM plm
UNION ALL SELECT g, 'accuracy', NULL, NULL, NULL, NULL, c / s FROM agg
UNION ALL SELECT g, 'macro avg', avg(prec), avg(rec), avg(f1), sum(sup), NULL FROM plm GROUP BY g
UNION ALL SELECT g, 'weighted avg', wp / s, wr / s, wf / s, s, NULL FROM agg""",
          rounded=["precision", "recall", "f1_score", "support", "score"])
def e08(spark, sf):
    return E.classification_report(S.pred_orders(spark, sf), ["model"])


_ROC_SQL = with_views(PRED_MODELS) + """,
lab AS (SELECT model, count(DISTINCT label) AS k, min(label) AS lo, max(label) AS hi FROM pred_models GROUP BY model),
g AS (SELECT p.model, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS fp
      FROM pred_models p JOIN lab USING (model)
      WHERE score IS NOT NULL AND k = 2 AND ((lo = 0 AND hi = 1) OR (lo = -1 AND hi = 1)) GROUP BY ALL),
c AS (SELECT model, score AS threshold,
             sum(tp) OVER w AS tps, sum(fp) OVER w AS fps, row_number() OVER w AS idx
      FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, lag(tps) OVER v AS tp0, lag(fps) OVER v AS fp0, lead(tps) OVER v AS tp2, lead(fps) OVER v AS fp2,
             max(idx) OVER (PARTITION BY model) AS last
      FROM c WINDOW v AS (PARTITION BY model ORDER BY idx)),
kept AS (SELECT model, threshold, tps, fps, idx FROM n
         WHERE idx = 1 OR idx = last OR last <= 2 OR fp2 - 2 * fps + fp0 <> 0 OR tp2 - 2 * tps + tp0 <> 0),
tot AS (SELECT model, max(tps) AS P, max(fps) AS N FROM c GROUP BY model),
allp AS (SELECT model, CAST('inf' AS DOUBLE) AS threshold, 0 AS tps, 0 AS fps, 0 AS idx FROM tot
         UNION ALL SELECT * FROM kept)
SELECT allp.model, CAST(idx AS BIGINT) AS idx, threshold,
       CASE WHEN N = 0 THEN NULL ELSE fps / N END AS fpr, CASE WHEN P = 0 THEN NULL ELSE tps / P END AS tpr
FROM allp JOIN tot USING (model)"""


@register("e09_roc_points_models", _ROC_SQL, rounded=["fpr", "tpr", "threshold"])
def e09(spark, sf):
    return E.roc_points(S.pred_models(spark, sf), ["model"])


@register("m19_regression_metrics", _PRICE + "\nSELECT g AS model, mae, mse, rmse, r2, mape FROM rm",
          rounded=REG_METRICS)
def m19(spark, sf):
    return E.regression_metrics(S.pred_price(spark, sf), ["model"])


@register("m19_regression_metrics_b", _PRICE + "\nSELECT g AS model, mse, r2 FROM rm", rounded=["mse", "r2"])
def m19b(spark, sf):
    return E.regression_metrics_b(S.pred_price(spark, sf), ["model"])


@register("e14_mape", _PRICE + "\nSELECT g AS model, mape FROM rm", rounded=["mape"])
def e14(spark, sf):
    return E.regression_metrics(S.pred_price(spark, sf), ["model"]).select("model", "mape")


# ----------------------------------------------------------------------------- ranking
def _metrics_models(spark, sf):
    m = E.classification_metrics(S.pred_models(spark, sf), ["model"])
    ords = S.pred_models(spark, sf).select("model", "ord").distinct()
    return m.join(ords, "model")


_ORD = "(SELECT DISTINCT model AS g, ord FROM pred_models) o"


def _lb_sql(metric: str, desc: bool = True) -> str:
    d = "DESC" if desc else "ASC"
    return (f"SELECT cm.g AS model, o.ord, {', '.join(CLS_METRICS)}, "
            f"row_number() OVER (ORDER BY {metric} {d}, o.ord) AS rank, '{metric}' AS primary_metric, "
            f"{metric} AS primary_value FROM cm JOIN {_ORD} ON cm.g = o.g")


@register("l03_leaderboard_accuracy", _MODELS + "\n" + _lb_sql("accuracy"),
          rounded=CLS_METRICS + ["primary_value"])
def l03(spark, sf):
    return L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")


@register("l03_leaderboard_explainable", _MODELS + "\n" + _lb_sql("f1"),
          rounded=CLS_METRICS + ["primary_value"])
def l03b(spark, sf):
    return L.leaderboard(_metrics_models(spark, sf), "classification", "most_explainable")


def _reg_metrics(spark, sf):
    m = E.regression_metrics(S.pred_price(spark, sf), ["model"])
    return m.join(S.pred_price(spark, sf).select("model", "ord").distinct(), "model")


_RORD = "(SELECT DISTINCT model AS g, ord FROM pred_price) o"


@register("l03_leaderboard_regression",
          _PRICE + f"""
SELECT rm.g AS model, mae, mse, rmse, r2, mape, o.ord,
       row_number() OVER (ORDER BY r2 DESC, o.ord) AS rank, 'r2' AS primary_metric, r2 AS primary_value
FROM rm JOIN {_RORD} ON rm.g = o.g""", rounded=REG_METRICS + ["primary_value"])
def l03c(spark, sf):
    return L.leaderboard(_reg_metrics(spark, sf), "regression", "highest_accuracy")


@register("l04_best_model",
          _MODELS + f"\nSELECT model, primary_value AS best_score FROM ({_lb_sql('accuracy')}) WHERE rank = 1",
          rounded=["best_score"])
def l04(spark, sf):
    return L.best_model(L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy"))


@register("l05_leaderboard_b_regression",
          _PRICE + f"""
SELECT rm.g AS model, mae, mse, rmse, r2, mape, o.ord, row_number() OVER (ORDER BY mse ASC, o.ord) AS rank
FROM rm JOIN {_RORD} ON rm.g = o.g""", rounded=REG_METRICS)
def l05(spark, sf):
    return L.leaderboard_b_first(_reg_metrics(spark, sf), "regression")


@register("l06_leaderboard_tuple",
          _MODELS + f"""
SELECT cm.g AS model, o.ord, {', '.join(CLS_METRICS)},
       row_number() OVER (ORDER BY accuracy DESC, f1 DESC, roc_auc DESC, o.ord) AS rank
FROM cm JOIN {_ORD} ON cm.g = o.g""", rounded=CLS_METRICS)
def l06(spark, sf):
    return L.leaderboard_tuple(_metrics_models(spark, sf), "classification")


@register("l07_recommendation",
          _MODELS + f"""
SELECT 'Best model: ' || model || ' (accuracy=' || CAST(accuracy AS VARCHAR) || ', f1=' || CAST(f1 AS VARCHAR)
       || ')' || ' | ROC AUC: ' || CAST(roc_auc AS VARCHAR) AS recommendation, CAST(0 AS BIGINT) AS failed_models
FROM (SELECT cm.g AS model, o.ord, accuracy, f1, roc_auc,
             row_number() OVER (ORDER BY accuracy DESC, f1 DESC, roc_auc DESC, o.ord) AS rank
      FROM cm JOIN {_ORD} ON cm.g = o.g) WHERE rank = 1""")
def l07(spark, sf):
    lb = L.leaderboard_tuple(_metrics_models(spark, sf), "classification")
    return L.recommendation(lb, "classification")


@register("l08_rank_of",
          _MODELS + f"\nSELECT model, printf('#%d of %d', rank, 4) AS model_rank FROM ({_lb_sql('accuracy')}) "
                    "WHERE model = 'lang_rule'")
def l08(spark, sf):
    lb = L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")
    return L.rank_of(lb, "lang_rule")


_TITLE_MODEL = ("array_to_string(list_transform(string_split(lower(replace(model, '_', ' ')), ' '), "
                "lambda w: upper(w[1]) || w[2:]), ' ')")


@register("l09_goal_reason",
          _MODELS + f"""
SELECT model, {_TITLE_MODEL} || ' was selected because it achieved the strongest Accuracy score of '
       || CASE WHEN primary_value BETWEEN -1 AND 1 THEN printf('%.2f%%', primary_value * 100)
               ELSE printf('%.4f', primary_value) END || ' among the tested models.' AS reason
FROM ({_lb_sql('accuracy')}) WHERE rank = 1""")
def l09(spark, sf):
    lb = L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")
    return L.goal_reason(lb, "highest_accuracy")


@register("l10_display_leaderboard",
          _MODELS + f"""
SELECT rank AS "Rank", {_TITLE_MODEL} AS "Model", accuracy AS "Accuracy", f1 AS "F1",
       matthews_corrcoef AS "Matthews Corrcoef" FROM ({_lb_sql('accuracy')})""",
          rounded=["Accuracy", "F1", "Matthews Corrcoef"])
def l10(spark, sf):
    lb = L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")
    return L.display_leaderboard(lb, ["accuracy", "f1", "matthews_corrcoef"])


@register("e02_precision_weighted", _ORDERS + "\nSELECT g AS model, precision FROM cm", rounded=["precision"])
def e02(spark, sf):
    return E.classification_metrics(S.pred_orders(spark, sf), ["model"]).select("model", "precision")


@register("e03_recall_weighted", _ORDERS + "\nSELECT g AS model, recall FROM cm", rounded=["recall"])
def e03(spark, sf):
    return E.classification_metrics(S.pred_orders(spark, sf), ["model"]).select("model", "recall")


@register("e04_f1_weighted", _ORDERS + "\nSELECT g AS model, f1, f1_weighted FROM cm", rounded=["f1", "f1_weighted"])
def e04(spark, sf):
    return E.classification_metrics(S.pred_orders(spark, sf), ["model"]).select("model", "f1", "f1_weighted")


@register("e10_e13_regression_errors", _PRICE + "\nSELECT g AS model, mae, mse, rmse, r2 FROM rm",
          rounded=["mae", "mse", "rmse", "r2"])
def e10(spark, sf):
    return E.regression_metrics(S.pred_price(spark, sf), ["model"]).select("model", "mae", "mse", "rmse", "r2")
