"""Registered checks: risk review (R*), chart data (V1-V7) and report tables
(V8-V13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as V
from ..operators import clean as C
from ..operators import metrics as E
from ..operators import rank as L
from ..operators import report as RP
from ..operators import review as R
from ..operators import task as T
from ..sources import tables as S
from .q_metrics import _MODELS, _ORDERS, _PRICE, _lb_sql, _metrics_models, _reg_metrics
from .registry import register
from .views import DIRTY_ORDERS, with_views

W = with_views(DIRTY_ORDERS)

REVENUE = """revenue_view AS (
  SELECT l_extendedprice, l_quantity, l_discount, l_extendedprice * (1 - l_discount) AS revenue, l_returnflag
  FROM lineitem)"""


def _revenue(spark, sf):
    li = S.load(spark, sf, "lineitem")
    return li.select("l_extendedprice", "l_quantity", "l_discount",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), "l_returnflag")


def review_b_sql(table: str, target: str, cols: list[tuple[str, str]], target_type: str,
                 top_accuracy: float | None = None) -> str:
    """DuckDB form of R10 for a table whose columns and kinds are given.
    cols: (name, 'num'|'cat', same type as the target); target_type 'num'|'cat'."""
    tnum = target_type == "num"
    parts = [
        f"SELECT 10 AS sk, 'size' AS rule, NULL AS column_name, printf('Dataset is very small (%d rows). Models may overfit.', n) AS finding, "
        f"'Collect more data (recommended > 200 samples) or use simpler models / cross-validation.' AS recommendation FROM st WHERE n < 50",
        f"SELECT 11, 'size', NULL, printf('Dataset is small (%d rows). Be cautious about model variance.', n), "
        f"'Use cross-validation, regularization, and careful feature selection.' FROM st WHERE n >= 50 AND n < 200",
    ]
    hint = "TRUE" if not tnum else "u <= 20"
    parts += [
        f"SELECT 20, 'imbalance', NULL, printf('Strong class imbalance: top class is %.1f%% of samples.', top / greatest(n, 1) * 100), "
        f"'Consider resampling, class weights, or collecting more data for minority classes.' FROM st, vc "
        f"WHERE {hint} AND top / greatest(n, 1) > 0.9",
        f"SELECT 21, 'imbalance', NULL, printf('Moderate class imbalance: top class is %.1f%% of samples.', top / greatest(n, 1) * 100), "
        f"'Consider class weighting or SMOTE for minority classes.' FROM st, vc "
        f"WHERE {hint} AND top / greatest(n, 1) > 0.75 AND top / greatest(n, 1) <= 0.9",
    ]
    for i, (c, kind, same) in enumerate(cols):
        sk = 100 + i
        if same:
            parts.append(
                f"SELECT {sk}, 'exact_match', '{c}', 'Column ''{c}'' exactly matches the target — potential leakage.', "
                f"'Remove or anonymize ''{c}'' before modeling if it''s derived from the target.' FROM "
                f"(SELECT coalesce(bool_and({c} IS NOT DISTINCT FROM {target}), TRUE) AS x FROM {table}) WHERE x")
            not_exact = (f"NOT (SELECT coalesce(bool_and({c} IS NOT DISTINCT FROM {target}), TRUE) FROM {table})")
        else:
            not_exact = "TRUE"
        if kind == "num" and tnum:
            parts.append(
                f"SELECT {sk}, 'correlation', '{c}', printf('High correlation (%.2f) between ''{c}'' and target — potential leakage.', r), "
                f"'Investigate ''{c}'': it may be derived from the target.' FROM "
                f"(SELECT coalesce(corr({c}, {target}), 0.0) AS r FROM {table}) WHERE abs(r) > 0.95 AND {not_exact}")
        else:
            parts.append(
                f"SELECT {sk}, 'group_purity', '{c}', 'Categorical column ''{c}'' perfectly predicts the target in groups — potential leakage or strong predictor.', "
                f"'Verify whether ''{c}'' was created using future information or the target itself.' FROM "
                f"(SELECT count(*) AS g, coalesce(bool_or(lo < hi), FALSE) AS multi, coalesce(bool_or(k > 0), FALSE) AS anyk "
                f" FROM (SELECT count({target}) AS k, min(CAST({target} AS VARCHAR)) AS lo, max(CAST({target} AS VARCHAR)) AS hi "
                f"       FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})), st "
                f"WHERE anyk AND NOT multi AND g >= least(2, u) AND {not_exact}")
    if top_accuracy is not None:
        a = float(top_accuracy)
        parts.append(
            f"SELECT 900, 'score', NULL, printf('Top model accuracy is extremely high (%.2f%%) — suspicious on small/local datasets.', {a} * 100), "
            f"'Check for label leakage, data duplication between train/test, and data leakage from preprocessing.' WHERE {a} >= 0.98")
        parts.append(
            f"SELECT 901, 'score', NULL, printf('Top model accuracy is very high (%.2f%%) given dataset size (%d).', {a} * 100, n), "
            f"'Validate with cross-validation and inspect for leakage.' FROM st WHERE {a} < 0.98 AND {a} >= 0.95 AND n < 1000")
    ncols = len(cols) + 1
    parts.append(
        f"SELECT 950, 'width', NULL, 'Feature count is high relative to sample size — risk of overfitting.', "
        f"'Reduce dimensionality, use regularization, or collect more data.' FROM st WHERE {ncols} - 1 > n / 5")
    body = "\nUNION ALL ".join(parts)
    return f""",
st AS (SELECT count(*) AS n, count(DISTINCT {target}) AS u FROM {table}),
vc AS (SELECT max(k) AS top FROM (SELECT count(*) AS k FROM {table} GROUP BY {target})),
found AS ({body}),
allf AS (SELECT * FROM found UNION ALL
         SELECT 999, 'none', NULL, NULL,
                'No immediate issues detected. Proceed with cross-validation and model explainability checks.'
         WHERE NOT EXISTS (SELECT 1 FROM found))
SELECT CAST(row_number() OVER (ORDER BY sk) AS INTEGER) AS ord, rule, column_name, finding, recommendation FROM allf"""


_DIRTY_COLS = [("o_orderkey", "num", False), ("o_custkey", "num", False), ("price", "num", False),
               ("priority", "cat", True), ("empty_col", "num", False)]


@register("r10_review_b_dirty_orders", W.rstrip() + review_b_sql("dirty_orders", "status", _DIRTY_COLS, "cat"))
def r10(spark, sf):
    return R.review_b(S.dirty_orders(spark, sf), "status", row_key="rid")


_REV_COLS = [("l_extendedprice", "num", True), ("l_quantity", "num", True), ("l_discount", "num", True),
             ("l_returnflag", "cat", False)]


@register("r10_review_b_revenue",
          with_views(REVENUE).rstrip() + review_b_sql("revenue_view", "revenue", _REV_COLS, "num"))
def r10b(spark, sf):
    return R.review_b(_revenue(spark, sf), "revenue")


@register("r10_review_b_orders_status",
          review_b_sql("orders", "o_orderstatus",
                       [("o_orderkey", "num", False), ("o_custkey", "num", False), ("o_totalprice", "num", False),
                        ("o_orderdate", "cat", False), ("o_orderpriority", "cat", True)], "cat", top_accuracy=0.96)
          .replace(",\nst AS", "WITH st AS", 1))
def r10c(spark, sf):
    return R.review_b(S.load(spark, sf, "orders"), "o_orderstatus", top_accuracy=0.96)


def _best_acc_sql():
    return f"(SELECT primary_value FROM ({_lb_sql('accuracy')}) WHERE rank = 1)"


@register("r09_review_a_dirty_explainable",
          W.rstrip("\n") + "," + _MODELS.replace("WITH ", "", 1) + f"""
, cleaned AS (SELECT * FROM (SELECT min(rid) AS rid, o_orderkey, o_custkey, price, priority, status FROM dirty_orders
              GROUP BY o_orderkey, o_custkey, price, priority, status) WHERE status IS NOT NULL),
cm2 AS (SELECT count(*) AS n, max(k) / sum(k) AS share FROM (SELECT count(*) AS k FROM cleaned GROUP BY status)),
c AS (
  SELECT 1 AS sk, 'size' AS rule, 'Dataset is small; use cross-validation before trusting the ranking.' AS comment
  FROM (SELECT count(*) AS n FROM cleaned) WHERE n < 200
  UNION ALL SELECT 2, 'imbalance', 'Target classes are imbalanced; prioritize F1 score over accuracy.' FROM cm2 WHERE share > 0.75
  UNION ALL SELECT 3, 'score', 'Very high score detected; verify there is no target leakage.' WHERE {_best_acc_sql()} > 0.98
  UNION ALL SELECT 4, 'goal', 'Explainability was prioritized, so simpler models may be preferred over peak performance.')
SELECT CAST(row_number() OVER (ORDER BY sk) AS INTEGER) AS ord, rule, comment FROM c""")
def r09(spark, sf):
    cleaned = C.clean(S.dirty_orders(spark, sf), "status", "rid").cleaned
    lb = L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")
    best = lb.where("rank = 1").first()["primary_value"]
    return R.review_a(cleaned, "status", "classification", best, "most_explainable")


@register("r09_review_a_regression",
          _PRICE + """,
lb AS (SELECT r2 FROM rm ORDER BY r2 DESC LIMIT 1),
c AS (
  SELECT 3 AS sk, 'score' AS rule, 'Low R2 score; consider feature engineering or more predictive data.' AS comment
  FROM lb WHERE r2 < 0.2
  UNION ALL SELECT 1, 'size', 'Dataset is small; use cross-validation before trusting the ranking.'
  FROM (SELECT count(*) AS n FROM lineitem) WHERE n < 200),
d AS (SELECT * FROM c UNION ALL SELECT 9, 'none', 'No major experiment risks detected in this first-pass automated review.'
      WHERE NOT EXISTS (SELECT 1 FROM c))
SELECT CAST(row_number() OVER (ORDER BY sk) AS INTEGER) AS ord, rule, comment FROM d""")
def r09b(spark, sf):
    lb = L.leaderboard(_reg_metrics(spark, sf), "regression", "highest_accuracy")
    best = lb.where("rank = 1").first()["primary_value"]
    return R.review_a(S.load(spark, sf, "lineitem"), "l_extendedprice", "regression", best, "highest_accuracy")


@register("p09_review_risks",
          _PRICE + """
SELECT 1 AS ord, 'score' AS rule, 'Low R2 score; consider feature engineering or more predictive data.' AS comment
WHERE (SELECT max(r2) FROM rm) < 0.2""")
def p09(spark, sf):
    lb = L.leaderboard(_reg_metrics(spark, sf), "regression", "highest_accuracy")
    best = lb.where("rank = 1").first()["primary_value"]
    return R.review_risks(R.review_a(S.load(spark, sf, "lineitem"), "l_extendedprice", "regression", best))


@register("r11_business_recommendation",
          _MODELS + f"""
SELECT 'Use ' || replace(model, '_', ' ') || ' as the baseline model for document quality, then validate it with '
       || 'domain-specific acceptance criteria.' AS recommendation FROM ({_lb_sql('accuracy')}) WHERE rank = 1""")
def r11(spark, sf):
    lb = L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")
    best = lb.where("rank = 1").first()["model"]
    return spark.createDataFrame([(R.business_recommendation(best, "document quality"),)], "recommendation string")


# ----------------------------------------------------------------------------- chart data
@register("v01_chart_leaderboard",
          _MODELS + f"\nSELECT rank, replace(model, '_', ' ') AS label, primary_value AS value FROM ({_lb_sql('accuracy')})",
          rounded=["value"])
def v01(spark, sf):
    return V.chart_leaderboard(L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy"))


@register("v02_chart_missing_b",
          W + "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM dirty_orders"
                                    for c in ["o_orderkey", "o_custkey", "price", "priority", "status", "empty_col"]))
def v02(spark, sf):
    return V.chart_missing(S.dirty_orders(spark, sf), "rid", mode="B")


@register("v03_chart_target_quantity",
          "SELECT CAST(l_quantity AS VARCHAR) AS label, count(*) AS n FROM lineitem GROUP BY 1 "
          "ORDER BY n DESC, label LIMIT 12")
def v03(spark, sf):
    return V.chart_target(S.load(spark, sf, "lineitem"), "l_quantity")


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("v05_correlation_matrix_lineitem",
          "\nUNION ALL\n".join(
              f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(coalesce(corr({a}, {b}), 0.0), 2) AS corr FROM lineitem"
              for a in _LI_NUM for b in _LI_NUM))
def v05(spark, sf):
    return V.correlation_matrix(S.load(spark, sf, "lineitem"))


@register("v06_chart_confusion_b",
          _ORDERS + """,
L AS (SELECT DISTINCT g, a AS l FROM cells)
SELECT x.g AS model, x.l AS actual, y.l AS predicted, coalesce(c.n, 0) AS n
FROM L x JOIN L y ON x.g = y.g LEFT JOIN cells c ON c.g = x.g AND c.a = x.l AND c.p = y.l""")
def v06(spark, sf):
    return V.chart_confusion(S.pred_orders(spark, sf), mode="B")


@register("v07_chart_roc_best",
          _MODELS + f"""
, best AS (SELECT model FROM ({_lb_sql('roc_auc')}) WHERE rank = 1),
g AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS fp
      FROM pred_models WHERE model = (SELECT model FROM best) AND score IS NOT NULL GROUP BY score),
c AS (SELECT score AS threshold, sum(tp) OVER w AS tps, sum(fp) OVER w AS fps, row_number() OVER w AS idx
      FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, lag(tps) OVER v AS tp0, lag(fps) OVER v AS fp0, lead(tps) OVER v AS tp2, lead(fps) OVER v AS fp2,
             max(idx) OVER () AS last FROM c WINDOW v AS (ORDER BY idx)),
kept AS (SELECT threshold, tps, fps, idx FROM n
         WHERE idx = 1 OR idx = last OR last <= 2 OR fp2 - 2 * fps + fp0 <> 0 OR tp2 - 2 * tps + tp0 <> 0),
tot AS (SELECT max(tps) AS P, max(fps) AS N FROM c),
allp AS (SELECT CAST('inf' AS DOUBLE) AS threshold, 0 AS tps, 0 AS fps, 0 AS idx UNION ALL SELECT * FROM kept)
SELECT CAST(idx AS BIGINT) AS idx, threshold, fps / N AS fpr, tps / P AS tpr FROM allp, tot""",
          rounded=["threshold", "fpr", "tpr"])
def v07(spark, sf):
    best = _metrics_models(spark, sf).orderBy(F.col("roc_auc").desc(), "ord").first()["model"]
    return V.chart_roc(S.pred_models(spark, sf), best, mode="A")


# ----------------------------------------------------------------------------- report tables
@register("v08_report_dataset_orders",
          """SELECT * FROM (VALUES (1, 'Dataset Name', 'orders')) t(ord, key, value)
UNION ALL SELECT 2, 'Rows', format('{:,}', count(*)) FROM orders
UNION ALL SELECT 3, 'Columns', '6'
UNION ALL SELECT 4, 'Target Column', 'o_orderstatus'
UNION ALL SELECT 5, 'Memory Usage', CASE
    WHEN b < 1024 THEN printf('%.1f B', b) WHEN b / 1024.0 < 1024 THEN printf('%.1f KB', b / 1024.0)
    WHEN b / 1048576.0 < 1024 THEN printf('%.1f MB', b / 1048576.0)
    WHEN b / 1073741824.0 < 1024 THEN printf('%.1f GB', b / 1073741824.0)
    ELSE printf('%.1f TB', b / 1099511627776.0) END
  FROM (SELECT CAST(count(*) * 32 + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)) AS DOUBLE) AS b FROM orders)
UNION ALL SELECT 6, 'Numerical Features', '3'
UNION ALL SELECT 7, 'Categorical Features', '3'""")
def v08(spark, sf):
    return RP.report_dataset(S.load(spark, sf, "orders"), "o_orderstatus", "orders")


@register("v09_report_quality",
          W + """SELECT 1 AS ord, 'Missing Values' AS key, CAST(sum(m) AS VARCHAR) AS value FROM (
      SELECT count(*) - count(o_orderkey) + count(*) - count(o_custkey) + count(*) - count(price)
           + count(*) - count(priority) + count(*) - count(status) + count(*) - count(empty_col) AS m FROM dirty_orders)
UNION ALL SELECT 2, 'Duplicate Rows', CAST(sum(n - 1) AS VARCHAR) FROM
      (SELECT count(*) AS n FROM dirty_orders GROUP BY o_orderkey, o_custkey, price, priority, status, empty_col)
UNION ALL SELECT 3, 'Target Missing Values', CAST(count(*) - count(status) AS VARCHAR) FROM dirty_orders
UNION ALL SELECT 4, 'Target Unique Values', CAST(count(DISTINCT status) AS VARCHAR) FROM dirty_orders""")
def v09(spark, sf):
    return RP.report_quality(S.dirty_orders(spark, sf), "status", "rid")


@register("v11_report_problem_orders",
          """SELECT 1 AS ord, 'Problem Type' AS key, CASE WHEN count(DISTINCT o_orderstatus) > 0 THEN 'Classification' END AS value
             FROM orders
             UNION ALL SELECT 2, 'Target Column', 'o_orderstatus'
             UNION ALL SELECT 3, 'Optimization Goal', 'Most Explainable'
             UNION ALL SELECT 4, 'Test Size', '20%'
             UNION ALL SELECT 5, 'Business Goal', 'Not Provided'""")
def v11(spark, sf):
    ptype = T.detect_task(S.load(spark, sf, "orders"), "o_orderstatus").first()["problem_type"]
    return RP.report_problem(spark, ptype, "o_orderstatus", "most_explainable", 0.2, None)


_FMT = ("CASE WHEN v IS NULL THEN 'Pending' WHEN v BETWEEN -1 AND 1 THEN printf('%.2f%%', v * 100) "
        "ELSE printf('%.4f', v) END")


@register("v12_report_metrics",
          _MODELS + f""",
best AS (SELECT * FROM ({_lb_sql('accuracy')}) WHERE rank = 1),
kv AS (SELECT 1 AS ord, 'Accuracy' AS key, accuracy AS v FROM best
       UNION ALL SELECT 2, 'Precision', precision FROM best UNION ALL SELECT 3, 'Recall', recall FROM best
       UNION ALL SELECT 4, 'F1', f1 FROM best UNION ALL SELECT 5, 'Roc Auc', roc_auc FROM best
       UNION ALL SELECT 6, 'Matthews Corrcoef', matthews_corrcoef FROM best)
SELECT ord, key, {_FMT} AS value FROM kv""")
def v12(spark, sf):
    mm = _metrics_models(spark, sf)
    lb = L.leaderboard(mm, "classification", "highest_accuracy")
    best = lb.where("rank = 1").first()["model"]
    return RP.report_metrics(mm, best, "classification")


@register("v13_report_summary",
          _MODELS + f""",
best AS (SELECT * FROM ({_lb_sql('accuracy')}) WHERE rank = 1)
SELECT 1 AS ord, 'Executive Summary' AS key, 'The experiment evaluated 4 candidate models for document quality and selected '
       || replace(model, '_', ' ') || ' as the best current baseline.' AS value FROM best
UNION ALL SELECT 2, 'Problem Type', 'Classification'
UNION ALL SELECT 3, 'Best Model', array_to_string(list_transform(string_split(lower(replace(model, '_', ' ')), ' '),
          lambda w: upper(w[1]) || w[2:]), ' ') FROM best
UNION ALL SELECT 4, 'Best Score', CASE WHEN primary_value BETWEEN -1 AND 1 THEN printf('%.2f%%', primary_value * 100)
          ELSE printf('%.4f', primary_value) END FROM best
UNION ALL SELECT 5, 'Report', 'HTML + PDF'""")
def v13(spark, sf):
    lb = L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")
    b = lb.where("rank = 1").first()
    return RP.report_summary(spark, lb.count(), "document quality", b["model"], "classification", b["primary_value"])


@register("v04_chart_importance")
def v04(spark, sf):
    from ..operators.train import train_portfolio
    from .q_train import _docs
    tr = train_portfolio(_docs(spark, sf), "quality", T.model_portfolio("classification"), "classification", "doc_id")
    best = L.best_model(L.leaderboard(tr.metrics, "classification", "highest_accuracy")).first()["model"]
    return V.chart_importance(tr.importances.where(F.col("model") == best))


@register("s10_experiment_summary")
def s10(spark, sf):
    """Run record of the rule-model experiment over documents (rows-only: it
    carries a creation time)."""
    from ..sources.io import experiment_summary
    lb = L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")
    b = lb.where("rank = 1").first()
    docs = S.load(spark, sf, "documents")
    return experiment_summary(spark, "rule-models", "documents", "quality", "highest_accuracy", 0.2,
                              "document quality", docs.count(), len(docs.columns), "classification",
                              [r["model"] for r in lb.orderBy("rank").collect()], b["model"],
                              b["primary_value"])


_DIRTY_NUM = ["o_orderkey", "o_custkey", "price", "empty_col"]


@register("v05_correlation_matrix_dirty",
          W + "\nUNION ALL\n".join(
              f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(coalesce(corr({a}, {b}), 0.0), 2) AS corr "
              f"FROM dirty_orders" for a in _DIRTY_NUM for b in _DIRTY_NUM))
def v05b(spark, sf):
    return V.correlation_matrix(S.dirty_orders(spark, sf), "rid")
