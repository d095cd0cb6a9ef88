"""Registered checks: task detection (T1-T5) and splits (M1-M3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import split as M
from ..operators import task as T
from ..sources import tables as S
from .registry import register
from .views import DIRTY_ORDERS, with_views

W = with_views(DIRTY_ORDERS)


def _t1_sql(table, col, dtype, numeric=True):
    cls = "TRUE" if not numeric else f"u <= 20 OR u / greatest(n, 1) < 0.05"
    return f"""SELECT CASE WHEN {cls} THEN 'classification' ELSE 'regression' END AS problem_type,
         u AS target_unique_values, '{dtype}' AS target_dtype,
         CASE WHEN {cls} THEN printf('Target has %d distinct values with dtype {dtype}.', u)
              ELSE printf('Target appears continuous with %d distinct numeric values.', u) END AS reason
       FROM (SELECT count(*) AS n, count(DISTINCT {col}) AS u FROM {table})"""


@register("t01_detect_task_linestatus", _t1_sql("lineitem", "l_linestatus", "object", numeric=False))
def t01a(spark, sf):
    return T.detect_task(S.load(spark, sf, "lineitem"), "l_linestatus")


@register("t01_detect_task_quantity", _t1_sql("lineitem", "l_quantity", "float64"))
def t01b(spark, sf):
    return T.detect_task(S.load(spark, sf, "lineitem"), "l_quantity")


@register("t01_detect_task_price", _t1_sql("lineitem", "l_extendedprice", "float64"))
def t01c(spark, sf):
    return T.detect_task(S.load(spark, sf, "lineitem"), "l_extendedprice")


def _t2_sql(table, col, dtype, numeric, integral):
    il = "TRUE" if integral else (f"coalesce(bool_and({col} % 1 = 0) FILTER (WHERE {col} IS NOT NULL "
                                   f"AND NOT isnan({col})), TRUE)") if numeric else "FALSE"
    if not numeric:
        cadd, radd = "0.4", "0.0"
        r1 = "'Target is non-numeric (categorical/strings) -> favors classification'"
    else:
        cadd = ("CASE WHEN il AND u <= 20 THEN 0.4 WHEN il THEN 0.0 "
                "WHEN u / greatest(n, 1) > 0.05 AND u > 30 THEN 0.0 ELSE 0.2 END")
        radd = ("CASE WHEN il AND u <= 20 THEN 0.0 WHEN il THEN 0.3 "
                "WHEN u / greatest(n, 1) > 0.05 AND u > 30 THEN 0.5 ELSE 0.0 END")
        r1 = ("CASE WHEN il AND u <= 20 THEN 'Integer-like numeric with low cardinality -> favors classification' "
              "WHEN il THEN 'Integer-like numeric with higher cardinality -> leans regression' "
              "WHEN u / greatest(n, 1) > 0.05 AND u > 30 THEN 'Continuous numeric with many unique values -> "
              "favors regression' ELSE 'Numeric but low cardinality -> may be classification' END")
    return f"""SELECT CASE WHEN sc >= sr THEN 'classification' ELSE 'regression' END AS task_type,
         round(greatest(0.5, least(greatest(sc, sr) / (sc + sr), 0.99)), 3) AS confidence,
         CASE WHEN u = 2 THEN r1 || '; Binary target detected -> classification' ELSE r1 END AS reason,
         '{dtype}' AS dtype, n AS n_rows, u AS n_unique, u / greatest(n, 1) AS unique_ratio,
         {str(numeric).upper()} AS is_numeric, il AS is_integer_like
       FROM (SELECT *, 0.5 + {cadd} + CASE WHEN u = 2 THEN 0.3 ELSE 0.0 END AS sc, 0.5 + {radd} AS sr,
                    {r1} AS r1
             FROM (SELECT count(*) AS n, count(DISTINCT {col}) AS u, {il} AS il FROM {table}))"""


@register("t02_infer_task_quantity", _t2_sql("lineitem", "l_quantity", "float64", True, False),
          rounded=["unique_ratio"])
def t02a(spark, sf):
    return T.infer_task(S.load(spark, sf, "lineitem"), "l_quantity")


@register("t02_infer_task_custkey", _t2_sql("orders", "o_custkey", "int64", True, True),
          rounded=["unique_ratio"])
def t02b(spark, sf):
    return T.infer_task(S.load(spark, sf, "orders"), "o_custkey")


@register("t02_infer_task_linestatus", _t2_sql("lineitem", "l_linestatus", "object", False, False),
          rounded=["unique_ratio"])
def t02c(spark, sf):
    return T.infer_task(S.load(spark, sf, "lineitem"), "l_linestatus")


@register("t02_infer_task_price", _t2_sql("lineitem", "l_extendedprice", "float64", True, False),
          rounded=["unique_ratio"])
def t02d(spark, sf):
    return T.infer_task(S.load(spark, sf, "lineitem"), "l_extendedprice")


@register("t04_task_hint_quantity",
          "SELECT CASE WHEN count(DISTINCT l_quantity) <= 20 THEN 'classification' ELSE 'regression' END "
          "AS task_hint, count(DISTINCT l_quantity) AS n_unique FROM lineitem")
def t04(spark, sf):
    return T.task_hint(S.load(spark, sf, "lineitem"), "l_quantity")


_T5_VALUES = """(VALUES ('classification', 1, 'logistic_regression', 'Logistic Regression', TRUE),
  ('classification', 2, 'decision_tree', 'Decision Tree', TRUE),
  ('classification', 3, 'random_forest', 'Random Forest', FALSE),
  ('classification', 4, 'gradient_boosting', 'Gradient Boosting', FALSE),
  ('regression', 1, 'linear_regression', 'Linear Regression', TRUE),
  ('regression', 2, 'decision_tree_regressor', 'Decision Tree Regressor', TRUE),
  ('regression', 3, 'random_forest_regressor', 'Random Forest Regressor', FALSE),
  ('regression', 4, 'gradient_boosting_regressor', 'Gradient Boosting Regressor', FALSE))
  AS m(task, ord, model, display_name, explainable)"""


@register("t05_select_models_price",
          f"""SELECT m.task, CAST(m.ord AS INTEGER) AS ord, m.model, m.display_name, m.explainable FROM {_T5_VALUES}
              JOIN ({_t1_sql('lineitem', 'l_extendedprice', 'float64')}) d ON m.task = d.problem_type""")
def t05a(spark, sf):
    return T.models_for_target(S.load(spark, sf, "lineitem"), "l_extendedprice")


@register("t05_select_models_explainable_status",
          f"""SELECT m.task, CAST(m.ord AS INTEGER) AS ord, m.model, m.display_name, m.explainable FROM {_T5_VALUES}
              JOIN ({_t1_sql('orders', 'o_orderstatus', 'object', numeric=False)}) d
                ON m.task = d.problem_type WHERE m.explainable""")
def t05b(spark, sf):
    return T.models_for_target(S.load(spark, sf, "orders"), "o_orderstatus", "most_explainable")


# ----------------------------------------------------------------------------- splits
_U = "CAST('0x' || substring(md5(concat(CAST(o_orderkey AS VARCHAR), '|42')), 1, 8) AS BIGINT)"


@register("m01_split_test_rows",
          f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_U} / 4294967296.0 < 0.2")
def m01(spark, sf):
    _, test = M.split(S.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return test


@register("m01_split_counts",
          f"""SELECT o_orderstatus, count(*) FILTER (WHERE {_U} / 4294967296.0 < 0.2) AS n_test,
                 count(*) FILTER (WHERE NOT ({_U} / 4294967296.0 < 0.2)) AS n_train
              FROM orders GROUP BY o_orderstatus""")
def m01b(spark, sf):
    m = M.mark_split(S.load(spark, sf, "orders"), "o_orderkey")
    return m.groupBy("o_orderstatus").agg(F.count_if("is_test").alias("n_test"),
                                          F.count_if(~F.col("is_test")).alias("n_train"))


def _strat_sql(test_size: float) -> str:
    return f"""WITH base AS (SELECT o_orderkey, o_orderstatus, {_U} AS u FROM orders),
cls AS (SELECT o_orderstatus AS c, count(*) AS n_c FROM base GROUP BY 1),
tot AS (SELECT sum(n_c) AS n, CAST(ceil({test_size} * sum(n_c)) AS BIGINT) AS n_test FROM cls),
q AS (SELECT c, n_c, (n_c / n) * (n - n_test) AS cont, floor((n_c / n) * (n - n_test)) AS fl,
             n - n_test AS n_train FROM cls, tot),
r AS (SELECT *, row_number() OVER (ORDER BY cont - fl DESC, c) AS rk,
             n_train - sum(fl) OVER () AS need FROM q),
quota AS (SELECT c, n_c - fl - CASE WHEN rk <= need THEN 1 ELSE 0 END AS t_c FROM r),
ranked AS (SELECT b.*, t_c, row_number() OVER (PARTITION BY o_orderstatus ORDER BY u, o_orderkey) AS rn
           FROM base b JOIN quota ON b.o_orderstatus = quota.c)
SELECT o_orderkey, o_orderstatus, rn <= t_c AS is_test FROM ranked"""


@register("m02_split_stratified", _strat_sql(0.2))
def m02(spark, sf):
    o = S.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return M.mark_split_stratified(o, "o_orderstatus", "o_orderkey", 0.2)


@register("m02_split_stratified_30", _strat_sql(0.3))
def m02b(spark, sf):
    o = S.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return M.mark_split_stratified(o, "o_orderstatus", "o_orderkey", 0.3)


_UD = "CAST('0x' || substring(md5(concat(CAST(rid AS VARCHAR), '|42')), 1, 8) AS BIGINT)"


@register("m02_split_stratified_missing_class", W.rstrip() + f""",
base AS (SELECT rid, status, {_UD} AS u FROM dirty_orders),
cls AS (SELECT status AS c, count(*) AS n_c FROM base GROUP BY 1),
tot AS (SELECT sum(n_c) AS n, CAST(ceil(0.2 * sum(n_c)) AS BIGINT) AS n_test FROM cls),
q AS (SELECT c, n_c, (n_c / n) * (n - n_test) AS cont, floor((n_c / n) * (n - n_test)) AS fl, n - n_test AS n_train FROM cls, tot),
r AS (SELECT *, row_number() OVER (ORDER BY cont - fl DESC, c NULLS LAST) AS rk, n_train - sum(fl) OVER () AS need FROM q),
quota AS (SELECT c, n_c - fl - CASE WHEN rk <= need THEN 1 ELSE 0 END AS t_c FROM r),
ranked AS (SELECT b.*, t_c, row_number() OVER (PARTITION BY status ORDER BY u, rid) AS rn
           FROM base b JOIN quota ON b.status IS NOT DISTINCT FROM quota.c)
SELECT rid, status, rn <= t_c AS is_test FROM ranked""")
def m02c(spark, sf):
    return M.mark_split_stratified(S.dirty_orders(spark, sf).select("rid", "status"), "status", "rid", 0.2)


@register("m03_can_stratify",
          "SELECT min(n) >= 2 AS can_stratify FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)")
def m03(spark, sf):
    return M.can_stratify_frame(S.load(spark, sf, "orders"), "o_orderstatus", "classification")


@register("m03_can_stratify_dirty_status",
          W + "SELECT min(n) >= 2 AS can_stratify FROM (SELECT count(*) AS n FROM dirty_orders "
              "WHERE status IS NOT NULL GROUP BY status)")
def m03b(spark, sf):
    d = C.drop_missing_target(S.dirty_orders(spark, sf), "status")
    return M.can_stratify_frame(d, "status", "classification")


@register("t03_is_integer_like_lineitem",
          "\nUNION ALL\n".join(
              f"SELECT '{c}' AS column_name, coalesce(bool_and({c} % 1 = 0), TRUE) AS is_integer_like FROM lineitem"
              for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def t03(spark, sf):
    return T.integer_like_columns(S.load(spark, sf, "lineitem"),
                                  ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
