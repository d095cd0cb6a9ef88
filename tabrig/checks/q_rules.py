"""Registered checks: review rules on views in which they fire (R1-R8), and the report and record
tables that need no training (V10, V14 of pipeline B, R12, S10, C6, Q5, Q8, Q17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import profile as Q
from ..operators import rank as L
from ..operators import report as RP
from ..operators import review as R
from ..sources import tables as S
from .q_metrics import _MODELS, _lb_sql, _metrics_models
from .q_profile import _CLEANED, _GROUP_ALL, _REMOVED
from .q_review import review_b_sql
from .registry import register
from .views import DIRTY_COLS, DIRTY_ORDERS, missing_sum, with_views

W = with_views(DIRTY_ORDERS)

# whole small tables with a rule-made target
NATIONS = """nations_view AS (
  SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'a' ELSE 'b' END AS copied, n_name, n_regionkey * 10 AS tens,
         n_nationkey % 2 AS odd, n_nationkey % 3 AS third, n_nationkey * n_nationkey AS squared,
         CASE WHEN n_regionkey = 0 THEN 'a' ELSE 'b' END AS target FROM nation)"""
RARE = """rare_view AS (SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey = 0 THEN 'rare' ELSE 'usual' END AS target FROM nation)"""
SUPPLIERS = """suppliers_view AS (
  SELECT s_acctbal, s_acctbal * 2 + s_nationkey AS nearly, -s_acctbal AS mirrored, s_nationkey, s_acctbal AS target FROM supplier)"""


def _view(spark, sf, table: str, sql: str):
    S.load(spark, sf, table).createOrReplaceTempView(f"_{table}")
    return spark.sql(sql.split(" AS (", 1)[1].rstrip()[:-1].replace(f"FROM {table}", f"FROM _{table}"))


@register("r10_review_b_nations",
          with_views(NATIONS).rstrip() + review_b_sql(
              "nations_view", "target", [("n_nationkey", "num", False), ("copied", "cat", True), ("n_name", "cat", True), ("tens", "num", False),
                                         ("odd", "num", False), ("third", "num", False), ("squared", "num", False)], "cat", top_accuracy=0.99))
def nations(spark, sf):
    """R1 very small, R2 moderate, R3, R5, R6 extreme and R7 fire."""
    return R.review_b(_view(spark, sf, "nation", NATIONS), "target", top_accuracy=0.99)


@register("r10_review_b_rare_class",
          with_views(RARE).rstrip() + review_b_sql("rare_view", "target", [("n_regionkey", "num", False), ("n_nationkey", "num", False)], "cat", top_accuracy=0.96))
def rare(spark, sf):
    """R2 strong and R6 very high fire."""
    return R.review_b(_view(spark, sf, "nation", RARE), "target", top_accuracy=0.96)


@register("r10_review_b_suppliers",
          with_views(SUPPLIERS).rstrip() + review_b_sql(
              "suppliers_view", "target", [("s_acctbal", "num", True), ("nearly", "num", True), ("mirrored", "num", True), ("s_nationkey", "num", False)], "num"))
def suppliers(spark, sf):
    """R3 and R4 (both signs) fire, and R1 where the table is small."""
    return R.review_b(_view(spark, sf, "supplier", SUPPLIERS), "target")


def _a_sql(view: str, table: str, target: str, task: str, score: float | None, goal: str) -> str:
    share = f"(SELECT max(k) / sum(k) FROM (SELECT count(*) AS k FROM {table} WHERE {target} IS NOT NULL GROUP BY {target}))"
    s = "CAST(NULL AS DOUBLE)" if score is None else f"CAST({score} AS DOUBLE)"
    return (f"WITH {view}, c AS (SELECT 1 AS sk, 'size' AS rule, '{R.A_SMALL}' AS comment WHERE (SELECT count(*) FROM {table}) < 200 "
            f"UNION ALL SELECT 2, 'imbalance', '{R.A_IMBALANCE}' WHERE '{task}' = 'classification' AND {share} > 0.75 "
            f"UNION ALL SELECT 3, 'score', '{R.A_LEAKAGE}' WHERE '{task}' = 'classification' AND {s} > 0.98 "
            f"UNION ALL SELECT 3, 'score', '{R.A_LOW_R2}' WHERE '{task}' = 'regression' AND {s} < 0.2 "
            f"UNION ALL SELECT 4, 'goal', '{R.A_EXPLAINABLE}' WHERE '{goal}' = 'most_explainable') "
            "SELECT CAST(row_number() OVER (ORDER BY sk) AS INTEGER) AS ord, rule, comment FROM c")


@register("r09_review_a_nations", _a_sql(NATIONS, "nations_view", "target", "classification", 0.995, "most_explainable"))
def a_nations(spark, sf):
    """R1, R2, R6 (leakage) and R8 fire."""
    return R.review_a(_view(spark, sf, "nation", NATIONS), "target", "classification", 0.995, "most_explainable")


@register("r09_review_a_suppliers", _a_sql(SUPPLIERS, "suppliers_view", "target", "regression", 0.1, "most_explainable"))
def a_suppliers(spark, sf):
    """R6 (low R2) and R8 fire, and R1 where the table is small."""
    return R.review_a(_view(spark, sf, "supplier", SUPPLIERS), "target", "regression", 0.1, "most_explainable")


@register("q08_class_distribution_few", "SELECT l_returnflag AS label, count(*) AS n FROM lineitem "
                                        "WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem) <= 20 GROUP BY l_returnflag")
def q08_few(spark, sf):
    return Q.class_distribution(S.load(spark, sf, "lineitem"), "l_returnflag")


_TYPE = ("CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
         "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END")


@register("q05_data_types", f"SELECT column_name, {_TYPE} AS data_type FROM (DESCRIBE lineitem)")
def q05(spark, sf):
    return Q.data_types(S.load(spark, sf, "lineitem"))


_Q17 = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("price", "double"), ("priority", "string"), ("status", "string"), ("empty_col", "double")]


@register("q17_inspect", W + f"""SELECT 'rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM dirty_orders
UNION ALL SELECT 'columns', '6'
UNION ALL SELECT 'missing_values', CAST({missing_sum(DIRTY_COLS)} AS VARCHAR) FROM dirty_orders
UNION ALL SELECT 'duplicate_rows', CAST(CAST(sum(n - 1) AS BIGINT) AS VARCHAR) FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY {_GROUP_ALL})
UNION ALL SELECT 'numeric_columns', 'o_orderkey,o_custkey,price,empty_col' UNION ALL SELECT 'categorical_columns', 'priority,status'
""" + "".join(f"UNION ALL SELECT 'data_type:{c}', '{t}' " for c, t in _Q17))
def q17(spark, sf):
    return Q.inspect(S.dirty_orders(spark, sf), "rid")


def _json(cols: list[str]) -> str:
    texts = {"priority", "status"}
    parts = []
    for c in cols:
        value = f"'\"' || {c} || '\"'" if c in texts else f"CAST({c} AS VARCHAR)"
        parts.append(f"'\"{c}\":' || coalesce({value}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_FULL_LOG = f"""
full_log AS (
  SELECT * FROM (SELECT 'Removed Duplicate Row' AS change, CAST(rid AS VARCHAR) AS row_key, 'All Columns' AS column_name,
                        {_json(DIRTY_COLS)} AS before, 'Row Removed' AS after FROM ({_REMOVED}) r JOIN dirty_orders USING (rid) ORDER BY rid LIMIT 25)
  UNION ALL SELECT 'Removed Empty Column', 'All Rows', 'empty_col', 'All values missing', 'Column Removed'
  UNION ALL SELECT * FROM (SELECT 'Removed Missing Target Row', CAST(rid AS VARCHAR), 'Target', {_json(DIRTY_COLS[:-1])}, 'Row Removed'
                           FROM ({_CLEANED}) WHERE status IS NULL ORDER BY rid LIMIT 25))
"""


@register("c06_change_log_before", W.rstrip() + "," + _FULL_LOG.replace(f"({_REMOVED}) r", f"(SELECT rid FROM ({_REMOVED})) r") + "SELECT * FROM full_log")
def c06_before(spark, sf):
    return C.clean(S.dirty_orders(spark, sf), "status", "rid").log


@register("v10_report_cleaning", W.rstrip() + "," + _FULL_LOG.replace(f"({_REMOVED}) r", f"(SELECT rid FROM ({_REMOVED})) r") + """
SELECT * FROM full_log ORDER BY CASE change WHEN 'Removed Duplicate Row' THEN 1 WHEN 'Removed Empty Column' THEN 2 ELSE 3 END,
  length(row_key), row_key, column_name LIMIT 20""")
def v10(spark, sf):
    return RP.report_cleaning(C.clean(S.dirty_orders(spark, sf), "status", "rid").log)


@register("r12_review_panels", _MODELS + f""",
best AS (SELECT array_to_string(list_transform(string_split(replace(model, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name
         FROM ({_lb_sql('accuracy')}) WHERE rank = 1),
shares AS (SELECT max(k) / sum(k) AS share, sum(k) AS n FROM (SELECT count(*) AS k FROM documents WHERE lang IS NOT NULL GROUP BY lang)),
said AS (SELECT row_number() OVER (ORDER BY sk) AS ord, comment FROM (
  SELECT 1 AS sk, '{R.A_SMALL}' AS comment WHERE (SELECT count(*) FROM documents) < 200
  UNION ALL SELECT 2, '{R.A_IMBALANCE}' FROM shares WHERE share > 0.75)),
comments AS (SELECT * FROM said UNION ALL SELECT 1, '{R.A_NONE}' WHERE NOT EXISTS (SELECT 1 FROM said)),
risks AS (SELECT * FROM comments WHERE NOT starts_with(lower(comment), 'no major'))
SELECT 'Strengths' AS panel, 1 AS ord, 'Completed evaluation across 4 candidate model(s).' AS text
UNION ALL SELECT 'Strengths', 2, 'Selected ' || name || ' against the ' || '{R.GOAL_LABELS["highest_accuracy"]}' || ' objective.' FROM best
UNION ALL SELECT 'Strengths', 3, 'No major experiment risks were detected in the automated first-pass review.' WHERE NOT EXISTS (SELECT 1 FROM risks)
UNION ALL SELECT 'Potential Risks', CAST(ord AS INTEGER), comment FROM risks
UNION ALL SELECT 'Potential Risks', 1, 'No material risks were flagged by the current checks.' WHERE NOT EXISTS (SELECT 1 FROM risks)
UNION ALL SELECT 'Observations', 1, 'The task was detected as classification using quality as the target.'
UNION ALL SELECT 'Observations', 2, 'The holdout split reserved 20% of the prepared dataset for evaluation.'
UNION ALL SELECT 'Recommendations', CAST(ord AS INTEGER), comment FROM comments""")
def r12(spark, sf):
    lb = L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")
    best = lb.where("rank = 1").first()["model"]
    comments = [r["comment"] for r in R.review_a(S.load(spark, sf, "documents"), "lang", "classification", None, "highest_accuracy").collect()]
    return R.review_panels(spark, comments, lb.count(), best, "highest_accuracy", "classification", "quality", 0.2)


@register("s10_experiment_record", _MODELS + f"""
SELECT 'rule-models' AS experiment_id, 'documents' AS dataset_name, 'quality' AS target_column, 'classification' AS problem_type, model AS best_model,
  primary_value AS best_model_score, (SELECT count(*) FROM documents) AS n_rows, 'profile,clean' AS steps, 'train: no rows' AS errors,
  (SELECT string_agg(model, ',' ORDER BY rank) FROM ({_lb_sql('accuracy')})) AS selected_models
FROM ({_lb_sql('accuracy')}) WHERE rank = 1""", rounded=["best_model_score"])
def s10_record(spark, sf):
    """The record without its times, its JSON read back."""
    from ..sources.io import experiment_summary
    lb = L.leaderboard(_metrics_models(spark, sf), "classification", "highest_accuracy")
    b = lb.where("rank = 1").first()
    docs = S.load(spark, sf, "documents")
    runs = [{"name": n, "status": "completed"} for n in ("profile", "clean")]
    rec = experiment_summary(spark, "rule-models", "documents", "quality", "highest_accuracy", 0.2, "document quality", docs.count(), len(docs.columns),
                             "classification", [r["model"] for r in lb.orderBy("rank").collect()], b["model"], b["primary_value"], runs=runs, errors=["train: no rows"])
    payload = F.from_json("payload_json", "rows long, selected_models array<string>, agent_runs array<struct<name:string>>, errors array<string>")
    return rec.withColumn("p", payload).select(
        "experiment_id", "dataset_name", "target_column", "problem_type", "best_model", "best_model_score", F.col("p.rows").alias("n_rows"),
        F.array_join("p.agent_runs.name", ",").alias("steps"), F.array_join("p.errors", ",").alias("errors"), F.array_join("p.selected_models", ",").alias("selected_models"))


_REVIEW_SQL = review_b_sql("dirty_orders", "status", [("o_orderkey", "num", False), ("o_custkey", "num", False), ("price", "num", False),
                                                      ("priority", "cat", True), ("empty_col", "num", False)], "cat")


@register("v14_report_b_dirty_orders", W.rstrip() + _REVIEW_SQL.rsplit("SELECT CAST(row_number()", 1)[0] + f""",
reviewed AS (SELECT CAST(row_number() OVER (ORDER BY sk) AS INTEGER) AS ord, rule, recommendation FROM allf)
SELECT 'Dataset Summary' AS section, 1 AS section_ord, 1 AS ord, 'Rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM dirty_orders
UNION ALL SELECT 'Dataset Summary', 1, 2, 'Columns', '6'
{"".join(f"UNION ALL SELECT 'Dataset Summary', 1, {i + 3}, '{c}', '{t}' " for i, (c, t) in enumerate(_Q17))}
{"".join(f"UNION ALL SELECT 'Cleaning Summary', 2, {i + 1}, '{c}', CAST(count(*) - count({c}) AS VARCHAR) FROM dirty_orders " for i, (c, _) in enumerate(_Q17))}
UNION ALL SELECT 'Cleaning Summary', 2, 7, 'Duplicate rows removed', CAST(CAST(sum(n - 1) AS BIGINT) AS VARCHAR)
  FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY {_GROUP_ALL})
UNION ALL SELECT 'Review Recommendations', 5, ord, rule, recommendation FROM reviewed WHERE recommendation IS NOT NULL""")
def v14_b(spark, sf):
    """The sections of pipeline B's report that hold no model scores."""
    d = S.dirty_orders(spark, sf)
    lb = spark.createDataFrame([(1, "always", 0.5)], "rank int, model string, accuracy double")
    report = RP.report_b(d, lb, ["accuracy"], R.review_b(d, "status", row_key="rid"), row_key="rid")
    kept = report.where("section NOT IN ('Model Comparison', 'Winner')")
    return kept.withColumn("section_ord", F.when(F.col("section") == "Review Recommendations", 5).otherwise(F.col("section_ord")))
