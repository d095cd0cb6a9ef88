"""Report tables (V8-V14): ordered key/value sections built from profile,
cleaning, ranking and review results; the whole report is one long
(section, ord, key, value) table written as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import format_bytes, format_metric, quoted, title_case
from .profile import column_stats, data_columns, duplicate_count, estimated_bytes, feature_types
from .rank import display_leaderboard

# Metric sets shown per task and report wording.
METRICS_SHOWN = {"classification": ["accuracy", "precision", "recall", "f1", "roc_auc", "matthews_corrcoef"],
                 "regression": ["mae", "mse", "rmse", "r2", "mape"]}
CLEANING_ROWS = 20
REPORT_KIND = "HTML + PDF"
KV_SCHEMA = "ord int, key string, value string"


def _kv(spark: SparkSession, items: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i + 1, k, v) for i, (k, v) in enumerate(items)], KV_SCHEMA)


def _title(s: str) -> str:
    return s.title()


def report_dataset(df: DataFrame, target: str, dataset_name: str, row_key: str | None = None,
                   facts: dict | None = None) -> DataFrame:
    """V8: name, rows, columns, target, size, numeric / categorical counts."""
    n = facts["rows"] if facts else df.count()
    num, _ = feature_types(df, row_key, bool_is_numeric=False)
    ncols = len([c for c in df.columns if c != row_key])
    size = estimated_bytes(df, row_key).agg(F.sum("bytes").alias("b"))
    size_txt = size.select(format_bytes("b").alias("t")).first()["t"]
    items = [("Dataset Name", dataset_name), ("Rows", f"{n:,}"), ("Columns", f"{ncols:,}"),
             ("Target Column", target), ("Memory Usage", size_txt),
             ("Numerical Features", str(len(num))), ("Categorical Features", str(ncols - len(num)))]
    return _kv(df.sparkSession, items)


def report_quality(df: DataFrame, target: str, row_key: str | None = None,
                   facts: dict | None = None) -> DataFrame:
    """V9: missing cells, duplicates, target missing and distinct counts
    (reusing the quality facts when the caller already has them)."""
    st = facts or column_stats(df, row_key, target)
    dups = st["duplicates"] if facts else duplicate_count(df, row_key).first()[0]
    items = [("Missing Values", str(sum(st["missing"].values()))), ("Duplicate Rows", str(dups)),
             ("Target Missing Values", str(st["target_missing"])),
             ("Target Unique Values", str(st["target_distinct"]))]
    return _kv(df.sparkSession, items)


def report_cleaning(log: DataFrame, n: int = CLEANING_ROWS) -> DataFrame:
    """The first 20 change-log entries (log order = kind, then key)."""
    kind = F.when(F.col("change") == "Removed Duplicate Row", 1).when(
        F.col("change") == "Removed Empty Column", 2).otherwise(3)
    return log.orderBy(kind, F.length("row_key"), "row_key", "column_name").limit(n)


def report_problem(spark: SparkSession, problem_type: str | None, target: str, goal: str,
                   test_size: float, business_goal: str | None) -> DataFrame:
    """V11."""
    items = [("Problem Type", _title(problem_type or "Pending")), ("Target Column", target),
             ("Optimization Goal", _title(goal.replace("_", " "))), ("Test Size", f"{test_size * 100:.0f}%"),
             ("Business Goal", business_goal or "Not Provided")]
    return _kv(spark, items)


def report_metrics(metrics_wide: DataFrame, model: str, task: str, fixed_set: bool = True) -> DataFrame:
    """The best model's metrics as (ord, key, formatted value); the fixed
    per-task set by default, else every metric column present."""
    names = METRICS_SHOWN[task] if fixed_set else [c for c in metrics_wide.columns if c not in ("model", "ord")]
    row = metrics_wide.where(F.col("model") == model)
    arr = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("_m"),
                             (F.col(n).cast("double") if n in metrics_wide.columns
                              else F.lit(None).cast("double")).alias("_v")) for i, n in enumerate(names)])
    return row.select(F.inline(arr)).select("ord", title_case(F.col("_m")).alias("key"),
                                             format_metric("_v").alias("value"))


def report_summary(spark: SparkSession, n_models: int, business_goal: str | None, best_model: str | None,
                   problem_type: str | None, best_score: float | None) -> DataFrame:
    """Executive summary sentence and the four headline cards."""
    if not best_model:
        summary = "The experiment was initialized but did not complete model evaluation."
    else:
        summary = (f"The experiment evaluated {n_models} candidate models for "
                   f"{business_goal or 'the selected target'} and selected {best_model.replace('_', ' ')} "
                   "as the best current baseline.")
    score = spark.createDataFrame([(best_score,)], "s double").select(format_metric("s")).first()[0]
    items = [("Executive Summary", summary), ("Problem Type", _title(problem_type or "Pending")),
             ("Best Model", _title((best_model or "Pending").replace("_", " "))),
             ("Best Score", score), ("Report", REPORT_KIND)]
    return _kv(spark, items)


def report_dataset_b(df: DataFrame, row_key: str | None = None, stats: dict | None = None) -> DataFrame:
    """V8 (B): rows, columns, then the type of each column."""
    st = stats or column_stats(df, row_key)
    types = [(c, df.schema[c].dataType.simpleString()) for c in data_columns(df, row_key)]
    return _kv(df.sparkSession, [("Rows", str(st["rows"])), ("Columns", str(st["columns"])), *types])


def report_cleaning_b(df: DataFrame, row_key: str | None = None, stats: dict | None = None) -> DataFrame:
    """V10 (B): missing cells of each column, then the duplicate rows removed."""
    st = stats or column_stats(df, row_key)
    dups = duplicate_count(df, row_key).first()[0]
    return _kv(df.sparkSession, [*[(c, str(n)) for c, n in st["missing"].items()], ("Duplicate rows removed", str(dups))])


def report_models(lb: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Model comparison (B): (ord, key, value) with the model's metrics as JSON, in leaderboard order."""
    present = [c for c in metric_cols if c in lb.columns]
    return lb.select(F.col("rank").cast("int").alias("ord"), F.col("model").alias("key"),
                     F.to_json(F.struct(*[quoted(c) for c in present])).alias("value"))


def report_b(df: DataFrame, lb: DataFrame, metric_cols: list[str], review: DataFrame, importances: DataFrame | None = None,
             row_key: str | None = None) -> DataFrame:
    """V14 (B): dataset, cleaning, model comparison, winner, its importances and the review's recommendations."""
    st = column_stats(df, row_key)
    models = report_models(lb, metric_cols)
    sections = {"Dataset Summary": report_dataset_b(df, row_key, st), "Cleaning Summary": report_cleaning_b(df, row_key, st),
                "Model Comparison": models, "Winner": models.where("ord = 1")}
    if importances is not None:
        best = importances.join(lb.where("rank = 1").select("model"), "model")
        sections["Feature Importance"] = best.select("feature", "importance")
    sections["Review Recommendations"] = review.where("recommendation IS NOT NULL").select(
        "ord", F.col("rule").alias("key"), F.col("recommendation").alias("value"))
    return report_sections(sections)


def formatted_leaderboard(lb: DataFrame, metric_cols: list[str]) -> DataFrame:
    """L10 as the report shows it: metric values as text (K1)."""
    shown = [c for c in metric_cols if c in lb.columns]
    return display_leaderboard(lb.select("rank", "model", *[format_metric(c).alias(c) for c in shown]), shown)


def report_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """One long (section, ord, key, value) table from key/value sections
    and row tables (rows become JSON text under their ordinal)."""
    out = None
    for s_ord, (name, df) in enumerate(sections.items()):
        if set(["ord", "key", "value"]).issubset(df.columns):
            part = df.select(F.lit(name).alias("section"), F.lit(s_ord + 1).alias("section_ord"),
                             F.col("ord").cast("int").alias("ord"), F.col("key"), F.col("value").cast("string"))
        else:
            cols = df.columns
            part = df.select(F.lit(name).alias("section"), F.lit(s_ord + 1).alias("section_ord"),
                             F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("key"),
                             F.to_json(F.struct(*cols)).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def write_report(report: DataFrame, path: str) -> str:
    report.coalesce(1).write.mode("overwrite").parquet(path)
    return path
