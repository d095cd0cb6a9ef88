"""Chart-ready tables (V1-V7). Drawing is left to the caller; these are the
data behind each chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, quoted
from .correlation import correlations
from .metrics import confusion_matrix, roc_points
from .profile import feature_types, missing_by_column, missing_ranked

TOP_TARGET_VALUES = 12


def chart_leaderboard(lb: DataFrame) -> DataFrame:
    """V1 (A): (rank, label, value) of the primary metric, labels with spaces."""
    return lb.select("rank", F.regexp_replace("model", "_", " ").alias("label"),
                     F.col("primary_value").alias("value"))


def chart_leaderboard_b(lb: DataFrame, task: str) -> DataFrame:
    """V1 (B): accuracy, or -mse (absent -> 0), in leaderboard order."""
    v = F.coalesce(F.col("accuracy"), F.lit(0.0)) if task == "classification" else \
        F.coalesce(-F.col("mse"), F.lit(0.0))
    return lb.select("rank", F.col("model").alias("label"), v.alias("value"))


def chart_missing(df: DataFrame, row_key: str | None = None, mode: str = "A") -> DataFrame:
    """V2: A = top 12 columns with missing > 0; B = every column (sorted by the caller)."""
    return missing_ranked(df, row_key) if mode == "A" else missing_by_column(df, row_key)


def chart_target(df: DataFrame, target: str, n: int = TOP_TARGET_VALUES) -> DataFrame:
    """V3: the 12 most frequent target values (missing excluded), ties by label."""
    m = is_missing(quoted(target), df.schema[target].dataType)
    vc = df.where(~m).groupBy(quoted(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return vc.orderBy(F.col("n").desc(), F.col("label").asc()).limit(n)


def correlation_matrix(df: DataFrame, row_key: str | None = None, cols: list[str] | None = None,
                       decimals: int = 2) -> DataFrame:
    """V5: every ordered pair of numeric columns, pairwise-complete Pearson,
    undefined -> 0, rounded; empty when fewer than two numeric columns.
    Pairs come from block products (``correlation.py``) and are mirrored."""
    if cols is None:
        cols, _ = feature_types(df, row_key, bool_is_numeric=False)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    pairs = correlations(df, cols).select("a", "b", F.round(F.round("r", 12), decimals).alias("corr"))
    both = pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    names = F.array(*[F.lit(c) for c in cols])
    return both.select(F.get(names, "a").alias("col_a"), F.get(names, "b").alias("col_b"), "corr")


def chart_confusion(pred: DataFrame, model: str | None = None, mode: str = "A") -> DataFrame:
    """V6: A = the best model's grid (labels from both sides); B = every model,
    labels from the actual values only."""
    if mode == "A":
        p = pred.where(F.col("model") == model) if model else pred
        return confusion_matrix(p.drop("model") if "model" in p.columns else p)
    return confusion_matrix(pred, ["model"], labels_from="actual")


def chart_roc(pred: DataFrame, model: str | None = None, mode: str = "A") -> DataFrame:
    """V7: ROC points of the best model (A) or of every binary model (B)."""
    if mode == "A":
        p = pred.where(F.col("model") == model) if model else pred
        return roc_points(p.drop("model") if "model" in p.columns else p)
    return roc_points(pred, ["model"])


def chart_importance(importance: DataFrame) -> DataFrame:
    """V4: (feature, contribution) of the best model's importance rows."""
    return importance.select("feature", "contribution")
