"""Task detection and model choice (T1-T5). Each rule is one aggregate over
the target column plus ``when`` logic; results are one-row DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_integer_like, is_missing, quoted
from .profile import is_numeric_type

# Thresholds and candidate portfolios as in the reference.
CLASS_DISTINCT_MAX = 20
CLASS_RATIO_MAX = 0.05
CLASSIFICATION = "classification"
REGRESSION = "regression"

CLASSIFICATION_MODELS = ["logistic_regression", "decision_tree", "random_forest", "gradient_boosting"]
REGRESSION_MODELS = ["linear_regression", "decision_tree_regressor", "random_forest_regressor",
                     "gradient_boosting_regressor"]
EXPLAINABLE_MODELS = {CLASSIFICATION: ["logistic_regression", "decision_tree"],
                      REGRESSION: ["linear_regression", "decision_tree_regressor"]}
DISPLAY_NAMES = {
    "logistic_regression": "Logistic Regression", "decision_tree": "Decision Tree",
    "random_forest": "Random Forest", "gradient_boosting": "Gradient Boosting",
    "linear_regression": "Linear Regression", "decision_tree_regressor": "Decision Tree Regressor",
    "random_forest_regressor": "Random Forest Regressor",
    "gradient_boosting_regressor": "Gradient Boosting Regressor",
}
GOALS = ["highest_accuracy", "fastest_model", "most_explainable"]

REASON_NON_NUMERIC = "Target is non-numeric (categorical/strings) -> favors classification"
REASON_INT_LOW = "Integer-like numeric with low cardinality -> favors classification"
REASON_INT_HIGH = "Integer-like numeric with higher cardinality -> leans regression"
REASON_FLOAT_MANY = "Continuous numeric with many unique values -> favors regression"
REASON_FLOAT_FEW = "Numeric but low cardinality -> may be classification"
REASON_BINARY = "Binary target detected -> classification"


def pandas_dtype_name(dt: T.DataType) -> str:
    """The pandas dtype a CSV column of this Spark type would get."""
    names = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64",
             T.FloatType: "float32", T.DoubleType: "float64", T.DecimalType: "float64",
             T.BooleanType: "bool", T.TimestampType: "datetime64[ns]",
             T.TimestampNTZType: "datetime64[ns]"}
    for t, n in names.items():
        if isinstance(dt, t):
            return n
    return "object"


def _check_target(df: DataFrame, target: str) -> T.DataType:
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in DataFrame")
    return df.schema[target].dataType


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """T1 (pipeline A): non-numeric, or <= 20 distinct, or distinct/rows < 0.05
    -> classification; else regression. One aggregate job."""
    dt = _check_target(df, target)
    numeric = is_numeric_type(dt, bool_is_numeric=True)
    dtype = pandas_dtype_name(dt)
    m = is_missing(quoted(target), dt)
    a = df.agg(F.count(F.lit(1)).alias("_n"),
               F.count_distinct(F.when(~m, quoted(target))).alias("_u"))
    u, n = F.col("_u"), F.col("_n")
    cls = F.lit(True) if not numeric else (u <= CLASS_DISTINCT_MAX) | (
        u / F.greatest(n, F.lit(1)) < CLASS_RATIO_MAX)
    ptype = F.when(cls, F.lit(CLASSIFICATION)).otherwise(F.lit(REGRESSION))
    reason = F.when(cls, F.format_string(f"Target has %d distinct values with dtype {dtype}.", u)) \
        .otherwise(F.format_string("Target appears continuous with %d distinct numeric values.", u))
    return a.select(ptype.alias("problem_type"), u.alias("target_unique_values"),
                    F.lit(dtype).alias("target_dtype"), reason.alias("reason"))


def infer_task(df: DataFrame, target: str) -> DataFrame:
    """T2 (pipeline B): scored heuristic with confidence in [0.5, 0.99], 3 dp."""
    dt = _check_target(df, target)
    numeric = is_numeric_type(dt, bool_is_numeric=True)
    m = is_missing(quoted(target), dt)
    a = df.agg(F.count(F.lit(1)).alias("n_rows"),
               F.count_distinct(F.when(~m, quoted(target))).alias("n_unique"),
               (is_integer_like(target, dt) if numeric else F.lit(False)).alias("is_integer_like"))
    u, n, il = F.col("n_unique"), F.col("n_rows"), F.col("is_integer_like")
    ratio = u / F.greatest(n, F.lit(1))
    if not numeric:
        c_add, r_add = F.lit(0.4), F.lit(0.0)
        first_reason = F.lit(REASON_NON_NUMERIC)
    else:
        int_low = il & (u <= CLASS_DISTINCT_MAX)
        int_high = il & (u > CLASS_DISTINCT_MAX)
        float_many = ~il & (ratio > CLASS_RATIO_MAX) & (u > 30)
        c_add = F.when(int_low, 0.4).when(int_high | float_many, 0.0).otherwise(0.2)
        r_add = F.when(int_high, 0.3).when(float_many, 0.5).otherwise(0.0)
        first_reason = (F.when(int_low, REASON_INT_LOW).when(int_high, REASON_INT_HIGH)
                        .when(float_many, REASON_FLOAT_MANY).otherwise(REASON_FLOAT_FEW))
    binary = u == 2
    sc = F.lit(0.5) + c_add + F.when(binary, 0.3).otherwise(0.0)
    sr = F.lit(0.5) + r_add
    reason = F.when(binary, F.concat_ws("; ", first_reason, F.lit(REASON_BINARY))).otherwise(first_reason)
    conf = F.greatest(F.lit(0.5), F.least(F.greatest(sc, sr) / (sc + sr), F.lit(0.99)))
    return a.select(
        F.when(sc >= sr, CLASSIFICATION).otherwise(REGRESSION).alias("task_type"),
        F.round(conf, 3).alias("confidence"), reason.alias("reason"),
        F.lit(pandas_dtype_name(dt)).alias("dtype"), n.alias("n_rows"), u.alias("n_unique"),
        ratio.alias("unique_ratio"), F.lit(numeric).alias("is_numeric"), il)


def integer_like_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """T3 for several columns in one aggregate: (column_name, is_integer_like)."""
    r = df.agg(*[is_integer_like(c, df.schema[c].dataType).alias(f"_i{i}") for i, c in enumerate(cols)])
    return r.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                F.col(f"_i{i}").alias("is_integer_like"))
                                       for i, c in enumerate(cols)])))


def task_hint(df: DataFrame, target: str) -> DataFrame:
    """T4: review-only rule, non-numeric or <= 20 distinct -> classification."""
    dt = _check_target(df, target)
    numeric = is_numeric_type(dt, bool_is_numeric=True)
    m = is_missing(quoted(target), dt)
    a = df.agg(F.count_distinct(F.when(~m, quoted(target))).alias("n_unique"))
    cls = F.lit(True) if not numeric else F.col("n_unique") <= CLASS_DISTINCT_MAX
    return a.select(F.when(cls, CLASSIFICATION).otherwise(REGRESSION).alias("task_hint"), "n_unique")


def model_portfolio(task: str, goal: str = "highest_accuracy") -> list[str]:
    """T5 on the driver: candidate names; 'most_explainable' keeps linear + tree."""
    task = task.lower().strip()
    if task not in (CLASSIFICATION, REGRESSION):
        raise ValueError("Unknown task_type. Expected 'classification' or 'regression'.")
    if goal == "most_explainable":
        return list(EXPLAINABLE_MODELS[task])
    return list(CLASSIFICATION_MODELS if task == CLASSIFICATION else REGRESSION_MODELS)


def select_models(spark: SparkSession, task: str, goal: str = "highest_accuracy") -> DataFrame:
    """T5: small (task, ord, model, display_name, explainable) table."""
    names = model_portfolio(task, goal)
    expl = set(EXPLAINABLE_MODELS[task.lower().strip()])
    rows = [(task, i + 1, m, DISPLAY_NAMES[m], m in expl) for i, m in enumerate(names)]
    return spark.createDataFrame(rows, "task string, ord int, model string, display_name string, "
                                       "explainable boolean")


def models_for_target(df: DataFrame, target: str, goal: str = "highest_accuracy") -> DataFrame:
    """T1 then T5: the candidate table for the detected task of a target."""
    task = detect_task(df, target).first()["problem_type"]
    return select_models(df.sparkSession, task, goal)
