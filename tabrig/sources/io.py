"""CSV loading (S1), dataset checks (S2), model persistence (S3) and the
experiment record (S10)."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .delimited import first_record, header, records

# Text read as missing by the usual CSV reader defaults.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
ROW_ID = "_row_id"
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf|[iI]nfinity)$"


def read_table_csv(spark: SparkSession, path: str, add_row_id: bool = True) -> DataFrame:
    """Header CSV (doubled quotes and line ends inside quoted fields), NA tokens ->
    null, then one aggregate pass decides per column long / double / boolean / string and
    casts. Numbers must look like numbers (no type suffixes); true/false with missing cells
    stays text. Files are read by as many tasks as they have splits (``delimited.py``); their
    records are parsed once and written into the shared folder. ``_row_id`` is the row's number in file order."""
    head = first_record(spark, path)
    if head is None:
        raise ValueError("The file has no header.")
    names = header(head)
    plain = [f"c{i}" for i in range(len(names))]
    parsed = F.from_csv("text", ", ".join(f"{c} string" for c in plain), {"quote": '"', "escape": '"'})
    rows = records(spark, path).where(~F.col("head")).select("n", parsed.alias("r"))
    cells = rows.select("n", *[F.when(F.col(f"r.{c}").isin(NA_TOKENS), None).otherwise(F.col(f"r.{c}")).alias(c) for c in plain])
    clean = written(cells, "csv")
    aggs = []
    for c in plain:
        v = F.trim(c)
        aggs += [F.count(c).alias(f"n_{c}"),
                 F.count(F.when(v.rlike(INTEGER), v.try_cast("bigint"))).alias(f"l_{c}"),
                 F.count(F.when(v.rlike(NUMBER), v.try_cast("double"))).alias(f"d_{c}"),
                 F.count_if(v.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b_{c}")]
    r = clean.agg(*aggs, F.count(F.lit(1)).alias("rows")).first()
    out = []
    for c, name in zip(plain, names):
        n, v = r[f"n_{c}"], F.trim(c)
        if n > 0 and r[f"l_{c}"] == n:
            out.append(v.try_cast("bigint").alias(name))
        elif n > 0 and r[f"d_{c}"] == n:
            out.append(v.try_cast("double").alias(name))
        elif n > 0 and r[f"b_{c}"] == n == r["rows"]:
            out.append(v.isin(TRUE_TOKENS).alias(name))
        elif n == 0:
            out.append(F.lit(None).cast("double").alias(name))  # all missing reads as float
        else:
            out.append(F.col(c).alias(name))
    return clean.select(*out, *([F.col("n").alias(ROW_ID)] if add_row_id else []))


def write_table_csv(df: DataFrame, path: str, na: str = "NA") -> str:
    out = df.write.mode("overwrite").option("header", "true").option("nullValue", na).option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return path


def check_dataset(df: DataFrame, target: str | None = None) -> None:
    """Reject an empty table, fewer than two columns, or an absent target."""
    if len(df.columns) < 2:
        raise ValueError("Dataset must contain at least two columns.")
    if df.isEmpty():
        raise ValueError("Dataset cannot be empty.")
    if target is not None and target not in df.columns:
        raise ValueError(f"Target column '{target}' was not found in the dataset.")


def dataset_check_frame(df: DataFrame, target: str | None = None) -> DataFrame:
    """S2 as a table: passes the checks (raising like ``check_dataset``) and
    reports what was checked."""
    check_dataset(df, target)
    return df.sparkSession.createDataFrame(
        [(len(df.columns), True, target is None or target in df.columns)],
        "n_columns long, has_rows boolean, target_present boolean")


def save_model(model: PipelineModel, path: str) -> str:
    """S3: persist a fitted pipeline (preprocessing + model) with the ML writer."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """S3: reload a saved pipeline for scoring."""
    return PipelineModel.load(path)


def experiment_summary(spark: SparkSession, experiment_id: str, dataset_name: str, target: str, goal: str,
                       test_size: float, business_goal: str | None, rows: int, columns: int,
                       problem_type: str | None, selected_models: list[str], best_model: str | None,
                       best_model_score: float | None, report_path: str | None = None,
                       runs: list[dict] | None = None, errors: list[str] | None = None,
                       created_at: datetime | None = None) -> DataFrame:
    """One-row record of the run's configuration and outcome, with the
    full record also as JSON text (the history payload)."""
    created = (created_at or datetime.now(timezone.utc)).isoformat()
    payload = {"experiment_id": experiment_id, "dataset_name": dataset_name, "target_column": target,
               "optimization_goal": goal, "test_size": test_size, "business_goal": business_goal,
               "rows": rows, "columns": columns, "problem_type": problem_type,
               "selected_models": selected_models, "best_model": best_model,
               "best_model_score": best_model_score, "report_path": report_path,
               "html_report_path": None, "pdf_report_path": None, "created_at": created,
               "agent_runs": runs or [], "errors": errors or []}
    return spark.createDataFrame(
        [(experiment_id, created, dataset_name, target, problem_type, best_model, best_model_score,
          json.dumps(payload))],
        "experiment_id string, created_at string, dataset_name string, target_column string, "
        "problem_type string, best_model string, best_model_score double, payload_json string")
