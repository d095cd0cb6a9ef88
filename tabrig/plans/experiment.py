"""End-to-end jobs (J1-J3): plain driver functions that chain the DataFrame
operators; every heavy step is a distributed Spark job and only bounded
results (per column / per class / per model) come back to the driver."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, fields, is_dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts as V
from ..operators import clean as C
from ..operators import profile as Q
from ..operators import rank as L
from ..operators import report as RP
from ..operators import review as R
from ..operators import task as T
from ..operators.prep import fit_transform
from ..functions.scalars import quoted
from ..operators.train import full_pipeline, train_portfolio
from ..session import with_row_id
from ..sources import history as H
from ..sources.io import check_dataset, experiment_summary, save_model


@dataclass
class StepLog:
    rows: list = field(default_factory=list)

    def run(self, name, fn, *a, **kw):
        start = datetime.now(timezone.utc)
        t0 = time.perf_counter()
        try:
            out = fn(*a, **kw)
        except Exception as e:
            self.rows.append((name, "failed", str(e), start, datetime.now(timezone.utc)))
            raise
        self.rows.append((name, "completed", f"{time.perf_counter() - t0:.2f}s", start,
                          datetime.now(timezone.utc)))
        return out

    def records(self) -> list[dict]:
        """The steps as the run's record keeps them."""
        return [{"name": n, "status": s, "message": m, "started_at": a.isoformat(), "finished_at": b.isoformat()} for n, s, m, a, b in self.rows]

    def errors(self) -> list[str]:
        return [f"{r[0]}: {r[2]}" for r in self.rows if r[1] == "failed"]

    def frame(self, spark):
        return spark.createDataFrame(self.rows, "name string, status string, message string, "
                                                "started_at timestamp, finished_at timestamp")


#: Objects of a job that are no tables: fitted Spark models and the list of what is cached.
NO_TABLES = ("model", "fitted", "persisted")


def outputs_long(spark, out: dict) -> DataFrame:
    """All outputs of a job as one table (output, ord, name, value): a row for each cell of
    its tables (``ord`` tells the rows of a table apart) and for each of its other values.
    A table under two names is listed once."""
    tables, values, seen = [], [], set()

    def cell(c, kind):
        if kind in ("struct", "array", "map"):
            return F.to_json(c)
        return F.hex(c) if kind == "binary" else c.cast("string")

    def add(path, name, v, ord_=0):
        label = f"{path}.{name}" if path else str(name)
        if isinstance(v, DataFrame):
            if id(v) not in seen and v.columns:
                seen.add(id(v))
                cells = F.array(*[F.struct(F.lit(f.name).alias("name"), cell(quoted(f.name), f.dataType.typeName()).alias("value"))
                                  for f in v.schema.fields])
                rows = v.select(F.monotonically_increasing_id().alias("ord"), cells.alias("cells"))  # numbered before the cells are cut
                rows = rows.select("ord", F.explode("cells").alias("c"))
                tables.append(rows.select(F.lit(label).alias("output"), "ord", "c.name", "c.value"))
        elif isinstance(v, dict):
            for k, x in v.items():
                add(label, k, x)
        elif is_dataclass(v):
            for f in fields(v):
                if f.name not in NO_TABLES:
                    add(label, f.name, getattr(v, f.name))
        elif isinstance(v, (list, tuple)):
            for i, x in enumerate(v):
                values.append((label, i, str(name), None if x is None else str(x)))
        else:
            values.append((path or label, ord_, str(name), None if v is None else str(v)))

    for k, v in out.items():
        add("", k, v)
    long = spark.createDataFrame(values, "output string, ord long, name string, value string")
    for t in tables:
        long = long.unionByName(t)
    return long


def run_experiment_a(df: DataFrame, target: str, goal: str = "highest_accuracy", test_size: float = 0.2,
                     business_goal: str | None = None, dataset_name: str = "uploaded_dataset.csv",
                     row_key: str | None = None, params: dict | None = None,
                     history: DataFrame | None = None, output_path: str | None = None) -> dict:
    """Profile -> clean -> task -> models -> train -> rank -> review ->
    chart data -> report tables -> history upsert. Returns named tables; with an
    ``output_path`` the report and the history are written below it."""
    spark = df.sparkSession
    check_dataset(df, target)
    if row_key is None:
        df, row_key = with_row_id(df), "_row_id"
    log = StepLog()
    exp_id = str(uuid.uuid4())
    facts = log.run("quality", Q.quality_facts, df, target, row_key)
    quality = Q.quality_report(df, target, row_key, facts)
    cleaned = log.run("clean", C.clean, df, target, row_key, True)
    active = cleaned.cleaned
    task_row = log.run("task", lambda: T.detect_task(active, target).first())
    task = task_row["problem_type"]
    models = T.model_portfolio(task, goal)
    tr = log.run("train", train_portfolio, active, target, models, task, row_key, test_size, 42, params, "A")
    metrics = tr.metrics.persist(StorageLevel.MEMORY_AND_DISK)
    lb = L.leaderboard(metrics, task, goal)
    best = lb.where("rank = 1").first()
    best_model, best_score = best["model"], best["primary_value"]
    if goal == "fastest_model":
        # Deviation: the score limits are checked on the real quality metric, not seconds.
        best_score_q = best["accuracy"] if task == "classification" else best["r2"]
    else:
        best_score_q = best_score
    review = log.run("review", R.review_a, active, target, task, best_score_q, goal)
    comments = [r["comment"] for r in review.collect()]
    best_pred = tr.predictions.where(F.col("model") == best_model)
    charts = {"leaderboard": V.chart_leaderboard(lb), "missing": V.chart_missing(df, row_key, "A"),
              "target": V.chart_target(active, target),
              "importance": tr.importances.where(F.col("model") == best_model).select("feature", "contribution"),
              "correlation": V.correlation_matrix(active, row_key)}
    if task == "classification":
        charts["confusion"] = V.chart_confusion(best_pred.drop("model"), mode="A")
        charts["roc"] = V.chart_roc(best_pred.drop("model"), mode="A")
    metric_cols = [c for c in metrics.columns if c not in ("model", "ord")]
    report = RP.report_sections({
        "Executive Summary": RP.report_summary(spark, len(models), business_goal, best_model, task, best_score),
        "Dataset": RP.report_dataset(df, target, dataset_name, row_key, facts),
        "Quality": RP.report_quality(df, target, row_key, facts),
        "Cleaning": RP.report_cleaning(cleaned.log),
        "Problem": RP.report_problem(spark, task, target, goal, test_size, business_goal),
        "Leaderboard": RP.formatted_leaderboard(lb, metric_cols),
        "Best Model Metrics": RP.report_metrics(metrics, best_model, task, fixed_set=False),
        "Review": review.select("ord", F.col("rule").alias("key"), F.col("comment").alias("value")),
    })
    summary = experiment_summary(spark, exp_id, dataset_name, target, goal, test_size, business_goal,
                                 cleaned.summary["remaining_rows"] + cleaned.summary["rows_removed"],
                                 len(Q.data_columns(df, row_key)), task, models, best_model, best_score,
                                 runs=log.records(), errors=log.errors())
    record = summary.withColumn("ingest_seq", F.lit(int(time.time() * 1e6)))
    hist = H.history_upsert(history, record)
    out = {"experiment_id": exp_id, "quality": quality, "cleaned": active, "cleaning_summary": cleaned.summary,
           "change_log": cleaned.log, "task": task, "task_reason": task_row["reason"], "models": models,
           "metrics": metrics, "leaderboard": lb, "best_model": best_model, "best_score": best_score,
           "predictions": tr.predictions, "importances": tr.importances, "review": review,
           "business_recommendation": R.business_recommendation(best_model, business_goal),
           "charts": charts, "report": report, "history": hist, "train": tr, "comments": comments,
           "run_log": log.frame(spark)}
    if task == "classification":
        out["class_report"] = tr.report()
    if output_path:
        base = output_path.rstrip("/")
        out["report_path"] = RP.write_report(report, f"{base}/reports/{exp_id}")
        out["history_path"] = H.history_insert(record, f"{base}/history")  # its own row only; ``history_read`` merges
    return out


def run_experiment_b(df: DataFrame, target: str, name: str | None = None, row_key: str | None = None,
                     params: dict | None = None, log_table: DataFrame | None = None,
                     output_path: str | None = None) -> dict:
    """fit/transform on the whole table -> scored task inference ->
    portfolio -> train on that matrix with per-model errors -> tuple leaderboard ->
    review -> chart data -> history append. With an ``output_path`` every fitted model
    is saved below it and its path returned and recorded."""
    spark = df.sparkSession
    name = name or f"experiment_{uuid.uuid4().hex[:8]}"
    ft = fit_transform(df, target, row_key)
    strat = T.infer_task(df, target).first().asDict()
    task = strat["task_type"]
    models = T.model_portfolio(task)
    # The rows hold the fitted matrix: split and train on it, nothing is fitted again.
    # Deduplicated rows are all different, so without a key their content is one.
    key, rows = row_key, ft.assembled
    if key is None:
        key = "_content"
        rows = rows.withColumn(key, F.md5(F.to_json(F.struct(*[quoted(c) for c in df.columns]))))
    tr = train_portfolio(rows, target, models, task, key, 0.2, 42, params, mode="B", prepared=ft.preprocessor)
    paths = {}
    if output_path:
        paths = {m: save_model(full_pipeline(ft.preprocessor, model), f"{output_path.rstrip('/')}/models/{name}/{m}")
                 for m, model in tr.fitted.items()}
    lb = L.leaderboard_tuple(tr.metrics, task)
    rec = L.recommendation(lb, task)
    top = lb.where("rank = 1").first()
    top_acc = top["accuracy"] if task == "classification" else None
    review = R.review_b(df, target, top_acc, row_key)
    charts = {"missing": V.chart_missing(df, row_key, "B"), "comparison": V.chart_leaderboard_b(lb, task)}
    if task == "classification":
        charts["confusion"] = V.chart_confusion(tr.predictions, mode="B")
        charts["roc"] = V.chart_roc(tr.predictions, mode="B")
    metric_cols = [c for c in tr.metrics.columns if c not in ("model", "ord", "error")]
    report = RP.report_b(df, lb, metric_cols, review, tr.importances, row_key)
    report_paths = {}
    if output_path:
        report_paths["report"] = RP.write_report(report, f"{output_path.rstrip('/')}/reports/{name}")
    # a row for each model
    entries = [{"name": r["model"], "metrics": {c: r[c] for c in metric_cols}, "error": r["error"], "path": paths.get(r["model"])}
               for r in tr.metrics.orderBy("ord").collect()]
    best = next(e for e in entries if e["name"] == top["model"])
    best = {k: best[k] for k in ("name", "metrics")}
    summary = {"rows": tr.train_rows + tr.test_rows, "columns": len(df.columns), "features": ft.preprocessor.encoder.width}
    batch = spark.createDataFrame(
        [(datetime.now(timezone.utc).isoformat(), name, target, task, json.dumps(summary), json.dumps(entries),
          json.dumps(best["metrics"]), json.dumps(best), json.dumps(report_paths))],
        "timestamp string, name string, target string, task_type string, dataset_summary string, models string, "
        "metrics string, best_model string, report_paths string")
    appended = H.history_append(log_table, batch, ["timestamp", "name"])
    return {"experiment_name": name, "strategy": strat, "task": task, "models": models, "metrics": tr.metrics,
            "leaderboard": lb, "recommendation": rec, "review": review, "charts": charts, "report": report,
            "importances": tr.importances, "model_paths": paths, "report_paths": report_paths, "errors": tr.errors,
            "best_model": best, "history_rows": appended, "train": tr, "preprocessor": ft.preprocessor}


def analyze_dataset(df: DataFrame, target: str | None = None, row_key: str | None = None) -> dict:
    """Inspect + missing per column + duplicates + preview + describe +
    target distribution."""
    out = {"inspect": Q.inspect(df, row_key), "missing": Q.missing_by_column(df, row_key),
           "duplicates": Q.duplicate_count(df, row_key),
           "describe_numeric": Q.describe_numeric(df, row_key),
           "describe_categorical": Q.describe_categorical(df, row_key)}
    if row_key:
        out["preview"] = Q.preview(df, row_key)
        out["duplicate_members"] = Q.duplicate_members(df, row_key)
    if target and target in df.columns:
        out["target_distribution"] = Q.target_distribution(df, target)
    return out
