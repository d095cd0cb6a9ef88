"""Experiment history tables (S4-S9) as parquet in the shared folder.

Upsert keeps the newest version per key with ``max_by`` (partial aggregation,
so one key holding a third of all versions never lands raw in one task) and
writes a new version folder instead of overwriting what is being read.
Appended ids are consecutive via distributed running counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import format_metric, title_case
from ..operators.ordered import row_index

RECENT_A, RECENT_B = 25, 50
INSERT = "insert"  # names the folders of inserts


def history_upsert(history: DataFrame | None, records: DataFrame, key: str = "experiment_id",
                   seq: str = "ingest_seq") -> DataFrame:
    """Insert or replace by key; the greatest ``seq`` wins."""
    allr = records if history is None else history.unionByName(records, allowMissingColumns=True)
    cols = [c for c in allr.columns if c != key]
    newest = allr.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def history_insert(records: DataFrame, path: str) -> str:
    """S4 as an insert: the records become a folder of their own in the history's folder. Nothing is read or rewritten,
    and writers do not meet: each one's files appear when it commits."""
    records.write.parquet(f"{path.rstrip('/')}/{INSERT}={uuid.uuid4().hex}")
    return path


def history_read(spark: SparkSession, path: str, key: str = "experiment_id", seq: str = "ingest_seq") -> DataFrame:
    """The history of ``history_insert``: of each key the record of the greatest ``seq``, merged as it is read. Columns
    that older records lack are null."""
    return history_upsert(None, spark.read.option("mergeSchema", "true").parquet(path).drop(INSERT), key, seq)


def history_compact(spark: SparkSession, path: str, key: str = "experiment_id", seq: str = "ingest_seq") -> str:
    """Writes the merged history as the one insert of a new history beside the old one, and returns that; later inserts go there."""
    return history_insert(history_read(spark, path, key, seq), f"{path.rstrip('/')}-{uuid.uuid4().hex[:12]}")


def history_append(log: DataFrame | None, batch: DataFrame, order_cols: list[str],
                   id_col: str = "id") -> DataFrame:
    """Append with growing integer ids (max existing id + position in the
    batch, ordered by ``order_cols``); returns the new rows with their ids."""
    start = 0
    if log is not None:
        start = log.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    idx = row_index(batch, order_cols, name="_pos")
    return idx.select((F.col("_pos") + F.lit(int(start))).cast("long").alias(id_col),
                      *[c for c in batch.columns])


def write_version(df: DataFrame, base: str) -> str:
    """Write a new version folder (never over the one being read)."""
    path = f"{base.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(path)
    return path


def history_recent(h: DataFrame, n: int = RECENT_A, order_col: str = "created_at",
                   tie_col: str | None = "experiment_id") -> DataFrame:
    """N newest rows (planned as a top-k, never a full sort)."""
    keys = [F.col(order_col).desc()] + ([F.col(tie_col).desc()] if tie_col else [])
    return h.orderBy(*keys).limit(n)


def history_get(h: DataFrame, value, key: str = "id") -> DataFrame:
    """Point lookup (the filter is pushed to the parquet scan)."""
    return h.where(F.col(key) == F.lit(value))


def payload_encode(df: DataFrame, cols: list[str], out: str = "payload_json") -> DataFrame:
    """Nested record -> JSON text (SQL nulls kept as JSON nulls)."""
    return df.withColumn(out, F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}))


def payload_decode(df: DataFrame, schema: str, col: str = "payload_json", out: str = "payload") -> DataFrame:
    """JSON text -> struct with the given DDL schema."""
    return df.withColumn(out, F.from_json(F.col(col), schema))


def history_frame(h: DataFrame) -> DataFrame:
    """The seven display columns."""
    report = F.coalesce(*[F.col(c) for c in ["html_report_path", "report_path"] if c in h.columns]) \
        if any(c in h.columns for c in ["html_report_path", "report_path"]) else F.lit(None).cast("string")
    return h.select(F.col("created_at").alias("Created At"), F.col("dataset_name").alias("Dataset"),
                    F.col("target_column").alias("Target"),
                    title_case(F.coalesce(F.col("problem_type"), F.lit(""))).alias("Problem Type"),
                    title_case(F.coalesce(F.col("best_model"), F.lit(""))).alias("Best Model"),
                    format_metric("best_model_score").alias("Score"), report.alias("Report"))
