"""Registered checks: history tables (S4-S9) over experiment records derived
from ``orders`` (one experiment id per customer, one version per order), so
upserts see many versions per key and the work grows with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import history as H
from ..sources import tables as S
from .registry import register

CUT = "1998-01-01"

REC_SQL = """rec AS (
  SELECT 'exp-' || CAST(o_custkey AS VARCHAR) AS experiment_id,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, 'orders' AS dataset_name,
         o_orderpriority AS target_column,
         CASE WHEN o_orderstatus = 'F' THEN 'classification' ELSE 'regression' END AS problem_type,
         CASE WHEN o_orderstatus = 'F' THEN 'random_forest' WHEN o_orderstatus = 'O' THEN 'decision_tree' END
           AS best_model,
         o_totalprice / 1000000.0 AS best_model_score, o_orderkey AS ingest_seq, o_orderdate
  FROM orders)"""


def _records(spark, sf):
    o = S.load(spark, sf, "orders")
    st = F.col("o_orderstatus")
    return o.select(
        F.concat(F.lit("exp-"), F.col("o_custkey").cast("string")).alias("experiment_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.lit("orders").alias("dataset_name"), F.col("o_orderpriority").alias("target_column"),
        F.when(st == "F", "classification").otherwise("regression").alias("problem_type"),
        F.when(st == "F", "random_forest").when(st == "O", "decision_tree").alias("best_model"),
        (F.col("o_totalprice") / F.lit(1000000.0)).alias("best_model_score"),
        F.col("o_orderkey").alias("ingest_seq"), "o_orderdate")


def _old_and_new(r):
    old = r.where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")).drop("o_orderdate")
    new = r.where(F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz")).drop("o_orderdate")
    return old, new


def _upserted(spark, sf):
    return H.history_upsert(*_old_and_new(_records(spark, sf)))


_UPSERT_SQL = "WITH " + REC_SQL + """,
up AS (SELECT * EXCLUDE (rn, o_orderdate) FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY ingest_seq DESC) AS rn FROM rec) WHERE rn = 1)
"""

_COLS = "experiment_id, created_at, dataset_name, target_column, problem_type, best_model, best_model_score, ingest_seq"


@register("s04_history_upsert", _UPSERT_SQL + f"SELECT {_COLS} FROM up", rounded=["best_model_score"])
def s04(spark, sf):
    return _upserted(spark, sf).select(*_COLS.split(", "))


@register("s04_history_inserted", _UPSERT_SQL + f"SELECT {_COLS} FROM up", rounded=["best_model_score"])
def s04_inserted(spark, sf):
    """Base and changes as inserts of their own, merged as they are read."""
    from ..session import shared_dir
    r = _records(spark, sf)
    path = shared_dir(spark, "history")
    for part in _old_and_new(r):
        H.history_insert(part, path)
    return H.history_read(spark, path).select(*_COLS.split(", "))


@register("s05_history_append",
          "WITH " + REC_SQL + f"""
SELECT (SELECT max(ingest_seq) FROM rec WHERE o_orderdate < TIMESTAMP '{CUT}')
       + row_number() OVER (ORDER BY o_orderdate, ingest_seq) AS id, experiment_id, created_at, ingest_seq
FROM rec WHERE o_orderdate >= TIMESTAMP '{CUT}'""")
def s05(spark, sf):
    r = _records(spark, sf)
    ts = F.lit(CUT).cast("timestamp_ntz")
    log = r.where(F.col("o_orderdate") < ts).select(F.col("ingest_seq").alias("id"), "experiment_id")
    batch = r.where(F.col("o_orderdate") >= ts).select("experiment_id", "created_at", "ingest_seq", "o_orderdate")
    out = H.history_append(log, batch, ["o_orderdate", "ingest_seq"])
    return out.select("id", "experiment_id", "created_at", "ingest_seq")


@register("s06_history_recent",
          _UPSERT_SQL + f"SELECT {_COLS} FROM up ORDER BY created_at DESC, experiment_id DESC LIMIT 25",
          rounded=["best_model_score"])
def s06(spark, sf):
    return H.history_recent(_upserted(spark, sf).select(*_COLS.split(", ")), 25)


@register("s06_history_recent_by_id",
          "WITH " + REC_SQL + "SELECT ingest_seq AS id, experiment_id FROM rec ORDER BY ingest_seq DESC LIMIT 50")
def s06b(spark, sf):
    r = _records(spark, sf).select(F.col("ingest_seq").alias("id"), "experiment_id")
    return H.history_recent(r, 50, order_col="id", tie_col=None)


@register("s07_history_get",
          "WITH " + REC_SQL + "SELECT ingest_seq AS id, experiment_id, created_at FROM rec WHERE ingest_seq = 1000")
def s07(spark, sf):
    r = _records(spark, sf).select(F.col("ingest_seq").alias("id"), "experiment_id", "created_at")
    return H.history_get(r, 1000)


@register("s08_payload_roundtrip",
          "WITH " + REC_SQL + "SELECT experiment_id, created_at, best_model, best_model_score FROM rec",
          rounded=["best_model_score"])
def s08(spark, sf):
    r = _records(spark, sf)
    cols = ["experiment_id", "created_at", "best_model", "best_model_score"]
    enc = H.payload_encode(r, cols)
    dec = H.payload_decode(enc.select("payload_json"), "experiment_id string, created_at string, "
                                                       "best_model string, best_model_score double")
    return dec.select(*[F.col(f"payload.{c}").alias(c) for c in cols])


@register("s08_payload_encode_nulls",
          "WITH " + REC_SQL + "SELECT count(*) FILTER (WHERE best_model IS NULL) AS null_models FROM rec")
def s08b(spark, sf):
    enc = H.payload_encode(_records(spark, sf), ["experiment_id", "best_model"])
    return enc.agg(F.count_if(F.get_json_object("payload_json", "$.best_model").isNull()
                              & F.col("payload_json").contains('"best_model":null')).alias("null_models"))


_TITLE = ("array_to_string(list_transform(string_split(lower(replace({c}, '_', ' ')), ' '), "
          "lambda w: upper(w[1]) || w[2:]), ' ')")


@register("s09_history_frame",
          _UPSERT_SQL + f"""SELECT created_at AS "Created At", dataset_name AS "Dataset", target_column AS "Target",
  CASE WHEN coalesce(problem_type, '') = '' THEN 'Pending' ELSE {_TITLE.format(c='problem_type')} END AS "Problem Type",
  CASE WHEN coalesce(best_model, '') = '' THEN 'Pending' ELSE {_TITLE.format(c='best_model')} END AS "Best Model",
  CASE WHEN best_model_score BETWEEN -1 AND 1 THEN printf('%.2f%%', best_model_score * 100)
       ELSE printf('%.4f', best_model_score) END AS "Score", CAST(NULL AS VARCHAR) AS "Report" FROM up""")
def s09(spark, sf):
    return H.history_frame(_upserted(spark, sf))


@register("s01_read_csv_roundtrip",
          "WITH " + __import__("tabrig.checks.views", fromlist=["DIRTY_ORDERS"]).DIRTY_ORDERS
          + "\nSELECT rid, o_orderkey, o_custkey, price, priority, status, empty_col FROM dirty_orders")
def s01(spark, sf):
    from ..session import shared_dir
    from ..sources.io import read_table_csv, write_table_csv
    path = write_table_csv(S.dirty_orders(spark, sf), shared_dir(spark, "csv-dirty-orders"))
    return read_table_csv(spark, path).drop("_row_id")


@register("s01_read_csv_documents",
          "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def s01_documents(spark, sf):
    """Long texts with line ends inside quoted fields."""
    from ..session import shared_dir
    from ..sources.io import read_table_csv, write_table_csv
    docs = S.load(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = write_table_csv(docs, shared_dir(spark, "csv-documents"))
    return read_table_csv(spark, path).drop("_row_id")
