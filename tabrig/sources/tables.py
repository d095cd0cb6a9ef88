"""Given tables and the views derived from them for tests and checks.

Each derived view is written with the DataFrame API; the same view as SQL
lives in ``tabrig.checks.sql`` so both engines compute it from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_if(cond, value):
    return F.when(cond, F.lit(None)).otherwise(value)


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing values, one copy of every tenth order and an empty
    column. ``rid`` is the row key and is excluded from duplicate checks."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def shaped(rid):
        return o.select(
            rid.alias("rid"), "o_orderkey", "o_custkey",
            _null_if(k % 7 == 0, F.col("o_totalprice")).alias("price"),
            _null_if(k % 11 == 0, F.col("o_orderpriority")).alias("priority"),
            _null_if(k % 13 == 0, F.col("o_orderstatus")).alias("status"),
            F.lit(None).cast("double").alias("empty_col"))

    first = shaped(k * 2 + 0)
    copies = shaped(k * 2 + 1).where(k % 10 == 0)
    return first.unionByName(copies)


def pred_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule predictions of document quality: (row_key, label, prediction, score)."""
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    return j.select(
        F.col("doc_id").alias("row_key"), F.col("quality").alias("label"),
        F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("prediction"),
        (F.col("n_chars").cast("double") / F.lit(40000.0)).alias("score"))


def pred_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rule 'models' for document quality, one prediction table:
    (model, ord, row_key, label, prediction, score). ``lang_rule`` has no score."""
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    n = F.col("n_chars").cast("double")
    specs = [
        ("length_rule", 1, F.col("n_chars") > 500, n / F.lit(40000.0)),
        ("long_text_rule", 2, F.col("n_chars") > 2000, n / F.lit(20000.0)),
        ("lang_rule", 3, F.col("lang") == "en", F.lit(None).cast("double")),
        ("always_good", 4, F.lit(True), F.lit(0.5)),
    ]
    parts = [j.select(F.lit(m).alias("model"), F.lit(o).alias("ord"),
                      F.col("doc_id").alias("row_key"), F.col("quality").alias("label"),
                      F.when(cond, 1).otherwise(0).alias("prediction"), s.alias("score"))
             for m, o, cond, s in specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pred_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class rule predictions of order status: (model, ord, row_key,
    label, prediction, score) with text labels and no score."""
    o = load(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    specs = [
        ("price_bands", 1, F.when(price < 150000, "F").when(price < 350000, "O").otherwise("P")),
        ("priority_map", 2, F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "F")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "O").otherwise("P")),
        ("always_open", 3, F.lit("O")),
    ]
    parts = [o.select(F.lit(m).alias("model"), F.lit(k).alias("ord"),
                      F.col("o_orderkey").alias("row_key"), F.col("o_orderstatus").alias("label"),
                      p.alias("prediction"), F.lit(None).cast("double").alias("score"))
             for m, k, p in specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pred_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression rule predictions of line price: (model, ord, label, prediction)."""
    li = load(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    specs = [
        ("per_unit_1000", 1, q * 1000.0),
        ("per_unit_2000", 2, q * 2000.0),
        ("flat_50000", 3, F.lit(50000.0)),
    ]
    parts = [li.select(F.lit(m).alias("model"), F.lit(k).alias("ord"),
                       F.col("l_extendedprice").alias("label"), p.alias("prediction"))
             for m, k, p in specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
