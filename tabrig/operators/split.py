"""Reproducible train/test splits (M1-M3).

The split key is a hash of the row key and the seed, so it is map-only, stable
under any repartitioning and computable by any SQL engine. The stratified split
keeps exact per-class quotas: histograms of the hash, its upper half and then its lower half,
narrow each class down to one (hash, key) threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, quoted
from ..session import cut_lineage
from .ordered import row_index

DEFAULT_TEST_SIZE = 0.2
DEFAULT_SEED = 42
HASH_SPACE = 4294967296.0  # 2**32
#: One threshold a class: up to this number (counted) they are broadcast, beyond it joined by a shuffle.
THRESHOLDS_BROADCAST = 100_000


def hash_u32(key_col: str, seed: int = DEFAULT_SEED):
    """First 32 bits of md5(key || '|' || seed) as a long in [0, 2**32)."""
    txt = F.concat(quoted(key_col).cast("string"), F.lit(f"|{int(seed)}"))
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("long")


def hash_fraction(key_col: str, seed: int = DEFAULT_SEED):
    return hash_u32(key_col, seed) / F.lit(HASH_SPACE)


def mark_split(df: DataFrame, row_key: str, test_size: float = DEFAULT_TEST_SIZE,
               seed: int = DEFAULT_SEED, col: str = "is_test") -> DataFrame:
    """M1: adds a boolean ``is_test`` column (hash fraction < test_size)."""
    return df.withColumn(col, hash_fraction(row_key, seed) < F.lit(float(test_size)))


def split(df: DataFrame, row_key: str, test_size: float = DEFAULT_TEST_SIZE,
          seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """M1: (train, test)."""
    m = mark_split(df, row_key, test_size, seed, "_is_test")
    return (m.where(~F.col("_is_test")).drop("_is_test"), m.where(F.col("_is_test")).drop("_is_test"))


def can_stratify(df: DataFrame, target: str, task: str) -> bool:
    """M3: classification and the least class (missing excluded) has >= 2 rows."""
    if task != "classification":
        return False
    m = is_missing(quoted(target), df.schema[target].dataType)
    r = df.where(~m).groupBy(quoted(target)).count().agg(F.min("count")).first()[0]
    return r is not None and r >= 2


def can_stratify_frame(df: DataFrame, target: str, task: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(can_stratify(df, target, task),)], "can_stratify boolean")


def stratified_quotas(df: DataFrame, target: str, test_size: float = DEFAULT_TEST_SIZE) -> DataFrame:
    """Per-class test quotas: n_test = ceil(test_size * n), train quotas by the
    largest-remainder rule on n - n_test (ties -> least label, missing last), test = rest.
    Returns (target, n_c, t_c), one row per class, whatever the number of classes."""
    return _quotas_from_counts(target, df.groupBy(quoted(target)).agg(F.count(F.lit(1)).alias("n_c")), test_size)


def _quotas_from_counts(target: str, counts: DataFrame, test_size: float) -> DataFrame:
    n = counts.agg(F.sum("n_c")).first()[0] or 0
    n_test = int(math.ceil(float(test_size) * n))
    n_train = n - n_test
    cont = (F.col("n_c") / F.lit(float(max(n, 1)))) * F.lit(float(n_train))
    q = counts.select(quoted(target), "n_c", cont.alias("_cont"), F.floor(cont).cast("long").alias("_fl"))
    need = n_train - (q.agg(F.sum("_fl")).first()[0] or 0)
    q = q.withColumn("_neg_rem", F.col("_fl") - F.col("_cont")).withColumn("_none", quoted(target).isNull())
    ranked = row_index(q, ["_neg_rem", "_none", target], name="_rk")
    return ranked.select(quoted(target), "n_c",
                         (F.col("n_c") - F.col("_fl") - F.when(F.col("_rk") <= need, 1).otherwise(0))
                         .cast("long").alias("t_c"))


def _take(bins: DataFrame, target: str, column: str, wanted: DataFrame) -> DataFrame:
    """The bin of each class in which its ``take``-th row lies, as (``_qt``, ``column``, ``take`` within the bin).
    ``bins``: (target, column, ``_w``), at most 65,536 rows a class."""
    cum = F.sum("_w").over(Window.partitionBy(quoted(target)).orderBy(column))
    placed = bins.withColumn("_cum", cum).join(wanted, quoted(target).eqNullSafe(F.col("_qt")))
    before = F.col("_cum") - F.col("_w")
    return placed.where((before < F.col("take")) & (F.col("take") <= F.col("_cum"))).select(
        "_qt", column, (F.col("take") - before).alias("take"))


def stratified_thresholds(df: DataFrame, target: str, row_key: str, test_size: float = DEFAULT_TEST_SIZE,
                          seed: int = DEFAULT_SEED) -> DataFrame:
    """The last test row of each class in (hash, key) order, as (``_qt``, ``_last_u``, ``_last_key``): the class's
    histogram of the upper half of the hash gives a bucket, that of the lower half within the bucket
    the hash, and the rows of that one hash the key. Classes without a test row have no threshold."""
    u = hash_u32(row_key, seed)
    h = df.select(quoted(target), quoted(row_key).alias("_key"), u.alias("_u"))
    # classes x 65,536 rows at most; also gives the class counts
    top = cut_lineage(h.groupBy(quoted(target), F.shiftright("_u", 16).alias("_b")).agg(F.count(F.lit(1)).alias("_w")))
    quotas = _quotas_from_counts(target, top.groupBy(quoted(target)).agg(F.sum("_w").alias("n_c")), test_size)
    wanted = quotas.where("t_c > 0").select(quoted(target).alias("_qt"), F.col("t_c").alias("take"))
    bucket = cut_lineage(_take(top, target, "_b", wanted))
    within = h.join(bucket, quoted(target).eqNullSafe(F.col("_qt")) & (F.shiftright("_u", 16) == F.col("_b")))
    low = within.groupBy(quoted(target), "_u").agg(F.count(F.lit(1)).alias("_w"))
    exact = cut_lineage(_take(low, target, "_u", bucket.select("_qt", "take")))
    # rows of one 32-bit hash in each class
    exact = exact.withColumnRenamed("_u", "_last_u")
    ties = h.join(exact, quoted(target).eqNullSafe(F.col("_qt")) & (F.col("_u") == F.col("_last_u")))
    rank = F.row_number().over(Window.partitionBy("_qt").orderBy("_key"))
    last = ties.withColumn("_r", rank).where("_r = take")
    return cut_lineage(last.select("_qt", "_last_u", F.col("_key").alias("_last_key")))


def mark_split_stratified(df: DataFrame, target: str, row_key: str,
                          test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
                          col: str = "is_test") -> DataFrame:
    """M2: exact class quotas; inside a class the rows with the smallest (hash, key) go to test.
    The marks are one pass that compares each row with its class's threshold."""
    last = stratified_thresholds(df, target, row_key, test_size, seed)
    small = last.limit(THRESHOLDS_BROADCAST + 1).count() <= THRESHOLDS_BROADCAST
    marked = df.join(F.broadcast(last) if small else last, quoted(target).eqNullSafe(F.col("_qt")), "left")
    u = hash_u32(row_key, seed)
    test = (u < F.col("_last_u")) | ((u == F.col("_last_u")) & (quoted(row_key) <= F.col("_last_key")))
    return marked.select(*[quoted(c) for c in df.columns], F.coalesce(test, F.lit(False)).alias(col))


def split_stratified(df: DataFrame, target: str, row_key: str,
                     test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED
                     ) -> tuple[DataFrame, DataFrame]:
    m = mark_split_stratified(df, target, row_key, test_size, seed, "_is_test")
    return (m.where(~F.col("_is_test")).drop("_is_test"), m.where(F.col("_is_test")).drop("_is_test"))
