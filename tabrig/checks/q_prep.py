"""Registered checks: preprocessing statistics and transforms (F1-F9), fitted on
the hash-split training rows of the dirty orders view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep as P
from ..operators import split as M
from ..sources import tables as S
from .registry import register
from .views import DIRTY_ORDERS, with_views

W = with_views(DIRTY_ORDERS)
_U = "CAST('0x' || substring(md5(concat(CAST(rid AS VARCHAR), '|42')), 1, 8) AS BIGINT) / 4294967296.0"
TRAIN = f"(SELECT * FROM dirty_orders WHERE NOT ({_U} < 0.2))"


def _train(spark, sf):
    d = S.dirty_orders(spark, sf)
    train, _ = M.split(d, "rid")
    return d, train


@register("f01_impute_median",
          W + f"SELECT rid, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {TRAIN})) AS price FROM dirty_orders",
          rounded=["price"])
def f01(spark, sf):
    d, train = _train(spark, sf)
    med = P.fit_median(train, ["price"])
    return P.impute_median(d.select("rid", "price"), med)


@register("f01_median_values_lineitem",
          "SELECT 'l_extendedprice' AS column_name, quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem "
          "UNION ALL SELECT 'l_quantity', quantile_cont(l_quantity, 0.5) FROM lineitem "
          "UNION ALL SELECT 'l_discount', quantile_cont(l_discount, 0.5) FROM lineitem",
          rounded=["median"])
def f01b(spark, sf):
    li = S.load(spark, sf, "lineitem")
    med = P.fit_median(li, ["l_extendedprice", "l_quantity", "l_discount"])
    return spark.createDataFrame(list(med.items()), "column_name string, median double")


_MODE = (f"(SELECT v FROM (SELECT priority AS v, count(*) AS w FROM {TRAIN} WHERE priority IS NOT NULL "
         "GROUP BY 1) ORDER BY w DESC, v LIMIT 1)")


@register("f02_impute_most_frequent",
          W + f"SELECT rid, coalesce(priority, {_MODE}) AS priority FROM dirty_orders")
def f02(spark, sf):
    d, train = _train(spark, sf)
    modes = P.fit_most_frequent(train, ["priority"])
    return P.impute_most_frequent(d.select("rid", "priority"), {"priority": modes["priority"]["mode"]})


_MED = f"(SELECT quantile_cont(price, 0.5) FROM {TRAIN})"
_IMP = f"(SELECT coalesce(price, {_MED}) AS p FROM {TRAIN})"


@register("f03_standardize",
          W + f"""SELECT rid, (coalesce(price, {_MED}) - s.m) / CASE WHEN s.sd = 0 THEN 1 ELSE s.sd END AS price
              FROM dirty_orders, (SELECT avg(p) AS m, stddev_pop(p) AS sd FROM {_IMP}) s""",
          rounded=["price"])
def f03(spark, sf):
    d, train = _train(spark, sf)
    med = P.fit_median(train, ["price"])
    params = P.fit_standardize(P.impute_median(train.select("price"), med), ["price"])
    return P.standardize(P.impute_median(d.select("rid", "price"), med), params)


@register("f04_one_hot_long",
          W + f"""SELECT rid, 'priority_' || coalesce(priority, {_MODE}) AS feature FROM dirty_orders
              WHERE coalesce(priority, {_MODE}) IN (SELECT DISTINCT priority FROM {TRAIN} WHERE priority IS NOT NULL)""")
def f04(spark, sf):
    d, train = _train(spark, sf)
    modes = P.fit_most_frequent(train, ["priority"])
    imp = P.impute_most_frequent(d.select("rid", "priority"), {"priority": modes["priority"]["mode"]})
    cats = P.category_values(train, ["priority"])
    return P.one_hot_long(imp.select("rid", "priority"), "rid", cats)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_NUMBERS = ["o_orderkey", "o_custkey", "price"]


def _scaled(cols: list[str], fitted_on: str) -> list[str]:
    """(value - mean) / population std of each median-imputed column, with statistics of ``fitted_on``."""
    out = []
    for c in cols:
        med = f"(SELECT quantile_cont({c}, 0.5) FROM {fitted_on})"
        stat = f"FROM (SELECT coalesce({c}, {med}) AS p FROM {fitted_on})"
        out.append(f"(coalesce({c}, {med}) - (SELECT avg(p) {stat})) / (SELECT CASE WHEN stddev_pop(p) = 0 THEN 1 ELSE stddev_pop(p) END {stat})")
    return out


def _mode_of(column: str, fitted_on: str) -> str:
    return f"(SELECT v FROM (SELECT {column} AS v, count(*) AS w FROM {fitted_on} WHERE {column} IS NOT NULL GROUP BY 1) ORDER BY w DESC, v LIMIT 1)"


def _wide_sql(rows: str, fitted_on: str) -> str:
    numbers = [f"{x} AS {c}" for c, x in zip(_NUMBERS, _scaled(_NUMBERS, fitted_on))]
    hits = [f"CASE WHEN coalesce(priority, {_mode_of('priority', fitted_on)}) = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"priority_{v}\"" for v in PRIORITIES]
    return f"SELECT rid, {', '.join(numbers + hits)} FROM {rows}"


_ALL = "o_orderkey, o_custkey, price, priority, status"
_DEDUPED = f"(SELECT min(rid) AS rid, {_ALL} FROM dirty_orders GROUP BY {_ALL})"


@register("f05_preprocessor_features", W + _wide_sql("dirty_orders", TRAIN), rounded=_NUMBERS)
def f05(spark, sf):
    d, train = _train(spark, sf)
    prep = P.build_preprocessor(train, target="status", row_key="rid")
    return P.to_wide(prep.transform(d), prep, ["rid"])


# the orders with the customer as text: a category with a value for every customer
_TEXT = "texts AS (SELECT rid, o_orderkey, price, CAST(o_custkey AS VARCHAR) AS customer, priority, status FROM dirty_orders)"
_TEXT_TRAIN = f"(SELECT * FROM texts WHERE NOT ({_U} < 0.2))"
_CATEGORIES = ["customer", "priority"]


def _texts(spark, sf):
    d = S.dirty_orders(spark, sf)
    return d.select("rid", "o_orderkey", "price", F.col("o_custkey").cast("string").alias("customer"), "priority", "status")


def _long_sql(rows: str, fitted_on: str) -> str:
    cols = ["o_orderkey", "price"]
    parts = [f"SELECT rid, '{c}' AS feature, CAST({x} AS DOUBLE) AS value FROM {rows}" for c, x in zip(cols, _scaled(cols, fitted_on))]
    for c in _CATEGORIES:
        v = f"coalesce({c}, {_mode_of(c, fitted_on)})"
        parts.append(f"SELECT rid, '{c}_' || {v}, 1.0::DOUBLE FROM {rows} WHERE {v} IN (SELECT {c} FROM {fitted_on} WHERE {c} IS NOT NULL)")
    return " UNION ALL ".join(parts)


@register("f05_features_long", with_views(DIRTY_ORDERS, _TEXT) + _long_sql("texts", _TEXT_TRAIN), rounded=["value"])
def f05_long(spark, sf):
    d = _texts(spark, sf)
    train, _ = M.split(d, "rid")
    prep = P.build_preprocessor(train, target="status", row_key="rid")
    return prep.encoder.long_features(d, "rid")


@register("f06_feature_names", with_views(DIRTY_ORDERS, _TEXT) + f"""
SELECT row_number() OVER (ORDER BY part, v) - 1 AS idx, CASE WHEN part < 3 THEN v ELSE name || '_' || v END AS feature FROM (
  SELECT 1 AS part, '' AS name, 'o_orderkey' AS v UNION ALL SELECT 2, '', 'price'
  UNION ALL SELECT DISTINCT 3, 'customer', customer FROM {_TEXT_TRAIN} WHERE customer IS NOT NULL
  UNION ALL SELECT DISTINCT 4, 'priority', priority FROM {_TEXT_TRAIN} WHERE priority IS NOT NULL)""")
def f06(spark, sf):
    train, _ = M.split(_texts(spark, sf), "rid")
    return P.feature_names(P.build_preprocessor(train, target="status", row_key="rid"))


@register("f07_fit_transform", W + _wide_sql(_DEDUPED, _DEDUPED), rounded=_NUMBERS)
def f07(spark, sf):
    return P.fit_transform(S.dirty_orders(spark, sf).drop("empty_col"), "status", "rid").features


_TEXT_DEDUPED = "(SELECT min(rid) AS rid, o_orderkey, price, customer, priority, status FROM texts GROUP BY ALL)"


@register("f07_fit_transform_long", with_views(DIRTY_ORDERS, _TEXT) + _long_sql(_TEXT_DEDUPED, _TEXT_DEDUPED), rounded=["value"])
def f07_long(spark, sf):
    return P.fit_transform(_texts(spark, sf), "status", "rid").features_long


@register("f08_transform_new_rows", W + _wide_sql(
    "(SELECT min(rid) AS rid, o_orderkey, o_custkey, price, priority FROM dirty_orders GROUP BY ALL)", TRAIN), rounded=_NUMBERS)
def f08(spark, sf):
    d, train = _train(spark, sf)
    prep = P.build_preprocessor(train, target="status", row_key="rid")
    return P.transform(prep, d.drop("status"), row_key="rid")


@register("f08_transform_new_rows_long", with_views(DIRTY_ORDERS, _TEXT) + _long_sql(
    "(SELECT min(rid) AS rid, o_orderkey, price, customer, priority FROM texts GROUP BY ALL)", _TEXT_TRAIN), rounded=["value"])
def f08_long(spark, sf):
    d = _texts(spark, sf)
    train, _ = M.split(d, "rid")
    prep = P.build_preprocessor(train, target="status", row_key="rid")
    return P.transform_long(prep, d.drop("status"), "rid")


@register("f09_preprocessing_actions",
          W + """SELECT * FROM (
  SELECT 1 AS ord, 'Missing feature values handled during model preprocessing' AS note
  FROM dirty_orders HAVING count(*) FILTER (WHERE price IS NULL OR priority IS NULL) > 0
  UNION ALL SELECT 2, '1 categorical feature(s) encoded'
  UNION ALL SELECT 3, '4 numerical feature(s) standardized')""")
def f09(spark, sf):
    return P.preprocessing_actions(S.dirty_orders(spark, sf), "status", "rid")
