"""Registered checks: profiling and cleaning on the derived ``dirty_orders`` view
(target ``status``, row key ``rid``) and on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as K
from ..operators import clean as C
from ..operators import profile as Q
from ..sources import tables as S
from .registry import register
from .views import DIRTY_COLS, DIRTY_ORDERS, missing_sum, with_views

W = with_views(DIRTY_ORDERS)
KEY = "rid"
TARGET = "status"


def _dirty(spark, sf):
    return S.dirty_orders(spark, sf)


@register("q01_shape", W + "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM dirty_orders")
def q01(spark, sf):
    return Q.shape(_dirty(spark, sf), KEY)


_Q02_SQL = W + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM dirty_orders" for c in DIRTY_COLS)


@register("q02_missing_by_column", _Q02_SQL)
def q02(spark, sf):
    return Q.missing_by_column(_dirty(spark, sf), KEY)


@register("q02_missing_by_column_positive",
          "SELECT * FROM (" + _Q02_SQL + ") WHERE missing > 0")
def q02b(spark, sf):
    return Q.missing_by_column(_dirty(spark, sf), KEY, only_positive=True)


@register("q03_missing_total",
          W + f"SELECT CAST({missing_sum(DIRTY_COLS)} AS BIGINT) AS missing_total FROM dirty_orders")
def q03(spark, sf):
    return Q.missing_total(_dirty(spark, sf), KEY)


_GROUP_ALL = ", ".join(DIRTY_COLS)


@register("q04_duplicate_count",
          W + f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM "
              f"(SELECT count(*) AS n FROM dirty_orders GROUP BY {_GROUP_ALL})")
def q04(spark, sf):
    return Q.duplicate_count(_dirty(spark, sf), KEY)


@register("q04_duplicate_count_lineitem",
          "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM "
          "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
          "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)")
def q04b(spark, sf):
    return Q.duplicate_count(S.load(spark, sf, "lineitem"))


@register("q06_dtype_summary_lineitem",
          """SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                 WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
                 WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type,
                 count(*) AS n_columns
             FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1""")
def q06(spark, sf):
    return Q.dtype_summary(S.load(spark, sf, "lineitem"))


@register("p01_split_feature_types_lineitem",
          """SELECT column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT',
                 'SMALLINT', 'TINYINT', 'BOOLEAN') OR data_type LIKE 'DECIMAL%' THEN 'numeric'
                 ELSE 'categorical' END AS kind
             FROM information_schema.columns WHERE table_name = 'lineitem'""")
def p01(spark, sf):
    return Q.split_feature_types(S.load(spark, sf, "lineitem"))


@register("q07_target_profile",
          W + "SELECT count(*) - count(status) AS target_missing, "
              "count(DISTINCT status) AS target_distinct FROM dirty_orders")
def q07(spark, sf):
    return Q.target_profile(_dirty(spark, sf), TARGET)


@register("q08_class_distribution",
          W + "SELECT status AS label, count(*) AS n FROM dirty_orders "
              "WHERE (SELECT count(DISTINCT status) FROM dirty_orders) <= 20 GROUP BY status")
def q08(spark, sf):
    return Q.class_distribution(_dirty(spark, sf), TARGET)


@register("q08_class_distribution_capped",
          "SELECT l_quantity AS label, count(*) AS n FROM lineitem "
          "WHERE (SELECT count(DISTINCT l_quantity) FROM lineitem) <= 20 GROUP BY l_quantity")
def q08b(spark, sf):
    return Q.class_distribution(S.load(spark, sf, "lineitem"), "l_quantity")


@register("q09_target_distribution",
          W + "SELECT priority AS label, count(*) AS n FROM dirty_orders GROUP BY priority")
def q09(spark, sf):
    return Q.target_distribution(_dirty(spark, sf), "priority")


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]
_Q10_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
        CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
        quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""" for c in _LI_NUM)


@register("q10_describe_numeric_lineitem", _Q10_SQL,
          rounded=["mean", "std", "min", "p25", "p50", "p75", "max"])
def q10(spark, sf):
    return Q.describe_numeric(S.load(spark, sf, "lineitem"))


_Q11_SQL = W + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, CAST(sum(w) AS BIGINT) AS count, count(*) AS unique,
        arg_min(v, (-w, v)) AS top, max(w) AS freq
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS w FROM dirty_orders
              WHERE {c} IS NOT NULL GROUP BY 1)""" for c in ["priority", "status"])


@register("q11_describe_categorical", _Q11_SQL)
def q11(spark, sf):
    return Q.describe_categorical(_dirty(spark, sf), KEY)


@register("q12_dataset_health",
          W + f"""SELECT n_rows, CAST(6 AS BIGINT) AS n_columns, missing_total, duplicate_rows,
                 greatest(0.0, 100.0 - (missing_total + duplicate_rows * 6) / greatest(n_rows * 6, 1) * 100.0)
                   AS health
              FROM (SELECT count(*) AS n_rows, CAST({missing_sum(DIRTY_COLS)} AS BIGINT) AS missing_total
                    FROM dirty_orders) a,
                   (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM
                      (SELECT count(*) AS n FROM dirty_orders GROUP BY {_GROUP_ALL})) b""",
          rounded=["health"])
def q12(spark, sf):
    return Q.dataset_health(_dirty(spark, sf), KEY)


@register("q13_type_counts_orders",
          """SELECT count(*) FILTER (WHERE data_type IN ('BIGINT','INTEGER','DOUBLE')) AS numeric_columns,
                    count(*) FILTER (WHERE data_type NOT IN ('BIGINT','INTEGER','DOUBLE')) AS categorical_columns
             FROM information_schema.columns WHERE table_name = 'orders'""")
def q13(spark, sf):
    return Q.type_counts(S.load(spark, sf, "orders"))


@register("q14_estimated_bytes_orders",
          "\nUNION ALL\n".join(
              [f"SELECT '{c}' AS column_name, CAST(count(*) * 8 AS BIGINT) AS bytes FROM orders"
               for c in ["o_orderkey", "o_custkey"]] +
              [f"SELECT '{c}' AS column_name, CAST(coalesce(sum(strlen({c})), 0) AS BIGINT) AS bytes FROM orders"
               for c in ["o_orderstatus"]] +
              ["SELECT 'o_totalprice', CAST(count(*) * 8 AS BIGINT) FROM orders",
               "SELECT 'o_orderdate', CAST(count(*) * 8 AS BIGINT) FROM orders",
               "SELECT 'o_orderpriority', CAST(coalesce(sum(strlen(o_orderpriority)), 0) AS BIGINT) FROM orders"]))
def q14(spark, sf):
    return Q.estimated_bytes(S.load(spark, sf, "orders"))


@register("q15_missing_ranked",
          "SELECT * FROM (" + _Q02_SQL + ") WHERE missing > 0 ORDER BY missing DESC, column_name LIMIT 12")
def q15(spark, sf):
    return Q.missing_ranked(_dirty(spark, sf), KEY)


@register("q16_duplicate_members",
          W + f"""SELECT rid, o_orderkey, o_custkey, price, priority, status, empty_col FROM (
                 SELECT *, count(*) OVER (PARTITION BY {_GROUP_ALL}) AS n FROM dirty_orders)
              WHERE n > 1 ORDER BY rid LIMIT 100""")
def q16(spark, sf):
    return Q.duplicate_members(_dirty(spark, sf), KEY)


@register("q16_duplicate_members_all",
          W + f"""SELECT rid, o_orderkey, o_custkey, price, priority, status, empty_col FROM (
                 SELECT *, count(*) OVER (PARTITION BY {_GROUP_ALL}) AS n FROM dirty_orders)
              WHERE n > 1""")
def q16b(spark, sf):
    return Q.duplicate_members(_dirty(spark, sf), KEY, n=None)


_Q18_SQL = W + f"""
SELECT 'shape' AS section, 'rows' AS item, count(*) AS value FROM dirty_orders
UNION ALL SELECT 'shape', 'columns', 6
UNION ALL SELECT 'duplicate_rows', '', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
  FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY {_GROUP_ALL})
UNION ALL SELECT 'missing_values_total', '', CAST({missing_sum(DIRTY_COLS)} AS BIGINT) FROM dirty_orders
UNION ALL SELECT 'missing_values_by_column', column_name, missing FROM ({_Q02_SQL.replace(W, '')}) WHERE missing > 0
UNION ALL SELECT 'target', 'missing_values', count(*) - count(status) FROM dirty_orders
UNION ALL SELECT 'target', 'unique_values', count(DISTINCT status) FROM dirty_orders
UNION ALL SELECT 'class_distribution', coalesce(status, 'nan'), count(*) FROM dirty_orders
  WHERE (SELECT count(DISTINCT status) FROM dirty_orders) <= 20 GROUP BY status
"""


@register("q18_quality_report", _Q18_SQL)
def q18(spark, sf):
    return Q.quality_report(_dirty(spark, sf), TARGET, KEY)


# ----------------------------------------------------------------------------- P3-P5, cleaning
@register("p03_preview", W + "SELECT rid, price, status FROM dirty_orders ORDER BY rid LIMIT 100")
def p03(spark, sf):
    return Q.preview(_dirty(spark, sf), KEY, ["price", "status"])


@register("p04_drop_empty_columns",
          W + "SELECT rid, o_orderkey, o_custkey, price, priority, status FROM dirty_orders")
def p04(spark, sf):
    return C.drop_empty_columns(_dirty(spark, sf), KEY)


@register("p05_drop_missing_target", W + "SELECT * FROM dirty_orders WHERE status IS NOT NULL")
def p05(spark, sf):
    return C.drop_missing_target(_dirty(spark, sf), TARGET)


@register("c01_drop_duplicates",
          W + f"SELECT min(rid) AS rid, {_GROUP_ALL} FROM dirty_orders GROUP BY {_GROUP_ALL}")
def c01(spark, sf):
    return C.drop_duplicates(_dirty(spark, sf), KEY)


_REMOVED = f"""SELECT d.* FROM dirty_orders d ANTI JOIN
   (SELECT min(rid) AS rid FROM dirty_orders GROUP BY {_GROUP_ALL}) k USING (rid)"""


@register("c02_duplicate_rows", W + _REMOVED + " ORDER BY rid LIMIT 25")
def c02(spark, sf):
    return C.duplicate_rows(_dirty(spark, sf), KEY)


_G5 = "o_orderkey, o_custkey, price, priority, status"
_CLEANED = f"""SELECT min(rid) AS rid, {_G5} FROM dirty_orders GROUP BY {_G5}"""


@register("c03_basic_clean", W + _CLEANED)
def c03(spark, sf):
    return C.basic_clean(_dirty(spark, sf), KEY).cleaned


@register("c04_clean", W + f"SELECT * FROM ({_CLEANED}) WHERE status IS NOT NULL")
def c04(spark, sf):
    return C.clean(_dirty(spark, sf), TARGET, KEY).cleaned


@register("c05_cleaning_summary",
          W + f"""SELECT CAST(b.n - a.n AS BIGINT) AS rows_removed, CAST(1 AS BIGINT) AS columns_removed,
                 a.n AS remaining_rows, CAST(5 AS BIGINT) AS remaining_columns,
                 a.tmiss AS rows_removed_missing_target, a.rem AS missing_values_remaining
              FROM (SELECT count(*) AS n, count(*) - count(status) AS tmiss,
                      CAST(count(*) FILTER (WHERE status IS NOT NULL AND price IS NULL)
                         + count(*) FILTER (WHERE status IS NOT NULL AND priority IS NULL) AS BIGINT) AS rem
                    FROM ({_CLEANED})) a,
                   (SELECT count(*) AS n FROM dirty_orders) b""")
def c05(spark, sf):
    return C.clean(_dirty(spark, sf), TARGET, KEY).summary_frame()


_LOG_SQL = W + f"""
SELECT * FROM (
  SELECT 'Removed Duplicate Row' AS change, CAST(rid AS VARCHAR) AS row_key, 'All Columns' AS column_name,
         'Row Removed' AS after, rid AS k FROM ({_REMOVED}) ORDER BY rid LIMIT 25)
UNION ALL SELECT 'Removed Empty Column', 'All Rows', 'empty_col', 'Column Removed', NULL
UNION ALL SELECT * FROM (
  SELECT 'Removed Missing Target Row', CAST(rid AS VARCHAR), 'Target', 'Row Removed', rid
  FROM ({_CLEANED}) WHERE status IS NULL ORDER BY rid LIMIT 25)
"""


@register("c06_change_log", f"SELECT change, row_key, column_name, after FROM ({_LOG_SQL})")
def c06(spark, sf):
    return C.clean(_dirty(spark, sf), TARGET, KEY).log.drop("before")


@register("c07_change_counts",
          "SELECT change, count(*) AS n FROM (" + _LOG_SQL + ") GROUP BY change")
def c07(spark, sf):
    return C.change_counts(C.clean(_dirty(spark, sf), TARGET, KEY).log)


@register("p07_changes_of_type",
          f"SELECT change, row_key, column_name, after FROM ({_LOG_SQL}) WHERE change = 'Removed Missing Target Row'")
def p07(spark, sf):
    log = C.clean(_dirty(spark, sf), TARGET, KEY).log
    return C.changes_of_type(log, C.CHANGE_MISSING_TARGET).drop("before")


@register("p08_is_noop_cleaning",
          "SELECT coalesce(bool_and(change = 'No Destructive Cleaning Required'), true) AS is_noop FROM ("
          + _LOG_SQL + ")")
def p08(spark, sf):
    return C.is_noop_cleaning(C.clean(_dirty(spark, sf), TARGET, KEY).log)


@register("c08_before_after",
          W + f"""SELECT 'before' AS side, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns,
                   CAST({missing_sum(DIRTY_COLS)} AS BIGINT) AS missing FROM dirty_orders
              UNION ALL
              SELECT 'after', count(*), CAST(5 AS BIGINT),
                   CAST({missing_sum(['o_orderkey', 'o_custkey', 'price', 'priority', 'status'])} AS BIGINT)
              FROM ({_CLEANED}) WHERE status IS NOT NULL""")
def c08(spark, sf):
    d = _dirty(spark, sf)
    return C.before_after(d, C.clean(d, TARGET, KEY).cleaned, KEY)


# ----------------------------------------------------------------------------- K1-K8 on whole tables
@register("k01_format_metric",
          """SELECT l_orderkey, l_linenumber, l_partkey,
               CASE WHEN l_discount BETWEEN -1 AND 1 THEN printf('%.2f%%', l_discount * 100)
                    ELSE printf('%.4f', l_discount) END AS discount_text,
               CASE WHEN l_extendedprice BETWEEN -1 AND 1 THEN printf('%.2f%%', l_extendedprice * 100)
                    ELSE printf('%.4f', l_extendedprice) END AS price_text
             FROM lineitem""")
def k01(spark, sf):
    li = S.load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     K.format_metric("l_discount").alias("discount_text"),
                     K.format_metric("l_extendedprice").alias("price_text"))


@register("k02_format_bytes",
          """SELECT o_orderkey, CASE
               WHEN b < 1024 THEN printf('%.1f B', b)
               WHEN b / 1024.0 < 1024 THEN printf('%.1f KB', b / 1024.0)
               WHEN b / 1048576.0 < 1024 THEN printf('%.1f MB', b / 1048576.0)
               WHEN b / 1073741824.0 < 1024 THEN printf('%.1f GB', b / 1073741824.0)
               ELSE printf('%.1f TB', b / 1099511627776.0) END AS size_text
             FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) * pow(10, o_orderkey % 12) AS b FROM orders)""")
def k02(spark, sf):
    o = S.load(spark, sf, "orders")
    b = F.col("o_totalprice").cast("double") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 12).cast("double"))
    return o.select("o_orderkey", K.format_bytes(b).alias("size_text"))


_TITLE = ("CASE WHEN {c} IS NULL OR {c} = '' THEN 'Pending' ELSE array_to_string(list_transform("
          "string_split(lower(replace({c}, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END")


@register("k03_title_case",
          f"SELECT p_partkey, {_TITLE.format(c='p_name')} AS name_title, "
          f"{_TITLE.format(c='p_type')} AS type_title FROM part")
def k03(spark, sf):
    p = S.load(spark, sf, "part")
    return p.select("p_partkey", K.title_case("p_name").alias("name_title"),
                    K.title_case("p_type").alias("type_title"))


@register("k04_safe_name",
          """SELECT c_custkey,
               lower(regexp_replace(regexp_replace(c_name, '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'))
                 AS name_safe FROM customer""")
def k04(spark, sf):
    c = S.load(spark, sf, "customer")
    return c.select("c_custkey", K.safe_name("c_name").alias("name_safe"))


@register("k05_truncate",
          """SELECT doc_id, CASE WHEN length(text) > 140 THEN substring(text, 1, 137) || '...' ELSE text END
               AS text_140,
             CASE WHEN length(text) > 160 THEN substring(text, 1, 157) || '...' ELSE text END AS text_160
             FROM documents""")
def k05(spark, sf):
    d = S.load(spark, sf, "documents")
    return d.select("doc_id", K.truncate("text", 140).alias("text_140"),
                    K.truncate("text", 160).alias("text_160"))


@register("k06_run_duration",
          """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
               printf('%.2f Sec', (epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 1000000.0) AS duration
             FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def k06(spark, sf):
    li = S.load(spark, sf, "lineitem")
    o = S.load(spark, sf, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    K.run_duration("o_orderdate", "l_shipdate").alias("duration"))


@register("k07_percent",
          "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.1f%%', l_tax * 100) AS tax_pct FROM lineitem")
def k07(spark, sf):
    li = S.load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", K.percent("l_tax", 1).alias("tax_pct"))


@register("k08_is_missing",
          W + "SELECT rid, price IS NULL OR isnan(price) AS price_missing, priority IS NULL AS priority_missing "
              "FROM dirty_orders")
def k08(spark, sf):
    d = _dirty(spark, sf)
    return d.select("rid", K.is_missing(F.col("price"), d.schema["price"].dataType).alias("price_missing"),
                    K.is_missing(F.col("priority"), d.schema["priority"].dataType).alias("priority_missing"))


@register("p02_split_xy_features", "SELECT * EXCLUDE (l_linestatus) FROM lineitem")
def p02(spark, sf):
    x, _ = Q.split_xy(S.load(spark, sf, "lineitem"), "l_linestatus")
    return x


@register("p02_split_xy_target", "SELECT o_orderkey, o_orderstatus FROM orders")
def p02b(spark, sf):
    _, y = Q.split_xy(S.load(spark, sf, "orders"), "o_orderstatus", "o_orderkey")
    return y


@register("s02_check_dataset",
          "SELECT CAST(6 AS BIGINT) AS n_columns, count(*) > 0 AS has_rows, TRUE AS target_present FROM orders")
def s02(spark, sf):
    from ..sources.io import dataset_check_frame
    return dataset_check_frame(S.load(spark, sf, "orders"), "o_orderstatus")
