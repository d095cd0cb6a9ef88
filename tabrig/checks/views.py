"""The derived views as DuckDB SQL (same definitions as ``tabrig.sources.tables``)."""

DIRTY_ORDERS = """dirty_orders AS (
  SELECT o_orderkey * 2 + 0 AS rid, o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 7  = 0 THEN NULL ELSE o_totalprice    END AS price,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus   END AS status,
    CAST(NULL AS DOUBLE) AS empty_col
  FROM orders
  UNION ALL
  SELECT o_orderkey * 2 + 1, o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 7  = 0 THEN NULL ELSE o_totalprice    END,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus   END,
    CAST(NULL AS DOUBLE)
  FROM orders WHERE o_orderkey % 10 = 0
)"""

DIRTY_COLS = ["o_orderkey", "o_custkey", "price", "priority", "status", "empty_col"]

PRED_QUALITY = """pred_quality AS (
  SELECT doc_id AS row_key, quality AS label,
    CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS prediction,
    CAST(n_chars AS DOUBLE) / CAST(40000 AS DOUBLE) AS score
  FROM documents JOIN labels USING (doc_id)
)"""

PRED_MODELS = """pred_models AS (
  SELECT 'length_rule' AS model, 1 AS ord, doc_id AS row_key, quality AS label,
    CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS prediction,
    CAST(n_chars AS DOUBLE) / 40000.0 AS score
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'long_text_rule', 2, doc_id, quality,
    CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END, CAST(n_chars AS DOUBLE) / 20000.0
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'lang_rule', 3, doc_id, quality,
    CASE WHEN lang = 'en' THEN 1 ELSE 0 END, CAST(NULL AS DOUBLE)
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'always_good', 4, doc_id, quality, 1, 0.5
  FROM documents JOIN labels USING (doc_id)
)"""

PRED_ORDERS = """pred_orders AS (
  SELECT 'price_bands' AS model, 1 AS ord, o_orderkey AS row_key, o_orderstatus AS label,
    CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 350000 THEN 'O' ELSE 'P' END
      AS prediction, CAST(NULL AS DOUBLE) AS score
  FROM orders
  UNION ALL
  SELECT 'priority_map', 2, o_orderkey, o_orderstatus,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'O' ELSE 'P' END, CAST(NULL AS DOUBLE)
  FROM orders
  UNION ALL
  SELECT 'always_open', 3, o_orderkey, o_orderstatus, 'O', CAST(NULL AS DOUBLE)
  FROM orders
)"""

PRED_PRICE = """pred_price AS (
  SELECT 'per_unit_1000' AS model, 1 AS ord, l_extendedprice AS label, l_quantity * 1000.0 AS prediction
  FROM lineitem
  UNION ALL
  SELECT 'per_unit_2000', 2, l_extendedprice, l_quantity * 2000.0 FROM lineitem
  UNION ALL
  SELECT 'flat_50000', 3, l_extendedprice, 50000.0 FROM lineitem
)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def missing_sum(cols) -> str:
    return " + ".join(f"(count(*) - count({c}))" for c in cols)
