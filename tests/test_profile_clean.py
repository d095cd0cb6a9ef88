import math
import random

from pyspark.sql import functions as F

from tabrig.functions import scalars as K
from tabrig.operators import clean as C
from tabrig.operators import profile as Q


def _nan_table(spark):
    rows = [(1, 1.0, "a", "x"), (2, float("nan"), "a", "x"), (3, None, None, "y"), (4, 1.0, "a", "x"),
            (5, 1.0, "a", "x")]
    return spark.createDataFrame(rows, "k long, v double, c string, t string")


def test_nan_counts_as_missing(spark):
    d = _nan_table(spark)
    m = {r["column_name"]: r["missing"] for r in Q.missing_by_column(d, "k").collect()}
    assert m == {"v": 2, "c": 1, "t": 0}
    assert Q.missing_total(d, "k").first()[0] == 3


def test_duplicates_group_nulls_and_keep_least_key(spark):
    d = _nan_table(spark)
    assert Q.duplicate_count(d, "k").first()[0] == 2  # rows 4 and 5 repeat row 1
    kept = sorted(r["k"] for r in C.drop_duplicates(d, "k").collect())
    assert kept == [1, 2, 3]
    removed = [r["k"] for r in C.duplicate_rows(d, "k").collect()]
    assert removed == [4, 5]
    members = sorted(r["k"] for r in Q.duplicate_members(d, "k").collect())
    assert members == [1, 4, 5]


def test_all_null_target_profile(spark):
    d = spark.createDataFrame([(1, None), (2, None)], "k long, t string")
    r = Q.target_profile(d, "t").first()
    assert (r["target_missing"], r["target_distinct"]) == (2, 0)
    rep = {(x["section"], x["item"]): x["value"] for x in Q.quality_report(d, "t", "k").collect()}
    assert rep[("class_distribution", "nan")] == 2


def test_class_distribution_cap(spark):
    d = spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 25).alias("t"))
    assert Q.class_distribution(d, "t").count() == 0
    d2 = spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 3).alias("t"))
    assert Q.class_distribution(d2, "t").count() == 3


def test_describe_categorical_tie_takes_least(spark):
    d = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "k long, c string")
    r = Q.describe_categorical(d, "k").first()
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (4, 2, "a", 2)


def test_describe_numeric_quartiles_interpolate(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 10])], "k long, x double")
    r = Q.describe_numeric(d, "k").first()
    assert (r["p25"], r["p50"], r["p75"]) == (2.0, 3.0, 4.0)
    assert math.isclose(r["std"], 3.5355339059327378)


def test_constant_column_and_health(spark):
    d = spark.createDataFrame([(i, 5.0, float(i)) for i in range(10)], "k long, c double, x double")
    h = Q.dataset_health(d, "k").first()
    assert h["health"] == 100.0 and h["duplicate_rows"] == 0


def test_clean_noop_log(spark):
    d = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k long, x double, t string")
    res = C.clean(d, "t", "k")
    log = res.log.collect()
    assert len(log) == 1 and log[0]["change"] == C.CHANGE_NOOP
    assert C.is_noop_cleaning(res.log).first()[0] is True


def test_clean_rejects_empty_target(spark):
    d = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "k long, x double, t string")
    try:
        C.clean(d, "t", "k")
    except ValueError as e:
        assert "removed during cleaning" in str(e)
    else:
        raise AssertionError("expected an error")


def test_clean_on_dirty_orders(spark, sf):
    from tabrig.sources.tables import dirty_orders
    res = C.clean(dirty_orders(spark, sf), "status", "rid")
    s = res.summary
    assert s["columns_removed"] == 1 and s["rows_removed"] == 150
    assert s["remaining_rows"] - s["rows_removed_missing_target"] == res.cleaned.count()
    kinds = {r["change"]: r["n"] for r in C.change_counts(res.log).collect()}
    assert kinds[C.CHANGE_EMPTY_COLUMN] == 1 and kinds[C.CHANGE_DUPLICATE] == 25


def test_scalars(spark):
    d = spark.createDataFrame([(0.1234, 1536.0, "random_forest", "A b--c!!", "x" * 150)],
                              "m double, b double, s string, n string, t string")
    r = d.select(K.format_metric("m").alias("a"), K.format_metric(F.lit(12.5)).alias("b2"),
                 K.format_metric(F.lit(None).cast("double")).alias("p"), K.format_bytes("b").alias("fb"),
                 K.title_case("s").alias("tc"), K.title_case(F.lit("")).alias("te"), K.safe_name("n").alias("sn"),
                 K.truncate("t", 140).alias("tr"), K.percent(F.lit(0.2), 0).alias("pc")).first()
    assert r["a"] == "12.34%" and r["b2"] == "12.5000" and r["p"] == "Pending"
    assert r["fb"] == "1.5 KB" and r["tc"] == "Random Forest" and r["te"] == "Pending"
    assert r["sn"] == "a_b_c" and len(r["tr"]) == 140 and r["tr"].endswith("...") and r["pc"] == "20%"


def test_duplicates_with_nan_null_and_signed_zero(spark):
    rows = [(1, 0.0, "a"), (2, -0.0, "a"), (3, float("nan"), None), (4, float("nan"), None), (5, 1.0, None),
            (6, 1.0, "b"), (7, None, None), (8, None, None), (9, None, "a")]
    d = spark.createDataFrame(rows, "k long, x double, c string")
    assert Q.duplicate_count(d, "k").first()[0] == 3
    assert [r["k"] for r in Q.duplicate_members(d, "k").collect()] == [1, 2, 3, 4, 7, 8]
    assert [r["k"] for r in C.duplicate_rows(d, "k").collect()] == [2, 4, 8]


def test_log_is_the_same_after_repartitioning(spark):
    rows = [(float(i % 5), "ab"[i % 2], i % 3 or None) for i in range(60)]
    d = spark.createDataFrame(rows, "x double, c string, y int")
    res = C.clean(d.repartition(7), "y")
    first = sorted(r["before"] for r in res.log.collect())
    assert first == sorted(r["before"] for r in res.log.collect())
    assert res.cleaned.count() == res.cleaned.select("_row_id").distinct().count() == 20


def test_first_duplicates_equal_the_full_join(spark):
    """Nulls in different columns, NaN, -0.0, a group that holds a third of all rows, dotted names."""
    rnd = random.Random(8)
    cells = [(None, "a"), ("a", None), (None, None), ("a", "a"), ("b", "c")]
    rows = [(i, *rnd.choice(cells), rnd.choice([0.0, -0.0, float("nan"), None, 1.0])) for i in range(300)] + [(1000 + i, "hot", "hot", 1.0) for i in range(150)]
    df = spark.createDataFrame(rows, "`k.x` long, a string, `b.1` string, x double").repartition(6)
    for n in (1, 25, 400):
        want = C.duplicate_rows(df, "k.x", None).limit(n).collect()
        assert [r["k.x"] for r in C.duplicate_rows(df, "k.x", n).collect()] == [r["k.x"] for r in want]
        want = Q.duplicate_members(df, "k.x", None).limit(n).collect()
        assert [r["k.x"] for r in Q.duplicate_members(df, "k.x", n).collect()] == [r["k.x"] for r in want]
    unique = df.groupBy("a", "`b.1`", "x").agg(F.min("`k.x`").alias("k"))
    assert C.duplicate_rows(unique, "k").count() == 0 and Q.duplicate_members(unique, "k", 5).count() == 0
    assert C.duplicate_rows(df.limit(0), "k.x").count() == 0


def test_the_log_exchanges_no_full_rows(spark):
    df = spark.range(1000).selectExpr("id", "id % 900 AS a", "repeat(cast(id % 900 AS string), 50) AS wide")
    listed = C.duplicate_rows(df, "id", 25, kept=C._kept(df, "id").cache())
    assert "Exchange hashpartitioning" not in listed._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in listed.collect()] == list(range(900, 925))
