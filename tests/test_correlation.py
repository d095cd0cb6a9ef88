import numpy as np
import pandas as pd
import pytest

from tabrig.operators import correlation
from tabrig.operators.charts import correlation_matrix


def wide(spark, n, k, gaps=0.1, parts=4):
    rnd = np.random.default_rng(k)
    x = rnd.normal(size=(n, k)) * 10.0 ** rnd.integers(-3, 4, k) + 10.0 ** rnd.integers(0, 3, k)
    x[:, 1] = x[:, 0] * 2 + 1
    x[rnd.random((n, k)) < gaps] = np.nan
    x[:, k - 1] = 5.0
    names = [f"c.{i}" for i in range(k)]
    return pd.DataFrame(x, columns=names), spark.createDataFrame(x.tolist(), names).repartition(parts)


def check(pdf, df):
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation_matrix(df, decimals=6).collect()}
    want = pdf.corr().fillna(0.0)
    assert len(got) == len(pdf.columns) ** 2
    for a in pdf.columns:
        for b in pdf.columns:
            assert got[a, b] == pytest.approx(want.loc[a, b], abs=2e-6), (a, b)


def test_pairwise_complete_with_gaps(spark):
    check(*wide(spark, 300, 9))


@pytest.mark.parametrize("tile", [2, 4, 5])
def test_tiles_meet(spark, monkeypatch, tile):
    monkeypatch.setattr(correlation, "TILE", tile)
    check(*wide(spark, 200, 9))


def test_more_partitions_than_rows_and_empty_tables(spark):
    pdf, df = wide(spark, 5, 4, gaps=0.0, parts=12)
    check(pdf, df)
    assert correlation_matrix(df.limit(0)).count() == 0
    assert correlation_matrix(df.select("`c.0`")).count() == 0


def test_a_thousand_columns(spark):
    """More columns than a tile; a column is its own mirror image every hundred columns."""
    k = 1000
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(64, 100))
    x = np.hstack([base * (-1) ** i for i in range(10)])
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(k)])
    got = correlation_matrix(df)
    assert got.count() == k * k
    r = {(q["col_a"], q["col_b"]): q["corr"] for q in got.where("col_a IN ('c7', 'c999')").collect()}
    assert r["c7", "c107"] == -1.0 and r["c7", "c207"] == 1.0 and r["c999", "c99"] == -1.0 and len(r) == 2 * k
