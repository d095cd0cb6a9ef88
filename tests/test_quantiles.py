import math
import random

import numpy as np
import pytest

from tabrig.operators import quantiles
from tabrig.operators.prep import fit_median
from tabrig.operators.profile import describe_numeric
from tabrig.operators.quantiles import column_quantiles, from_key, ordered_keys

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def expected(values, q):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    at = q * (len(values) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] + (at - lo) * (values[hi] - values[lo])


def test_keys_keep_the_order_and_the_value():
    rnd = np.random.default_rng(1)
    v = np.sort(np.concatenate([rnd.normal(size=200) * 10.0 ** rnd.integers(-300, 300, 200), [0.0, 5e-324, -5e-324, math.inf, -math.inf, 1.0]]))
    keys = ordered_keys(v)
    assert (keys[1:] >= keys[:-1]).all() and (keys[1:] > keys[:-1]).sum() == (v[1:] > v[:-1]).sum()
    assert [from_key(k) for k in keys] == v.tolist()
    assert ordered_keys(np.array([-0.0]))[0] == ordered_keys(np.array([0.0]))[0]


def test_even_count(spark):
    df = spark.createDataFrame([(float(v),) for v in [4, 1, 3, 2]], "x double")
    assert column_quantiles(df, ["x"], [0.5, 0.25]) == {("x", 0.5): 2.5, ("x", 0.25): 1.75}


def test_equal_sorting(spark):
    """Heavy tails, neighbours in the last bit, a hot value, missing cells and whole numbers."""
    rnd = random.Random(2)
    rows = []
    for i in range(3000):
        near = np.nextafter(1.0, 2.0) if i % 2 else 1.0
        rows.append((rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-200, 200), float(near), 7.5 if i % 3 else rnd.random(),
                     rnd.choice([None, float("nan"), rnd.random()]), rnd.randint(-5, 5), None))
    df = spark.createDataFrame(rows, "tail double, near double, `hot.1` double, gaps double, whole int, none double").repartition(5)
    got = column_quantiles(df, df.columns, PROBS)
    for i, c in enumerate(df.columns[:-1]):
        for q in PROBS:
            assert got[c, q] == expected([r[i] for r in rows], q), (c, q)
    assert not [k for k in got if k[0] == "none"]


def test_blocks_of_columns_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "COLUMNS", 3)
    df = spark.createDataFrame([[float(i * j % 11) for j in range(1, 8)] for i in range(50)], [f"c{j}" for j in range(7)])
    got = column_quantiles(df, df.columns, [0.5])
    assert got == {(f"c{j}", 0.5): expected([float(i * (j + 1) % 11) for i in range(50)], 0.5) for j in range(7)}
    assert column_quantiles(df.limit(0), df.columns, [0.5]) == {} and column_quantiles(df, [], [0.5]) == {}
    assert fit_median(df.limit(0), ["c0"]) == {"c0": None}


def test_describe_leaves_out_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    got = describe_numeric(df).collect()
    assert [r["column_name"] for r in got] == ["a"] and got[0]["p25"] == 1.5 and got[0]["std"] == pytest.approx(2 ** 0.5)


def test_no_values_are_shuffled(spark):
    """A scan's exchange carries bins, at most 2 ** BITS for each column and prefix and task."""
    df = spark.range(100_000).selectExpr("cast(id % 50 as double) AS x")
    bins = quantiles._select(df.selectExpr("x AS _v0"), [[0]], 64 - quantiles.BITS, quantiles.BITS)
    assert bins.count() <= 50 and bins.agg({"n": "sum"}).first()[0] == 100_000
