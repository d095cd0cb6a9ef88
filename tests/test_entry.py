import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["section", "item", "value"] and len(rows) > 0


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 100


def test_sample_of_checks_at_smoke_scale(spark, sf):
    q = E.queries()
    for name in ["q18_quality_report", "e06_roc_auc_models", "m02_split_stratified", "r10_review_b_dirty_orders",
                 "s04_history_upsert"]:
        assert q[name](spark, sf).count() >= 0
