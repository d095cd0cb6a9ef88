import math
import random

import pytest

from tabrig.operators import metrics as E
from tabrig.operators import rank as L
from tabrig.operators.ordered import row_index, running_totals, segmented


def _cells_table(spark, cells):
    rows, k = [], 0
    for (a, p), n in cells.items():
        for _ in range(n):
            rows.append((k, a, p, None))
            k += 1
    return spark.createDataFrame(rows, "row_key long, label int, prediction int, score double")


def test_mcc_matches_fixture_cells(spark):
    pred = _cells_table(spark, {(0, 0): 3, (0, 1): 55, (1, 0): 44, (1, 1): 297})
    r = E.classification_metrics(pred).first()
    assert round(r["matthews_corrcoef"], 6) == -0.084527
    assert math.isclose(r["accuracy"], 300 / 399)
    assert r["roc_auc"] == 0.0  # no score


def _brute_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_equals_pair_count(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 1), 0, float(rnd.randint(0, 20))) for i in range(400)]
    pred = spark.createDataFrame(rows, "row_key long, label int, prediction int, score double")
    got = E.roc_auc(pred).first()[0]
    assert math.isclose(got, _brute_auc([r[1] for r in rows], [r[3] for r in rows]), rel_tol=1e-12)


def test_auc_single_class_is_zero(spark):
    pred = spark.createDataFrame([(1, 1, 1, 0.3), (2, 1, 1, 0.6)], "row_key long, label int, prediction int, score double")
    assert E.roc_auc(pred).first()[0] == 0.0


def test_roc_points_start_at_origin_and_end_at_one(spark):
    rows = [(i, i % 2, 0, float(i % 7)) for i in range(50)]
    pred = spark.createDataFrame(rows, "row_key long, label int, prediction int, score double")
    pts = sorted(E.roc_points(pred).collect(), key=lambda r: r["idx"])
    assert (pts[0]["fpr"], pts[0]["tpr"]) == (0.0, 0.0) and math.isinf(pts[0]["threshold"])
    assert (pts[-1]["fpr"], pts[-1]["tpr"]) == (1.0, 1.0)


def test_regression_edges(spark):
    pred = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "label double, prediction double")
    r = E.regression_metrics(pred).first()
    assert r["mape"] == 0.0 and r["r2"] == 0.0 and r["mse"] == 1.0
    perfect = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert E.regression_metrics(perfect).first()["r2"] == 1.0


def test_classification_report_rows(spark):
    pred = _cells_table(spark, {(0, 0): 2, (0, 1): 1, (1, 1): 3})
    rep = {r["label"]: r for r in E.classification_report(pred).collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"]["score"] == 5 / 6 and rep["1"]["precision"] == 0.75


@pytest.mark.parametrize("ranges", [1, 2, 5, 40])
def test_running_totals_match_brute_force(spark, ranges):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c", None]), i, rnd.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, w long")
    for down in (False, True):
        got = {(r["g"], r["o"]): r["cum_w"]
               for r in running_totals(df, ["o"], ["w"], ["g"], num_partitions=ranges, descending=down).collect()}
        acc = {}
        for g, o, w in sorted(rows, key=lambda r: r[1], reverse=down):
            acc[g] = acc.get(g, 0) + w
            assert got[(g, o)] == acc[g]
        assert len(got) == 300
    idx = sorted((r["o"], r["idx"]) for r in row_index(df, ["o"], num_partitions=ranges, descending=True).collect())
    assert [i for _, i in idx] == list(range(300, 0, -1))


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_next_rows_across_segments(spark, ranges):
    """Groups of one row, of many, null and NaN groups, null values, and more partitions than rows."""
    rnd = random.Random(4)
    rows = [(rnd.choice([1.5, None, float("nan"), 2.5]), i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(120)] + [(9.0, 500, 7)]
    df = spark.createDataFrame(rows, "g double, `o.x` long, w long")
    for down in (False, True):
        want, last = {}, {}
        for g, o, w in sorted(rows, key=lambda r: r[1], reverse=not down):  # backwards, so the row before is the next
            want[o] = last.get(str(g))
            last[str(g)] = w
        got = segmented(df, ["o.x"], ["g"], ["w"], ["w"], num_partitions=ranges, descending=down).collect()
        assert {r["o.x"]: r["next_w"] for r in got} == want and len(got) == 121
        ends = {}
        for r in sorted(got, key=lambda r: r["o.x"], reverse=down):
            ends[str(r["g"])] = ends.get(str(r["g"]), 0) + (r["w"] or 0)
            assert r["cum_w"] == ends[str(r["g"])]


def test_edges_beyond_the_broadcast_bound(spark, monkeypatch):
    from tabrig.operators import ordered
    monkeypatch.setattr(ordered, "EDGE_ROWS_BROADCAST", 0)
    df = spark.createDataFrame([(i % 3, i, 1) for i in range(60)], "g long, o long, w long")
    got = running_totals(df, ["o"], ["w"], ["g"], num_partitions=5).collect()
    assert sorted(r["cum_w"] for r in got) == sorted([*range(1, 21)] * 3)
    assert running_totals(df.limit(0), ["o"], ["w"], ["g"]).count() == 0


def test_confusion_grid_is_full_for_many_labels(spark):
    rows = [(f"l{i}", f"l{(i * 7) % 150}") for i in range(150)] + [(None, "l1")]
    got = E.confusion_matrix(spark.createDataFrame(rows, "label string, prediction string")).collect()
    assert len(got) == 151 * 151 and sum(r["n"] for r in got) == 151
    assert [r["n"] for r in got if r["actual"] is None and r["predicted"] == "l1"] == [1]


def test_leaderboard_ties_keep_candidate_order(spark):
    m = spark.createDataFrame([("b", 2, 0.5, 0.1), ("a", 1, 0.5, 0.1), ("c", 3, 0.7, 0.2)],
                              "model string, ord int, accuracy double, f1 double")
    lb = {r["model"]: r["rank"] for r in L.leaderboard(m, "classification", "highest_accuracy").collect()}
    assert lb == {"c": 1, "a": 2, "b": 3}
    assert L.primary_metric("regression", "fastest_model") == "training_seconds"
    assert not L.higher_is_better("mape")
