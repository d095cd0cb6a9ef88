"""Evaluation metrics over a prediction table.

Input columns: ``label``, ``prediction`` and optionally ``score``, plus any
grouping columns (``by``, usually ``model``). Classification metrics all derive
from the observed confusion cells, a table bounded by models x classes^2.
AUC and ROC use distinct scores with distributed running totals, never a
single-partition sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_totals, segmented

GRID_PARTS = 64  # the labels of one side of a confusion grid are spread over so many keys
POSITIVE_PAIRS = [(0.0, 1.0), (-1.0, 1.0)]  # numeric (min, max) label pairs a ROC curve accepts

CLASSIFICATION_METRICS = ["accuracy", "precision", "recall", "f1", "f1_weighted",
                          "matthews_corrcoef", "roc_auc"]
REGRESSION_METRICS = ["mae", "mse", "rmse", "r2", "mape"]


def _grouped(pred: DataFrame, by: list[str] | None):
    """Ungrouped input gets a constant group column so every join is an equi-join."""
    by = list(by or [])
    if by:
        return pred, by, None
    return pred.withColumn("_grp", F.lit(0)), ["_grp"], "_grp"


def _finish(df: DataFrame, tmp: str | None) -> DataFrame:
    return df.drop(tmp) if tmp else df


def _as_text(pred: DataFrame, col: str):
    """Labels compared as text; the prediction takes the label's type first."""
    c = F.col(col)
    if col == "prediction":
        c = c.cast(pred.schema["label"].dataType)
    return c.cast("string")


def confusion_cells(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Observed (actual, predicted) counts."""
    by = list(by or [])
    return pred.groupBy(*by, _as_text(pred, "label").alias("actual"),
                        _as_text(pred, "prediction").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, by: list[str] | None = None,
                     labels_from: str = "both") -> DataFrame:
    """Counts for every (actual, predicted) label pair, zeros filled.
    Labels are the union of actual and predicted values (A) or actual only (B);
    a missing label is a label. The full grid is the definition: its size is
    the square of the number of labels of a group."""
    pred, by, tmp = _grouped(pred, by)
    cells = confusion_cells(pred, by)
    lab = cells.select(*by, F.col("actual").alias("lab"))
    if labels_from == "both":
        lab = lab.unionByName(cells.select(*by, F.col("predicted").alias("lab")))
    lab = lab.distinct()
    # One side is spread over GRID_PARTS keys and the other copied to each, so
    # that the grid of one group is made by many tasks.
    a = lab.select(*by, F.col("lab").alias("actual"), F.pmod(F.xxhash64("lab"), F.lit(GRID_PARTS)).alias("_part"))
    p = lab.select(*[F.col(b).alias(f"_p_{b}") for b in by], F.col("lab").alias("predicted"),
                   F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID_PARTS - 1).cast("long"))).alias("_pp"))
    grid = a.join(p, _same(by, "_p_") & (F.col("_part") == F.col("_pp")))
    known = cells.select(*[F.col(b).alias(f"_c_{b}") for b in by], F.col("actual").alias("_ca"),
                         F.col("predicted").alias("_cp"), "n")
    match = _same(by, "_c_") & F.col("actual").eqNullSafe(F.col("_ca")) & F.col("predicted").eqNullSafe(F.col("_cp"))
    out = grid.select(*by, "actual", "predicted").join(known, match, "left") \
        .select(*by, "actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    return _finish(out, tmp)


def _same(by: list[str], prefix: str):
    """Null-safe equality of group columns with their prefixed copies."""
    out = F.lit(True)
    for b in by:
        out = out & F.col(b).eqNullSafe(F.col(prefix + b))
    return out


def per_label(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per label (union of actual and predicted): tp, support (true), predicted."""
    by = list(by or [])
    cells = confusion_cells(pred, by)
    # One grouping over both sides of every cell: a missing label is a label.
    right = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    sides = cells.select(*by, F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), right.alias("tp"), F.lit(0).cast("long").alias("pred_n")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"),
                 F.col("n").alias("pred_n")))))
    j = sides.groupBy(*by, "label").agg(*[F.sum(c).cast("long").alias(c) for c in ["tp", "support", "pred_n"]])
    tp, sup, pn = F.col("tp"), F.col("support"), F.col("pred_n")
    return j.select(
        *by, "label", "tp", "support", "pred_n",
        F.coalesce(F.try_divide(tp.cast("double"), pn.cast("double")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp.cast("double"), sup.cast("double")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide((2 * tp).cast("double"), (sup + pn).cast("double")), F.lit(0.0)).alias("f1"))


def roc_auc(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact AUC with average ranks on ties; 0.0 when there is no score,
    fewer or more than two classes. Positive class = the greater label."""
    pred, by, tmp = _grouped(pred, by)
    lab = pred.groupBy(*by).agg(F.max("label").alias("_hi"), F.count_distinct("label").alias("_k"),
                                F.count("score").alias("_scored"))
    # Counts per (group, score, label) first (partial aggregation), so the
    # join with the per-group label facts reads aggregated rows, not raw
    # predictions.
    sl = pred.where(F.col("score").isNotNull()).groupBy(*by, "score", "label").agg(
        F.count(F.lit(1)).alias("_c"))
    scored = sl.join(lab.where("_k = 2"), on=by, how="inner")
    is_pos = F.col("label") == F.col("_hi")
    g = scored.groupBy(*by, "score").agg(
        F.sum(F.when(is_pos, F.col("_c")).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(is_pos, 0).otherwise(F.col("_c"))).cast("long").alias("neg"))
    cum = running_totals(g, ["score"], ["neg"], by)
    contrib = F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + 0.5 * F.col("neg"))
    s = cum.groupBy(*by).agg(F.sum(contrib).alias("_area"), F.sum("pos").alias("_p"),
                             F.sum("neg").alias("_n"))
    auc = s.select(*by, F.try_divide(F.col("_area"), (F.col("_p") * F.col("_n")).cast("double"))
                   .alias("_auc"))
    out = lab.join(auc, on=by, how="left")
    ok = (F.col("_k") == 2) & (F.col("_scored") > 0)
    out = out.select(*by, F.when(ok, F.coalesce(F.col("_auc"), F.lit(0.0))).otherwise(0.0).alias("roc_auc"))
    return _finish(out, tmp)


def classification_metrics(pred: DataFrame, by: list[str] | None = None,
                           with_auc: bool = True) -> DataFrame:
    """M18 / E1-E6 (pipeline A): accuracy, weighted precision/recall/f1,
    f1_weighted, multiclass MCC and AUC per group."""
    pred, by, tmp = _grouped(pred, by)
    pl = per_label(pred, by)
    s = pl.groupBy(*by).agg(
        F.sum("support").alias("_s"), F.sum("tp").alias("_c"),
        F.sum(F.col("support") * F.col("precision")).alias("_wp"),
        F.sum(F.col("support") * F.col("recall")).alias("_wr"),
        F.sum(F.col("support") * F.col("f1")).alias("_wf"),
        F.sum(F.col("pred_n").cast("double") * F.col("support")).alias("_pt"),
        F.sum(F.col("pred_n").cast("double") * F.col("pred_n")).alias("_pp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("_tt"))
    sd = F.col("_s").cast("double")
    cov_tp = F.col("_c").cast("double") * sd - F.col("_pt")
    cov_pp = sd * sd - F.col("_pp")
    cov_tt = sd * sd - F.col("_tt")
    mcc = F.when(cov_pp * cov_tt == 0, F.lit(0.0)).otherwise(cov_tp / F.sqrt(cov_tt * cov_pp))
    f1 = F.coalesce(F.try_divide(F.col("_wf"), sd), F.lit(0.0))
    out = s.select(*by,
                   F.coalesce(F.try_divide(F.col("_c").cast("double"), sd), F.lit(0.0)).alias("accuracy"),
                   F.coalesce(F.try_divide(F.col("_wp"), sd), F.lit(0.0)).alias("precision"),
                   F.coalesce(F.try_divide(F.col("_wr"), sd), F.lit(0.0)).alias("recall"),
                   f1.alias("f1"), f1.alias("f1_weighted"), mcc.alias("matthews_corrcoef"))
    if with_auc and "score" in pred.columns:
        out = out.join(roc_auc(pred, by), on=by, how="left")
    elif with_auc:
        out = out.withColumn("roc_auc", F.lit(0.0))
    return _finish(out, tmp)


def classification_metrics_b(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M18 (pipeline B): accuracy, weighted f1, and AUC only when binary and
    scored (absent otherwise, as a null)."""
    pred, by, tmp = _grouped(pred, by)
    m = classification_metrics(pred, by, with_auc=False).select(*by, "accuracy", "f1")
    if "score" not in pred.columns:
        return _finish(m.withColumn("roc_auc", F.lit(None).cast("double")), tmp)
    lab = pred.groupBy(*by).agg(F.count_distinct("label").alias("_k"), F.count("score").alias("_sc"))
    j = m.join(lab, on=by).join(roc_auc(pred, by), on=by)
    out = j.select(*by, "accuracy", "f1",
                   F.when((F.col("_k") == 2) & (F.col("_sc") > 0), F.col("roc_auc")).alias("roc_auc"))
    return _finish(out, tmp)


def classification_report(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per-label precision/recall/f1/support, then accuracy, macro avg and
    weighted avg rows (the accuracy row carries only ``score``)."""
    by = list(by or [])
    pl = per_label(pred, by)
    rows = pl.select(*by, "label", "precision", "recall", F.col("f1").alias("f1_score"),
                     F.col("support").cast("double").alias("support"),
                     F.lit(None).cast("double").alias("score"))
    agg = pl.groupBy(*by).agg(
        F.sum("support").cast("double").alias("_s"), F.count(F.lit(1)).alias("_k"),
        F.sum("tp").alias("_c"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        F.sum(F.col("support") * F.col("precision")).alias("_wp"),
        F.sum(F.col("support") * F.col("recall")).alias("_wr"),
        F.sum(F.col("support") * F.col("f1")).alias("_wf"))
    acc = agg.select(*by, F.lit("accuracy").alias("label"), *[F.lit(None).cast("double").alias(c)
                     for c in ["precision", "recall", "f1_score", "support"]],
                     (F.col("_c") / F.col("_s")).alias("score"))
    macro = agg.select(*by, F.lit("macro avg").alias("label"), F.col("_mp").alias("precision"),
                       F.col("_mr").alias("recall"), F.col("_mf").alias("f1_score"),
                       F.col("_s").alias("support"), F.lit(None).cast("double").alias("score"))
    weighted = agg.select(*by, F.lit("weighted avg").alias("label"),
                          (F.col("_wp") / F.col("_s")).alias("precision"),
                          (F.col("_wr") / F.col("_s")).alias("recall"),
                          (F.col("_wf") / F.col("_s")).alias("f1_score"),
                          F.col("_s").alias("support"), F.lit(None).cast("double").alias("score"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def roc_points(pred: DataFrame, by: list[str] | None = None,
               drop_intermediate: bool = True) -> DataFrame:
    """(idx, threshold, fpr, tpr) per distinct score, descending, starting
    at (0, 0) with an infinite threshold. Only numeric labels {0, 1} or
    {-1, 1} get a curve (others raise in the usual ROC routine, which the
    reference swallows). With ``drop_intermediate`` a point is dropped when its
    neighbours make equal steps on both axes."""
    pred, by, tmp = _grouped(pred, by)
    if pred.schema["label"].dataType.typeName() in ("string", "boolean", "binary"):
        return _finish(pred.sparkSession.createDataFrame(
            [], ", ".join([f"{b} {pred.schema[b].dataType.simpleString()}" for b in by] +
                          ["idx long", "threshold double", "fpr double", "tpr double"])), tmp)
    y = F.col("label").cast("double")
    lab = pred.groupBy(*by).agg(F.count_distinct(y).alias("_k"), F.min(y).alias("_lo"),
                                F.max(y).alias("_hi"))
    ok = None
    for lo, hi in POSITIVE_PAIRS:
        cond = (F.col("_lo") == lo) & (F.col("_hi") == hi)
        ok = cond if ok is None else ok | cond
    lab = lab.where((F.col("_k") == 2) & ok).select(*by)
    pos = y == 1.0
    # Aggregate to (group, score) first; the semi join keeps whole groups, so
    # it can read the aggregated rows instead of the raw predictions.
    g = pred.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(
        F.sum(F.when(pos, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(pos, 0).otherwise(1)).cast("long").alias("fp"),
        F.lit(1).cast("long").alias("one"))
    g = g.join(lab, on=by, how="left_semi")
    # A point's steps are its own counts and the next point's, so neighbours need no join.
    cum = segmented(g, ["score"], by, ["tp", "fp", "one"], ["tp", "fp"], descending=True)
    cum = cum.select(*by, F.col("score").alias("threshold"), F.col("cum_tp").alias("tps"), F.col("cum_fp").alias("fps"),
                     F.col("cum_one").alias("idx"), "tp", "fp", "next_tp", "next_fp")
    tot = cum.groupBy(*by).agg(F.max("tps").alias("_P"), F.max("fps").alias("_N"))
    pts = cum
    if drop_intermediate:
        corner = (F.col("next_fp") != F.col("fp")) | (F.col("next_tp") != F.col("tp"))
        pts = cum.where((F.col("idx") == 1) | F.col("next_tp").isNull() | corner)
    pts = pts.select(*by, "threshold", "tps", "fps", "idx")
    origin = tot.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tps"),
                        F.lit(0).cast("long").alias("fps"), F.lit(0).cast("long").alias("idx"))
    allp = origin.unionByName(pts).join(tot.select(*by, "_P", "_N"), on=by, how="inner")
    out = allp.select(*by, "idx", "threshold",
                      F.try_divide(F.col("fps").cast("double"), F.col("_N").cast("double")).alias("fpr"),
                      F.try_divide(F.col("tps").cast("double"), F.col("_P").cast("double")).alias("tpr"))
    return _finish(out, tmp)


def regression_metrics(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mae, mse, rmse, r2 (1 - SSE/SST; constant target gives
    1.0 if perfect else 0.0), mape over non-zero targets (0.0 if none)."""
    by = list(by or [])
    t, p = F.col("label").cast("double"), F.col("prediction").cast("double")
    e = t - p
    a = pred.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("_sse"),
        (F.var_pop(t) * F.count(t)).alias("_sst"),
        F.avg(F.when(t != 0, F.abs(e / t))).alias("_mape"))
    r2 = F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)) \
        .otherwise(1 - F.col("_sse") / F.col("_sst"))
    return a.select(*by, "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"),
                    F.coalesce(F.col("_mape"), F.lit(0.0)).alias("mape"))


def regression_metrics_b(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M19 (pipeline B): mse and r2."""
    return regression_metrics(pred, by).select(*(by or []), "mse", "r2")


def metrics_long(wide: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by..., metric, value) from a wide metric table."""
    present = [m for m in metrics if m in wide.columns]
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in present])
    return wide.select(*by, F.inline(arr))
