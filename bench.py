"""

Each workload's result is forced with a ``noop`` write (or the job's own
actions); the median of $BENCH_REPEAT runs is reported after a warm-up pass
of every workload of the baseline on the smallest data set ($BENCH_WARMUP=none: no warm-up).
portfolios) come after them. A workload is stopped after $BENCH_LIMIT seconds and one not begun after
$BENCH_SECONDS is left out; both are named in the result, so that no workload can void it.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tabrig.operators import charts as V  # noqa: E402
from tabrig.operators import clean as C  # noqa: E402
from tabrig.operators import metrics as E  # noqa: E402
from tabrig.operators import profile as Q  # noqa: E402
from tabrig.operators import review as R  # noqa: E402
from tabrig.operators import split as M  # noqa: E402
from tabrig.operators.train import fit_linear_regression, train_portfolio  # noqa: E402
from tabrig.plans.experiment import run_experiment_a, run_experiment_b  # noqa: E402
from tabrig.session import local_session  # noqa: E402
from tabrig.sources import tables as S  # noqa: E402


def force(df):
    df.write.format("noop").mode("overwrite").save()


def workloads(spark, sf):
    def q18():
        force(Q.quality_report(S.load(spark, sf, "lineitem"), "l_returnflag"))

    def cleaned(df, target):
        res = C.clean(df, target, "rid")
        force(res.cleaned)
        force(res.log)

    def lineitem():
        return S.load(spark, sf, "lineitem").withColumn("rid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))

    def v5():
        force(V.correlation_matrix(S.load(spark, sf, "lineitem")))

    def e6():
        force(E.roc_auc(S.pred_quality(spark, sf)))
        force(E.classification_metrics(S.pred_models(spark, sf), ["model"]))

    def m8():
        force(fit_linear_regression(S.load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))

    def q10():
        force(Q.describe_numeric(S.load(spark, sf, "lineitem")))

    def j1(df, goal):
        out = run_experiment_a(df, "l_linestatus", goal, 0.2, "line status", "lineitem")
        force(out["metrics"])
        force(out["report"])
        out["train"].unpersist()
        return {f"fit_{m}": round(t, 3) for m, t in out["train"].timings.items()}

    def labelled():
        docs = S.load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
        return docs.join(S.load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")

    def j2():
        out = run_experiment_b(labelled(), "quality", "bench", row_key="doc_id")
        force(out["metrics"])
        force(out["report"])
        out["train"].unpersist()
        return {f"fit_{m}": round(t, 3) for m, t in out["train"].timings.items()}

    def m7():
        docs = S.load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
        tr = train_portfolio(docs, "lang", ["gradient_boosting"], "classification", "doc_id")
        force(tr.metrics)
        tr.unpersist()

    few = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return {"q18_quality_report": q18, "c4_clean_duplicates": lambda: cleaned(S.dirty_orders(spark, sf), "status"),
            "v5_correlation_matrix": v5, "e6_exact_auc": e6,
            "m2_stratified_split": lambda: force(M.mark_split_stratified(
                S.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")),
            "r10_review_rules": lambda: force(R.review_b(S.load(spark, sf, "orders"), "o_orderstatus")),
            "m8_linear_regression": m8, "q10_describe_numeric": q10,
            "j1_experiment_explainable": lambda: j1(S.load(spark, sf, "lineitem").select(*few), "most_explainable"),
            # beyond the baseline
            "c4_clean_lineitem": lambda: cleaned(lineitem(), "l_returnflag"),
            "m2_stratified_lineitem": lambda: force(M.mark_split_stratified(lineitem().select("rid", "l_returnflag"), "l_returnflag", "rid")),
            "r10_review_lineitem": lambda: force(R.review_b(S.load(spark, sf, "lineitem"), "l_returnflag")),
            "j2_experiment": j2, "m7_multiclass_boosting": m7,
            "j1_experiment": lambda: j1(S.load(spark, sf, "lineitem"), "highest_accuracy")}


BASELINE = ["q18_quality_report", "c4_clean_duplicates", "v5_correlation_matrix", "e6_exact_auc", "m2_stratified_split",
            "r10_review_rules", "m8_linear_regression", "q10_describe_numeric", "j1_experiment_explainable"]


def timed(spark, fn, limit: float):
    """(seconds, what the workload returned), or (None, None) if it was stopped after ``limit`` seconds."""
    timer = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
    timer.start()
    t0 = time.perf_counter()
    try:
        got = fn()
    except Exception:
        if time.perf_counter() - t0 < limit:
            raise
        return None, None
    finally:
        timer.cancel()
    return time.perf_counter() - t0, got


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="tabrig-bench")
    wl = workloads(spark, sf)
    # Warm-up: JVM, parquet footers, code generation.
    force(S.load(spark, sf, "orders").agg(F.count(F.lit(1))))
    # BENCH_WARMUP=small (default) runs every selected workload once on the
    # smallest data set first, so the timed runs measure steady-state work at
    # $BENCH_SF_DIR rather than JIT / code generation; BENCH_WARMUP=none skips it.
    warm_dir = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.environ.get("BENCH_WARMUP", "small") == "small" and os.path.isdir(warm_dir) \
            and os.path.abspath(warm_dir) != os.path.abspath(sf):
        for name, fn in workloads(spark, warm_dir).items():
            if name in BASELINE and (not only or name in only):
                fn()
    limit, total = float(os.environ.get("BENCH_LIMIT", "600")), float(os.environ.get("BENCH_SECONDS", "1200"))
    times, fits, stopped = {}, {}, []
    begun = time.perf_counter()
    for name, fn in wl.items():
        if only and name not in only:
            continue
        if time.perf_counter() - begun > total:
            stopped.append(name)
            continue
        runs = []
        for _ in range(repeat if name in BASELINE else 1):
            seconds, got = timed(spark, fn, limit)
            if seconds is None:
                stopped.append(name)
                break
            runs.append(seconds)
            fits |= {f"{name}.{k}": v for k, v in (got or {}).items()}
        else:
            times[name] = round(statistics.median(runs), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "baseline_workload_seconds", "value": round(sum(t for n, t in times.items() if n in BASELINE), 3), "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": cpus, "repeat": repeat, "all_workloads": round(sum(times.values()), 3),
                      "fits": fits, "stopped": stopped, "warmup": os.environ.get("BENCH_WARMUP", "small")}))
    spark.stop()


if __name__ == "__main__":
    main()
