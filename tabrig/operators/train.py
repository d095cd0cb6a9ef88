"""Model portfolio training and scoring (M4-M17) with Spark ML.

The preprocessor is fitted once on the training rows and shared by every
candidate; the assembled train/test vectors are persisted while the portfolio
trains. Each fit is distributed; the (at most four) candidates are fitted side by side.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, quoted
from ..session import cut_lineage, shared_dir, with_row_id
from . import metrics as E
from .prep import Preprocessor, build_preprocessor
from .ordered import row_index
from .split import can_stratify, mark_split, mark_split_stratified

DEFAULT_PARAMS = {"num_trees": 100, "max_depth": 30, "gbt_iters": 100, "gbt_depth": 3, "seed": 42,
                  "max_iter": 1000, "tol": 1e-4,  # tol: the usual logistic-regression default
                  "tree_memory_mb": 1024}  # histograms of as many nodes as fit are made in one pass over the rows
PARALLEL_FITS = 4  # candidates fitted side by side, each in a scheduler pool of its own
TASK_ROWS, MOST_TASK_ROWS = 10_000, 200_000  # of the rows that the candidates are fitted on
IMPORTANCE_TOP = 10
LABEL_IDX = "_label_idx"


def label_index(train: DataFrame, target: str) -> DataFrame:
    """(label, idx): the distinct labels of the training rows with their position from 0
    in ascending order, as a table that is joined; any number of classes."""
    distinct = train.select(quoted(target).alias("_lab")).distinct()
    return row_index(distinct, ["_lab"], name="_pos").select("_lab", (F.col("_pos") - 1).cast("double").alias("_lab_idx"))


def build_estimator(name: str, task: str, n_train: int, n_classes: int, params: dict | None = None):
    """The Spark estimator for a candidate name."""
    p = {**DEFAULT_PARAMS, **(params or {})}
    fc, seed = "features", p["seed"]
    # Deep trees keep each row's node instead of walking every tree again; the few levels of a boosted tree are
    # walked sooner than a table of nodes is kept for each. Lineages are cut every ten rounds.
    flat = {"maxMemoryInMB": p["tree_memory_mb"], "checkpointInterval": 10}
    grown = {**flat, "cacheNodeIds": True}
    if name == "logistic_regression":  # sklearn C=1 with summed loss == lambda 1/n on Spark's mean loss
        return LogisticRegression(featuresCol=fc, labelCol=LABEL_IDX, maxIter=p["max_iter"], tol=p["tol"],
                                  regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False)
    if name == "decision_tree":
        return DecisionTreeClassifier(featuresCol=fc, labelCol=LABEL_IDX, **grown, maxDepth=p["max_depth"], seed=seed)
    if name == "random_forest":
        return RandomForestClassifier(featuresCol=fc, labelCol=LABEL_IDX, **grown, numTrees=p["num_trees"],
                                      maxDepth=p["max_depth"], seed=seed, featureSubsetStrategy="sqrt")
    if name == "gradient_boosting":
        gbt = GBTClassifier(featuresCol=fc, labelCol=LABEL_IDX, **flat, maxIter=p["gbt_iters"], stepSize=0.1,
                            maxDepth=p["gbt_depth"], seed=seed)
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt, featuresCol=fc, labelCol=LABEL_IDX, parallelism=4)
    if name == "linear_regression":
        return LinearRegression(featuresCol=fc, labelCol=LABEL_IDX, solver="normal", regParam=0.0)
    if name == "decision_tree_regressor":
        return DecisionTreeRegressor(featuresCol=fc, labelCol=LABEL_IDX, **grown, maxDepth=p["max_depth"], seed=seed)
    if name == "random_forest_regressor":
        return RandomForestRegressor(featuresCol=fc, labelCol=LABEL_IDX, **grown, numTrees=p["num_trees"],
                                     maxDepth=p["max_depth"], seed=seed, featureSubsetStrategy="all")
    if name == "gradient_boosting_regressor":
        return GBTRegressor(featuresCol=fc, labelCol=LABEL_IDX, **flat, maxIter=p["gbt_iters"], stepSize=0.1,
                            maxDepth=p["gbt_depth"], seed=seed)
    raise ValueError(f"Unsupported model selected: {name}")


def _raw_importances(model, mean_abs: bool = True) -> list[float] | None:
    inner = model
    if hasattr(inner, "models"):  # one-vs-rest: the mean over the inner models
        each = [_raw_importances(m, mean_abs) for m in inner.models]
        return [sum(v) / len(each) for v in zip(*each, strict=True)] if each and None not in each else None
    if hasattr(inner, "featureImportances"):
        return [float(x) for x in inner.featureImportances.toArray()]
    if hasattr(inner, "coefficientMatrix"):
        m = inner.coefficientMatrix.toArray()
        if mean_abs:
            return [float(x) for x in abs(m).mean(axis=0)]
        return [float(abs(x)) for x in m.mean(axis=0)]
    if hasattr(inner, "coefficients"):
        return [float(abs(x)) for x in inner.coefficients.toArray()]
    return None


def feature_importance(model, top: int = IMPORTANCE_TOP) -> list[tuple]:
    """M16 (A): (feature number, importance, share of the total (0 -> 1)), top 10."""
    raw = _raw_importances(model, mean_abs=True)
    if not raw:
        return []
    total = float(sum(raw)) or 1.0
    rows = [(i, v, v / total) for i, v in enumerate(raw)]
    return sorted(rows, key=lambda r: r[1], reverse=True)[:top]


def feature_importance_b(model) -> list[tuple]:
    """M17 (B): (feature number, abs of the mean coefficient or tree importance), all features."""
    return list(enumerate(_raw_importances(model, mean_abs=False) or []))


@dataclass
class TrainResult:
    task: str
    models: list[str]
    metrics: DataFrame            # model, ord, metric columns..., training_seconds (A) / error (B)
    predictions: DataFrame        # model, row_key, label, prediction, score
    importances: DataFrame        # model, feature, importance, contribution
    preprocessor: Preprocessor
    fitted: dict = field(default_factory=dict)
    labels: DataFrame | None = None  # label, idx
    train_rows: int = 0
    test_rows: int = 0
    errors: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)
    persisted: list = field(default_factory=list)

    def report(self) -> DataFrame:
        """E8 for every classification model."""
        return E.classification_report(self.predictions, ["model"])

    def unpersist(self):
        for d in self.persisted:
            d.unpersist()


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks of one pass over ``rows`` rows. A portfolio makes some thousand passes and every task of a
    pass sends the histograms of all nodes, so there are no more tasks than cores, nor tasks of a few
    rows, unless a task would hold too many."""
    return max(1, min(cores, -(-rows // TASK_ROWS)), -(-rows // MOST_TASK_ROWS))


def _dealt(side: DataFrame, rows: int) -> DataFrame:
    """The cached ``side`` in as many partitions as its rows need, cached again if that changes them."""
    tasks, held = fit_tasks(rows, side.sparkSession.sparkContext.defaultParallelism), side.rdd.getNumPartitions()
    if tasks == held:
        return side
    out = (side.coalesce(tasks) if tasks < held else side.repartition(tasks)).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    side.unpersist()
    return out


def _with_key(df: DataFrame, row_key: str | None) -> tuple[DataFrame, str]:
    return (df, row_key) if row_key else (with_row_id(df), "_row_id")


def _fit_all(models: list[str], estimator, train: DataFrame) -> dict:
    """{name: (model, seconds, error)}: the candidates are fitted side by side, so that one's small
    jobs use the cores that another's leave idle; ``seconds`` is the wall time of each fit."""
    sc = train.sparkSession.sparkContext
    shared_dir(train.sparkSession)  # a checkpoint folder for the ensembles' node numbers

    def fit(name):
        sc.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
        try:
            est = estimator(name)
            t0 = time.perf_counter()
            return name, (est.fit(train), time.perf_counter() - t0, None)
        except Exception as e:  # noqa: BLE001
            return name, (None, None, e)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return dict(pool.map(inheritable_thread_target(train.sparkSession)(fit), models))


def train_portfolio(df: DataFrame, target: str, models: list[str], task: str, row_key: str | None = None,
                    test_size: float = 0.2, seed: int = 42, params: dict | None = None,
                    mode: str = "A", features: list[str] | None = None,
                    prepared: Preprocessor | None = None) -> TrainResult:
    """M12 (A, fail fast, stratified when possible, preprocessor fitted on the
    train rows) and M13 (B, per-model errors recorded, plain split).
    With ``prepared`` the rows already hold the feature vector of that preprocessor
    (F7): they are split and used as they are, and nothing is fitted again.
    Returns the metric, prediction and importance tables."""
    spark = df.sparkSession
    df, key = _with_key(df, row_key)
    ydt = df.schema[target].dataType
    df = df.where(~is_missing(quoted(target), ydt))
    if mode == "B" and df.limit(2).count() < 2:
        raise ValueError("Not enough samples to split for training and testing")
    if mode == "A" and task == "classification" and can_stratify(df, target, task):
        marked = mark_split_stratified(df, target, key, test_size, seed)
    else:
        marked = mark_split(df, key, test_size, seed)
    # The split feeds the label list, every preprocessor statistic and both
    # assembled sides: materialise it once instead of re-running it per job.
    marked = marked.persist(StorageLevel.MEMORY_AND_DISK)
    train_raw = marked.where(~F.col("is_test")).drop("is_test")
    test_raw = marked.where(F.col("is_test")).drop("is_test")
    feats = features if features is not None else [c for c in df.columns if c not in (target, key)]
    prep = prepared or build_preprocessor(train_raw, features=feats, target=target, row_key=key)
    labels = None
    if task == "classification":
        labels = cut_lineage(label_index(train_raw, target))

    def assemble(d):
        out = d if prepared else prep.transform(d)
        out = out.select(key, quoted(target).alias("_label"), F.col(prep.output_col).alias("features"))
        if labels is None:
            return out.withColumn(LABEL_IDX, F.col("_label").cast("double"))
        # labels that the training rows don't have get no index
        return out.join(labels, F.col("_label") == F.col("_lab"), "left").drop("_lab").withColumnRenamed("_lab_idx", LABEL_IDX)
    train = assemble(train_raw).persist(StorageLevel.MEMORY_AND_DISK)
    test = assemble(test_raw).persist(StorageLevel.MEMORY_AND_DISK)
    n_train, n_test = train.count(), test.count()
    # Both assembled sides are materialised: the split copy is no longer read,
    # so the cache holds one copy of the data while the portfolio trains.
    marked.unpersist()
    train, test = _dealt(train, n_train), _dealt(test, n_test)
    n_classes = labels.count() if labels is not None else 0
    if task == "classification":
        train = train.where(F.col(LABEL_IDX) >= 0)

    fitted, timings, errors, preds, imps = {}, {}, {}, [], []
    tried = _fit_all(models, lambda name: build_estimator(name, task, n_train, n_classes, params), train)
    for ord_, name in enumerate(models, start=1):
        model, seconds, error = tried[name]
        if error is not None:
            if mode == "A":
                raise error
            errors[name] = str(error)
            continue
        timings[name] = seconds
        fitted[name] = model
        out = model.transform(test)
        if task == "classification":
            out = out.join(labels, F.col("prediction") == F.col("_lab_idx"), "left")
            pred = F.col("_lab")
            score = (vector_to_array(F.col("probability"))[1] if (n_classes == 2 and "probability" in out.columns)
                     else F.lit(None).cast("double"))
        else:
            pred, score = F.col("prediction"), F.lit(None).cast("double")
        preds.append(out.select(F.lit(name).alias("model"), F.lit(ord_).alias("ord"), quoted(key).alias("row_key"),
                                F.col("_label").alias("label"), pred.alias("prediction"),
                                score.cast("double").alias("score")))
        rows = feature_importance(model) if mode == "A" else [(i, v, None) for i, v in feature_importance_b(model)]
        imps += [(name, i, float(v), None if c is None else float(c)) for i, v, c in rows]

    ords = spark.createDataFrame([(m, i + 1, timings.get(m), errors.get(m)) for i, m in enumerate(models)],
                                 "model string, ord int, training_seconds double, error string")
    if preds:
        allp = preds[0]
        for p in preds[1:]:
            allp = allp.unionByName(p)
        # Metrics, charts and reports read the predictions several times; keep
        # one copy instead of re-running model inference for each read.
        allp = allp.persist(StorageLevel.MEMORY_AND_DISK)
        if task == "classification":
            m = E.classification_metrics(allp, ["model"]) if mode == "A" else E.classification_metrics_b(allp, ["model"])
        else:
            m = E.regression_metrics(allp, ["model"]) if mode == "A" else E.regression_metrics_b(allp, ["model"])
        metrics = ords.join(m, "model", "left")
    else:
        allp = spark.createDataFrame([], f"model string, ord int, row_key long, label {ydt.simpleString()}, "
                                         "prediction double, score double")
        metrics = ords
    if mode == "A":
        metrics = metrics.drop("error")
    # The models' numbers are joined with the table of feature names.
    numbered = spark.createDataFrame(imps, "model string, idx long, importance double, contribution double")
    imp_df = numbered.join(prep.encoder.feature_table(), "idx").select("model", "feature", "importance", "contribution")
    return TrainResult(task, models, metrics, allp, imp_df, prep, fitted, labels, n_train, n_test, errors,
                       timings, [train, test, allp])


def full_pipeline(prep: Preprocessor, model) -> PipelineModel:
    """S3 helper: preprocessing stages + fitted model as one saveable PipelineModel."""
    return PipelineModel(stages=list(prep.model.stages) + [model])


def fit_linear_regression(df: DataFrame, feature: str, label: str) -> DataFrame:
    """M8 on raw data: ordinary least squares of one feature (no scaling), as
    (slope, intercept); equals SQL ``regr_slope`` / ``regr_intercept``."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=[feature], outputCol="features", handleInvalid="skip")
    d = va.transform(df.select(quoted(feature).cast("double").alias(feature),
                               quoted(label).cast("double").alias(LABEL_IDX)))
    m = LinearRegression(featuresCol="features", labelCol=LABEL_IDX, solver="normal", regParam=0.0).fit(d)
    return df.sparkSession.createDataFrame([(float(m.coefficients[0]), float(m.intercept))],
                                           "slope double, intercept double")
