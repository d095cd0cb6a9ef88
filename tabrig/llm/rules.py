"""Quality rules: an isolation forest on rule statistics.

Every whole text gives rule statistics (words, symbols, repeated lines, repeated words
and so on). Documents that fail the base rules are dropped. The rest are scored by an
isolation forest: each tree splits a random subsample of ``leaf_sample`` rows, drawn by
a hash over the whole corpus, at random values of random statistics; a document that random splits
isolate early has a short mean path and so a high score. The threshold is calibrated on
all labelled rows: of the thresholds that lose at most ``lose`` of the good ones, the one
that separates good and bad rows best.

Trees are built in Spark tasks, one group of at most ``leaf_sample`` rows for each tree; the
forest (``trees`` x 2 x ``leaf_sample`` nodes at most) is sent to all tasks.

Defined results: a null text has no words, so it fails; without labelled rows of both kinds the
threshold is ``default_threshold``; rows of equal or null id are judged one by one (null
ids have no label, of several labels of an id the lowest counts); an empty table gives
no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import WORD, col, materialise, table

SYMBOLS = re.compile("[#*$%&|<>]")
WORDS = re.compile(WORD)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_chars", "symbols_per_word", "repeat_excess", "upper", "distinct",
            "marked_words", "line_words")


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base statistics, and the features of the forest. A line or phrase said twice is
    common in good text, so only the repeated share beyond a quarter is a feature."""
    words = WORDS.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    many = {w for w, c in Counter(windows).items() if c > 1}
    repeat = 0
    if many:
        to = 0  # words up to here are counted
        for i, w in enumerate(windows):
            if w in many:
                repeat += i + 3 - max(i, to)
                to = i + 3
    if not n:
        return [0, 0, symbols, dup_lines, 0], [0.0] * len(FEATURES)
    upper = sum(map(len, UPPER.findall(text)))
    features = [float(np.log1p(n)), chars / n, symbols / n, max(0.0, repeat / n - 0.25), upper / chars,
                len(set(words)) / n ** 0.9, len(MARKED.findall(text)) / n, float(np.log1p(n / len(lines)))]
    return [n, chars, symbols, dup_lines, repeat], features


UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")
MARKED = re.compile(r"(?:[^\w\s.,]|_){2,}")


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the base statistics, ``base_failed`` and the features of every row."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *[StructField(c, LongType(), False) for c in BASE],
                         *[StructField(c, DoubleType(), False) for c in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(1).to_pylist()]
            base = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
            more = np.array([r[1] for r in rows], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, base.T.copy()), *map(pa.array, more.T.copy())], schema.names)

    out = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _expected_path(n: np.ndarray | int):
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """Nodes (node, feature or -1, value or path left, left child; the right one follows)."""
    nodes: list = []
    todo = [(0, np.arange(len(rows)), 0)]
    size = 1
    while todo:
        node, at, d = todo.pop()
        part = rows[at]
        low, high = (part.min(0), part.max(0)) if len(at) else (np.zeros(0), np.zeros(0))
        usable = np.nonzero(high > low)[0]
        if d >= depth or len(at) < 2 or not len(usable):
            nodes.append((node, -1, d + float(_expected_path(len(at))), 0))
            continue
        f = int(rng.choice(usable))
        value = float(rng.uniform(low[f], high[f]))
        below = part[:, f] <= value
        nodes.append((node, f, value, size))
        todo += [(size, at[below], d + 1), (size + 1, at[~below], d + 1)]
        size += 2
    return nodes


class Forest:
    def __init__(self, nodes: pd.DataFrame, leaf_sample: int):
        self.trees = []
        for _, t in nodes.groupby("tree"):
            t = t.sort_values("node")
            self.trees.append(tuple(t[c].to_numpy() for c in ("feature", "value", "left")))
        self.norm = float(_expected_path(leaf_sample))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path), in (0, 1); high: anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > value[at]
                at = np.where(inner, left[at] + right, at)
            total += value[at]
        return 2.0 ** -(total / max(len(self.trees), 1) / self.norm)


def fit_forest(stats: DataFrame, trees: int = 100, leaf_sample: int = 256, seed: int = 4) -> Forest:
    """``stats`` must give the same rows each time it is read (a written table)."""
    usable = stats.where("NOT base_failed").select(*FEATURES, F.xxhash64(F.lit(seed), "id", *FEATURES).alias("h"))
    wanted, rows = trees * leaf_sample, usable.count()
    # hashes below a bound that lets somewhat more rows through than are wanted, so that few reach the one sorted list
    bound = int(-2 ** 63 + min(1.0, (1.2 * wanted + 1000) / max(rows, 1)) * 2 ** 64)
    few = usable.where(F.col("h") < F.lit(bound)) if bound < 2 ** 63 else usable
    if few.limit(min(wanted, rows)).count() < min(wanted, rows):
        few = usable
    sample = few.orderBy("h", *FEATURES).limit(wanted)  # drawn over all rows
    pool = min(wanted, rows)
    # in a corpus smaller than all trees' samples together, a row is in several trees
    copies = max(1, -(-trees * leaf_sample // max(pool, 1)))
    copies = min(copies, trees)
    sample = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    sample = sample.withColumn("tree", F.pmod(F.xxhash64("h", "copy", F.lit(seed)), F.lit(trees)).cast("int"))
    depth = int(np.ceil(np.log2(leaf_sample)))

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        rows = rows.sort_values(list(rows.columns))[list(FEATURES)].to_numpy(np.float64)
        if len(rows) > leaf_sample:
            rows = rows[rng.permutation(len(rows))[:leaf_sample]]
        out = pd.DataFrame(grow(rows, rng, depth), columns=["node", "feature", "value", "left"])
        out.insert(0, "tree", int(key[0]))
        return out

    sample = materialise(sample, "rule-sample").repartitionByRange(trees, "tree")  # a task for each tree
    nodes = sample.groupBy("tree").applyInPandas(one, "tree int, node long, feature long, value double, left long")
    return Forest(nodes.toPandas(), leaf_sample)


def calibrate(scored: DataFrame, labels: DataFrame, label_col: str, lose: float, default_threshold: float,
              id_col: str = "doc_id") -> float:
    """The threshold on scores: counts of all labelled rows by score (in steps of 0.0005)."""
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("good")).where(
        "id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(F.min("good").alias("good"))
    counts = scored.where("NOT base_failed").join(known, "id").groupBy(
        F.floor(F.col("score") * 2000).cast("int").alias("bin"), "good").agg(F.count(F.lit(1)).alias("rows")).toPandas()
    good = np.zeros(2001)
    bad = np.zeros(2001)
    for r in counts.itertuples():
        (good if r.good else bad)[r.bin] += r.rows
    if not good.sum() or not bad.sum():
        return default_threshold
    lost = good[::-1].cumsum()[::-1] / good.sum()  # with the threshold at this bin
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= lose, caught - lost, -1.0)
    return float(np.argmax(gain)) / 2000


def judge(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          trees: int = 100, leaf_sample: int = 256, lose: float = 0.02, default_threshold: float = 0.7,
          seed: int = 4) -> DataFrame:
    """The base statistics, ``base_failed``, ``score`` and ``kept`` of every row."""
    stats = materialise(rule_statistics(docs, id_col, text_col), "rule-statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit_forest(stats, trees, leaf_sample, seed))
    width = len(FEATURES)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.column_stack([p.to_numpy(np.float64) for p in part]).reshape(-1, width)
            yield pd.Series(shared.value.score(x))

    scored = stats.withColumn("score", score(*FEATURES))
    threshold = calibrate(scored, labels, label_col, lose, default_threshold, id_col)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("score") * 2000) < int(round(threshold * 2000))))


def op4(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), *BASE, "base_failed", "kept", "score")
