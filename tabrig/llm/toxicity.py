"""Toxicity: a chain of linear classifiers over text features.

The categories are predicted one after the other. Each is a logistic regression on
features of the words (whole words, and their first 4, 5 and 6 letters) and on the
probabilities of the categories before it. For training, those probabilities are
out-of-fold: they come from models that have not seen the row. The decision threshold of
the last category is the one of the best F1 on its own out-of-fold probabilities.

Training uses at most ``sample`` labelled rows, those of the lowest hash of their id
(documented bound); features are counted over them in Spark and at most ``per_category``
are kept for each category. Each fit is one task on those rows. All documents are scored
on whole texts where they lie; only the weights are sent to the tasks.

Defined results: a null text counts as empty; null ids and rows of equal id are scored
one by one; null labels take no part, of several labels of an id the highest counts;
without labels of both kinds a category has probability 0, and nothing is rejected; nor is
anything where no feature tells the labelled rows apart.
Further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, packed, table, unpacked

EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"
PREFIXES = (4, 5, 6)


def word_features(word: str) -> list[str]:
    w = word.strip(EDGE)
    if not w:
        return ["=" + word[:3]]
    return ["=" + w, *(w[:k] for k in PREFIXES if len(w) > k)]


class Vectors:
    """Sparse rows over the chosen features: log(1 + number of different words that have
    the feature). Hits are cached by word."""

    def __init__(self, features: list[str], most: int = 100_000):
        self.index = {f: i for i, f in enumerate(features)}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.most = most

    def counts(self, text: str) -> dict[int, int]:
        if len(self.cache) > self.most:  # words that are not met again meanwhile go next time
            self.cache, self.older = {}, self.cache
        cache, older, index, found = self.cache, self.older, self.index, {}
        for w in set(text.lower().split()):
            hits = cache.get(w)
            if hits is None:
                hits = older.get(w)
                if hits is None:
                    hits = tuple(index[f] for f in word_features(w) if f in index)
                cache[w] = hits
            for i in hits:
                found[i] = found.get(i, 0) + 1
        return found


@dataclass
class Chain:
    categories: list[str]
    features: list[str]
    weights: list[np.ndarray]  # by category: features, earlier probabilities, intercept
    threshold: float

    def probabilities(self, counts: dict[int, int]) -> list[float]:
        at = np.fromiter(counts, np.int64, len(counts))
        x = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        out: list[float] = []
        n = len(self.features)
        for w in self.weights:
            z = float(w[at] @ x) + sum(a * p for a, p in zip(w[n:], out, strict=False)) + w[-1]
            out.append(1 / (1 + float(np.exp(-min(max(z, -700.0), 700.0)))))
        return out


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], earlier: np.ndarray, y: np.ndarray, width: int,
                 ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights (features, earlier probabilities, intercept) by accelerated gradient steps;
    both classes weigh the same. Features are scaled to equal mean squares, so that rare
    ones are learnt as fast as common ones. A class without rows gives probability 0 or 1."""
    k, n = earlier.shape[1], len(y)
    w = np.zeros(width + k + 1)
    if not n or y.min() == y.max():
        w[-1] = 30.0 if n and y[0] else -30.0
        return w
    lengths = np.array([len(a) for a, _ in rows])
    at = np.concatenate([a for a, _ in rows]).astype(np.int64)
    val = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(n), lengths)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    squares = np.bincount(at, share[row] * val * val, width)
    scale = np.where(squares > 0, 1 / np.sqrt(np.maximum(squares, 1e-12)), 0.0)
    val = val * scale[at]

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, val * v[at], n) + earlier @ v[width:-1] + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(at, val * r[row], width), earlier.T @ r, [r.sum()]])

    v = np.ones_like(w)
    for _ in range(15):  # the largest curvature
        v = back(share * times(v) / 4)
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (1.1 * size + ridge)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(z), -50, 50)))
        g = back(share * (p - y))
        g[:-1] += ridge * z[:-1]
        new = z - step * g
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t1 * (new - w), new, t1
    w[:width] *= scale
    return w


def _select(sample: DataFrame, k: int, per_category: int, least: int, least_chi: float) -> list[str]:
    """The features of the highest chi-square for each category, counted by document."""
    @F.pandas_udf("array<string>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([list({f for w in set(t.lower().split()) for f in word_features(w)}) for t in part])

    one = sample.select("y", F.explode(features(F.coalesce("text", F.lit("")))).alias("f"))
    counts = one.groupBy("f").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("y", F.lit(c))).alias(f"p{c}") for c in range(k)])
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("y", F.lit(c))).alias(f"p{c}") for c in range(k)]).collect()[0]
    chosen: set[str] = set()
    n = float(total["n"])
    for c in range(k):
        pos = float(total[f"p{c}"] or 0)
        a, b = F.col(f"p{c}").cast("double"), (F.col("n") - F.col(f"p{c}")).cast("double")
        rest_a, rest_b = F.lit(pos) - a, F.lit(n - pos) - b
        chi = F.lit(n) * F.pow(a * rest_b - b * rest_a, 2) / F.greatest(
            F.lit(1.0), (a + b) * (rest_a + rest_b) * F.lit(pos) * F.lit(n - pos))
        top = counts.where(F.col("n") >= least).select("f", chi.alias("chi")).where(F.col("chi") >= least_chi)
        chosen |= {r["f"] for r in top.orderBy(F.desc("chi"), "f").limit(per_category).collect()}
    return sorted(chosen)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id",
              text_col: str = "text", sample: int = 12_000, folds: int = 4, per_category: int = 500, least: int = 4,
              least_chi: float = 15.0, seed: int = 1) -> Chain:
    """``categories``: name and label (0, 1 or boolean) over the columns of ``labels``, in
    the order of the chain; the last one decides."""
    k, names = len(categories), list(categories)
    known = labels.select(col(id_col).alias("id"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
    known = known.dropna().groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(k)])
    known = known.withColumn("h", F.xxhash64(F.lit(seed), "id")).orderBy("h", "id").limit(sample)
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), "id")  # at most ``sample`` rows are sent
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "text", F.array(*[f"y{i}" for i in range(k)]).alias("y"),
                       F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(folds)).cast("int").alias("fold"))
    rows = materialise(rows, "toxicity-sample")
    features = _select(rows, k, per_category, least, least_chi)
    width = len(features)

    @F.pandas_udf("struct<at:array<int>,val:array<double>>")
    def vector(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(features)
        for part in parts:
            found = [sorted(vectors.counts(t).items()) for t in part]
            yield pd.DataFrame({"at": [np.array([i for i, _ in f], np.int32) for f in found],
                                "val": [np.log1p(np.array([c for _, c in f], np.float64)) for f in found]})

    rows = rows.select("row", "fold", "y", vector(F.coalesce("text", F.lit(""))).alias("v"))
    rows = rows.select("row", "fold", "y", "v.*", F.array().cast("array<double>").alias("earlier"))
    rows = materialise(rows, "toxicity-vectors")
    weights: list[np.ndarray] = []
    threshold = 0.5
    for c in range(k):
        every = F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("fit")
        # by range: a task of its own for every fit
        fits = rows.select(every, "*").repartitionByRange(folds + 1, "fit").groupBy("fit").applyInPandas(_fitter(c, width, folds), "row long, p double, w array<double>")
        fits = materialise(fits, "toxicity-fits")
        got = fits.where("row < 0").collect()
        weights.append(np.array(got[0]["w"]) if got else np.append(np.zeros(width + c), -30.0))
        held = fits.where("row >= 0").select("row", "p")
        rows = rows.join(held, "row").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p")
        if c == k - 1:
            threshold = _best_threshold(rows.select(F.get("y", F.lit(c)).alias("y"), F.get("earlier", F.lit(c)).alias("p")))
    # where no feature tells the categories apart, all documents look alike: none is rejected
    return Chain(names, features, weights, threshold if features else 1.1)


def _fitter(c: int, width: int, folds: int):
    """Fits category ``c`` without one fold and predicts that fold, or, as the last of the
    fits, on all rows: then the weights are returned."""
    def fit(key, part: pd.DataFrame) -> pd.DataFrame:
        fold = int(key[0])
        part = part.sort_values("row")
        x = list(zip(part["at"], part["val"], strict=True))
        y = np.array([v[c] for v in part["y"]], np.float64)
        earlier = np.array([list(e) for e in part["earlier"]], np.float64).reshape(len(part), c)
        held = (part["fold"] == fold).to_numpy()
        use = np.nonzero(~held)[0]
        w = fit_logistic([x[i] for i in use], earlier[use], y[use], width)
        if fold == folds:  # the model of all rows
            return pd.DataFrame({"row": [-1], "p": [0.0], "w": [w.tolist()]})
        out = np.nonzero(held)[0]
        z = [float(w[x[i][0]] @ x[i][1]) + float(earlier[i] @ w[width:-1]) + w[-1] for i in out]
        return pd.DataFrame({"row": part["row"].to_numpy()[out], "p": 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -50, 50))),
                             "w": pd.Series([None] * len(out), dtype=object)})  # a fold may have no row

    return fit


def _best_threshold(held: DataFrame) -> float:
    """Of the steps of 0.001, the middle of those with the best F1."""
    counts = held.groupBy(F.floor(F.col("p") * 1000).cast("int").alias("b"), "y").agg(F.count(F.lit(1)).alias("n")).collect()
    pos, neg = np.zeros(1002), np.zeros(1002)
    for r in counts:
        (pos if r["y"] else neg)[r["b"]] += r["n"]
    if not pos.sum():
        return 1.1  # reject nothing
    hit, wrong = pos[::-1].cumsum()[::-1], neg[::-1].cumsum()[::-1]
    f1 = 2 * hit / (hit + wrong + pos.sum())
    best = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    return float((best[0] + best[-1]) / 2) / 1000


def probabilities(docs_text: Column, chain: Chain, spark) -> Column:
    """The chain's probabilities of a text, by category, as an array."""
    shared = spark.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = Vectors(shared.value.features)
        for part in parts:
            yield pd.Series([shared.value.probabilities(vectors.counts(t)) for t in part])

    return score(F.coalesce(docs_text, F.lit("")))


def label_columns() -> dict[str, Column]:
    """The labelled categories of the given tables: poor quality first, then toxic."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the chain does not find toxic, with the input's columns."""
    chain = fit_chain(docs, labels, label_columns(), **options)
    p = probabilities(col(options.get("text_col", "text")), chain, docs.sparkSession)
    out = packed(docs, p=p).where(F.element_at("p", -1) < chain.threshold)
    return unpacked(out, docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"), label_columns())
    out = docs.select("doc_id", probabilities(F.col("text"), chain, spark).alias("p"))
    toxic = F.element_at("p", -1) >= chain.threshold
    return out.select("doc_id", *[F.get("p", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(chain.categories)],
                      toxic.alias("toxic"), (~toxic).alias("kept"))
