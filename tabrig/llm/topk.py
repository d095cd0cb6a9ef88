"""Exact top-k inner product search by a pivot-distance index.

Vectors are turned into integers and given one more component that makes them all
equally long, so that the largest inner product with a query is the least distance.
Every vector is keyed by its nearest pivot and its distance to it; the cells of the
pivots are cut into annuli of sorted distances, and these, where they hold many vectors
(equal ones, say), into blocks. A query first searches its own block; its k-th best score
there bounds the distance of a better one. By the triangle inequality an annulus whose
distances to its pivot all differ from the query's by more than that bound is
left out; the others are searched, blocks of vectors against blocks of queries. Nothing
is approximate: inner products are exact integers, and bounds have a margin for rounding.

Sizes: ``pivots`` and ``rings`` (annuli of a cell) bound the directory that all tasks get;
``block`` bounds the vectors, and ``queries_per_task`` the queries, of one group.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id; an empty vector scores 0 with any other; where products may exceed 62 bits they are
computed in Python integers; a component or a score to return that does not fit in 64 bits
raises an error;
missing last components count as 0; rows of equal id and vector count once, and rows that share the query's id
are no candidates; ties go to the smaller id; with fewer candidates than k all are
returned; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise, table


def integer_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (binary: 64-bit integers floor(scale * x)) and ``norm`` (squared
    length, exact below 2^53)."""
    v = col(vector_col).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(fine & col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), v.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, norms = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x.values.to_numpy(zero_copy_only=False))
                if np.abs(x).max(initial=0) >= 2.0 ** 63:
                    raise OverflowError(f"top-k: a component of the vector with id {i} does not fit in 64 bits")
                ids.append(i)
                out.append(x.astype(np.int64).tobytes())
                norms.append(float(x @ x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())],
                                             ["id", "v", "norm"])

    return rows.mapInArrow(run, "id long, v binary, norm double").dropDuplicates(["id", "v"])


def _matrix(values, width: int) -> np.ndarray:
    """Rows of integers, filled up with 0."""
    values = list(values)
    if width and all(len(v) == 8 * width for v in values):
        return np.frombuffer(b"".join(values), np.int64).reshape(len(values), width)
    out = np.zeros((len(values), width), np.int64)
    for row, v in zip(out, values, strict=True):
        if v:
            row[:len(v) // 8] = np.frombuffer(v, np.int64)
    return out


def _products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products; as doubles where each sum fits in 53 bits, as Python integers
    where one may need more than 63."""
    if longest < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if longest < 1 << 62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def _fitting(scores: np.ndarray) -> np.ndarray:
    """Scores to return, as 64-bit integers."""
    if scores.dtype == object and any(not -(1 << 63) <= s < 1 << 63 for s in scores):
        raise OverflowError("top-k: a score does not fit in 64 bits")
    return scores.astype(np.int64)


class Pivots:
    """Distances to the pivots among vectors lengthened to the longest one."""

    def __init__(self, values: list[bytes], norms: list[float], width: int, longest: float):
        self.p = _matrix(values, width).astype(np.float64)
        self.longest, self.width = float(longest), width
        self.more = np.sqrt(np.maximum(self.longest - np.array(norms, np.float64), 0))

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        more = np.sqrt(np.maximum(self.longest - (v * v).sum(1), 0))
        return np.sqrt(np.maximum(2 * (self.longest - v @ self.p.T - more[:, None] * self.more), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """Queries are not lengthened: their last component is 0."""
        q = q.astype(np.float64)
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.longest - 2 * (q @ self.p.T), 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int = 32, rings: int = 64,
          block: int = 2048, queries_per_task: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` for the rows of ``vectors``
    that ``is_query`` (over the column ``id``) selects, against all rows but their own."""
    spark = vectors.sparkSession
    valid = materialise(integer_vectors(vectors, scale, id_col, vector_col), "topk-vectors")
    facts = valid.agg(F.max("norm").alias("longest"), F.max(F.length("v")).alias("bytes"),
                      F.count(F.when(is_query, 1)).alias("queries")).collect()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if facts["longest"] is None or not facts["queries"]:
        return empty
    width, longest = facts["bytes"] // 8, facts["longest"]
    chosen = valid.groupBy("v").agg(F.min("norm").alias("norm")).orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    shared = spark.sparkContext.broadcast(Pivots([bytes(r["v"]) for r in chosen], [r["norm"] for r in chosen], width, longest))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            d = p.of_vectors(_matrix(batch.column(1).to_pylist(), width))
            near = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)),
                                              pa.array(d[np.arange(len(d)), near])], ["id", "v", "pivot", "dist"])

    keyed = materialise(valid.select("id", "v").mapInArrow(key, "id long, v binary, pivot int, dist double"), "topk-keys")
    # the directory: annuli of about ``block`` vectors, from sorted distances
    probs = [i / rings for i in range(1, rings)]
    cells = keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", probs, 2000).alias("q")).collect()
    bounds = []
    for c in cells:
        many = min(rings, max(1, c["n"] // block))
        bounds.append((c["pivot"], sorted({c["q"][round(i * rings / many) - 1] for i in range(1, many)})))
    bounds = F.broadcast(spark.createDataFrame(bounds, "pivot int, bounds array<double>"))  # at most ``pivots`` rows
    ringed = keyed.join(bounds, "pivot").withColumn("ring", F.size(F.filter("bounds", lambda b: b < F.col("dist")))).drop("bounds")
    annuli = ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    annuli = annuli.withColumn("blocks", F.ceil(F.col("n") / (2 * block)).cast("int")).orderBy("pivot", "ring").collect()
    sizes = F.broadcast(spark.createDataFrame([(a["pivot"], a["ring"], a["blocks"]) for a in annuli], "pivot int, ring int, blocks int"))
    blocked = ringed.join(sizes, ["pivot", "ring"]).select("pivot", "ring", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("part"), "id", "v")
    home = blocked.withColumn("query", is_query).groupBy("pivot", "ring", "part").applyInPandas(
        _first_search(k, width, longest), "query_id long, v binary, least long")
    directory = spark.sparkContext.broadcast(
        (np.array([a["pivot"] for a in annuli]), np.array([a["low"] for a in annuli]), np.array([a["high"] for a in annuli]),
         [(a["pivot"], a["ring"], a["blocks"]) for a in annuli]))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        at, low, high, names = directory.value
        for batch in batches:
            ids, raw, least = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            q = _matrix(raw, width)
            d = p.of_queries(q)[:, at] if len(q) else np.zeros((0, len(at)))
            for i, row in enumerate(d):
                if least[i] is None:
                    need = range(len(names))
                else:
                    square = float((q[i].astype(np.float64) ** 2).sum()) + p.longest
                    bound = np.sqrt(max(square - 2 * least[i], 0)) + 1e-6 * np.sqrt(square) + 1e-3
                    need = np.nonzero(np.maximum(row - high, low - row) <= bound)[0].tolist()
                spots = [(*names[j][:2], part) for j in need for part in range(names[j][2])]
                for s in range(0, len(spots), 5000):
                    some = spots[s:s + 5000]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[c] for x in some], pa.int32()) for c in range(3)]
                        + [pa.array([ids[i]] * n, pa.int64()), pa.array([raw[i]] * n, pa.binary()), pa.array([least[i]] * n, pa.int64())],
                        ["pivot", "ring", "part", "query_id", "v", "least"])

    tasks = -(-facts["queries"] // queries_per_task)  # blocks of queries
    wanted = home.mapInArrow(expand, "pivot int, ring int, part int, query_id long, v binary, least long")
    wanted = wanted.withColumn("some", F.pmod(F.xxhash64("query_id"), F.lit(tasks)).cast("int"))
    against = blocked.withColumn("some", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    keys = ["pivot", "ring", "part", "some"]
    found = against.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(
        _search(k, width, longest), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first_search(k: int, width: int, longest: float):
    """For each query of a block, its k-th best score in the block (null: fewer rows, or
    below 64 bits; a score above 64 bits raises, as it or a better one would be returned)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        q = part[part["query"].astype(bool)]
        if not len(q):
            return pd.DataFrame({"query_id": [], "v": [], "least": []})
        s = _products(_matrix(q["v"], width), _matrix(part["v"], width), longest)
        own = q["id"].to_numpy()[:, None] == part["id"].to_numpy()
        least = []
        for row, mine in zip(s, own, strict=True):
            others = row[~mine]
            kth = int(np.partition(others, len(others) - k)[len(others) - k]) if len(others) >= k else None
            least.append(None if kth is None or kth < -(1 << 63) else int(_fitting(np.array([kth], object))[0]))
        return pd.DataFrame({"query_id": q["id"].to_numpy(), "v": q["v"].to_numpy(), "least": pd.array(least, "Int64")})

    return run


def _search(k: int, width: int, longest: float):
    """The k best of a block for each query, if as good as the query's k-th best so far."""
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(rows) or not len(queries):
            return none
        rows = rows.sort_values("id", kind="stable")
        ids, m = rows["id"].to_numpy(), _matrix(rows["v"], width)
        out = []
        for a in range(0, len(queries), 256):
            some = queries.iloc[a:a + 256]
            s = _products(_matrix(some["v"], width), m, longest)
            for q, least, row in zip(some["query_id"], some["least"], s, strict=True):
                # pandas turns a column with nulls into doubles, so the bound allows for their rounding
                fit = np.nonzero((ids != q) & ((row >= int(least) - (abs(int(least)) >> 50)) if pd.notna(least) else True))[0]
                if len(fit):
                    fit = fit[np.argsort(-row[fit], kind="stable")[:k]]  # ties: smaller ids first
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[fit], "score": _fitting(row[fit])}))
        return pd.concat(out) if out else none

    return run


def op5(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
