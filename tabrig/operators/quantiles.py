"""Exact quantiles of many columns by radix selection, without a shuffle of values.

A double's bits, with negative ones turned over, order as unsigned integers. The value of a
given rank is found from the top: a scan counts the values by their leading ``BITS`` bits, the
rank picks the bin, the next scan counts the following bits of the values in that bin only,
and so on; after the last scan the whole key, so the value, is known. The tasks count in
fixed-size histograms and emit their non-empty bins, so what is shuffled depends on columns,
ranks and tasks and never on the rows; ties and hot values are counts in one bin.

Wide tables are handled ``COLUMNS`` columns at a time, each with its own column-pruned scans,
which bounds a task's histograms (columns x ranks x 2 ** ``BITS`` counts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, quoted

BITS = 13
COLUMNS = 64
TOP = np.uint64(1 << 63)


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order (-0.0 as 0.0)."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & TOP, ~bits, bits | TOP)


def from_key(key: int) -> float:
    key = np.uint64(key)
    return float(np.array([key ^ TOP if key & TOP else ~key], np.uint64).view(np.float64)[0])


def _count(known: list[list[int]], shift: int, width: int):
    """Counts the bits [shift, shift + width) of the keys whose higher bits are one of the column's
    ``known`` prefixes."""
    prefixes = [np.array(k, np.uint64) for k in known]
    mask = np.uint64((1 << width) - 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(p) << width, np.int64) for p in prefixes]
        for batch in parts:
            for i, p in enumerate(prefixes):
                values = batch.column(i).to_numpy(zero_copy_only=False)
                keys = ordered_keys(values[~np.isnan(values)].astype(np.float64, copy=False))
                above = keys >> np.uint64(shift + width) if shift + width < 64 else np.zeros(len(keys), np.uint64)
                at = np.minimum(np.searchsorted(p, above), len(p) - 1)
                hit = p[at] == above
                bins = (at[hit] << width) + ((keys[hit] >> np.uint64(shift)) & mask).astype(np.int64)
                counts[i] += np.bincount(bins, minlength=len(counts[i]))
        for i, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array((at >> width).astype(np.int32)),
                                              pa.array(at & int(mask)), pa.array(c[at])], ["col", "prefix", "bin", "n"])

    return run


def _select(values: DataFrame, known: list[list[int]], shift: int, width: int) -> DataFrame:
    """(col, prefix, bin, n, before): the bins of one scan with the number of values in lower bins of the prefix."""
    found = values.mapInArrow(_count(known, shift, width), "col int, prefix int, bin long, n long")
    sums = found.groupBy("col", "prefix", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("col", "prefix").orderBy("bin")  # at most 2 ** BITS rows each
    return sums.withColumn("before", F.sum("n").over(w) - F.col("n"))


def _quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[tuple[str, float], float]:
    spark = df.sparkSession
    values = df.select(*[F.when(~is_missing(quoted(c), df.schema[c].dataType), quoted(c)).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    shift, width = 64 - BITS, BITS
    first = _select(values, [[0]] * len(cols), shift, width).persist()  # columns x 2 ** BITS rows at most, read twice
    sizes = {r["col"]: r["n"] for r in first.groupBy("col").agg(F.sum("n").alias("n")).collect()}
    # wanted: (column, rank within the prefix, prefix); every rank of every column goes on by itself
    places = {}
    for i, n in sizes.items():
        for q in probs:
            at = q * (n - 1)
            places[i, q] = (int(np.floor(at)), int(np.ceil(at)), at)
    state = {(i, r): (0, r) for (i, _), (lo, hi, _) in places.items() for r in (lo, hi)}
    bins = first
    while True:
        prefixes = [sorted({p for (i, _), (p, _) in state.items() if i == c}) or [0] for c in range(len(cols))]
        number = [{p: k for k, p in enumerate(ps)} for ps in prefixes]
        wanted = spark.createDataFrame([(i, number[i][p], rank, rest) for (i, rank), (p, rest) in state.items()],
                                       "col int, prefix int, rank long, rest long")
        hit = (F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("n"))
        # columns x ranks rows
        got = bins.join(F.broadcast(wanted), ["col", "prefix"]).where(hit).select(
            "col", "rank", "prefix", "bin", (F.col("rest") - F.col("before")).alias("rest")).collect()
        state = {(r["col"], r["rank"]): ((prefixes[r["col"]][r["prefix"]] << width) | r["bin"], r["rest"]) for r in got}
        if shift == 0 or not state:
            break
        width = min(BITS, shift)
        shift -= width
        prefixes = [sorted({p for (i, _), (p, _) in state.items() if i == c}) or [0] for c in range(len(cols))]
        bins = _select(values, prefixes, shift, width)
    first.unpersist()
    out = {}
    for (i, q), (lo, hi, at) in places.items():
        a, b = from_key(state[i, lo][0]), from_key(state[i, hi][0])
        out[cols[i], q] = a if lo == hi else a + (at - lo) * (b - a)
    return out


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[tuple[str, float], float]:
    """Exact linearly interpolated quantiles of the non-missing values, by (column, probability).
    A column without values has none."""
    out = {}
    for i in range(0, len(cols), COLUMNS):
        out |= _quantiles(df, cols[i:i + COLUMNS], probs)
    return out
