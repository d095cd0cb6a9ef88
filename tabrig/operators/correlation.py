"""Pairwise-complete Pearson correlation of many columns as block products.

For centred values X (missing cells as 0) and masks M, every sum that a pair needs is an entry of a
matrix product: counts M'M, sums X'M, squares (X*X)'M, products X'X. A task
adds these up for its rows with ``TILE`` columns a side and emits their rows; equal rows of all tasks meet
in one group each, so adding up is spread over as many tasks as there are columns, and
a group turns its column's sums into correlations. The driver holds column means only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, quoted

TILE = 512
STATS = 6  # n, sum a, sum b, squares of a, squares of b, products


def _values(df: DataFrame, cols: list[str]) -> list:
    return [F.when(~is_missing(quoted(c), df.schema[c].dataType), quoted(c)).cast("double") for c in cols]


def column_means(df: DataFrame, cols: list[str]) -> list[float]:
    """Means of the non-missing values (0 without any), ``TILE`` columns a scan."""
    out = []
    for i in range(0, len(cols), TILE):
        part = _values(df, cols[i:i + TILE])
        r = df.agg(*[F.avg(v).alias(f"_m{j}") for j, v in enumerate(part)]).first()
        out += [m if m is not None and np.isfinite(m) else 0.0 for m in r]
    return out


def _sums(left: int, means: np.ndarray):
    """Column sums of a tile pair: the first ``left`` columns against the others (against themselves, if there are none)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in parts:
            if not len(batch):
                continue
            raw = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False)
            there = ~np.isnan(raw)
            x = np.where(there, raw - means, 0.0)
            m = there.astype(np.float64)
            xa, ma = x[:, :left], m[:, :left]
            xb, mb = (x[:, left:], m[:, left:]) if x.shape[1] > left else (xa, ma)
            part = np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb], axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(left), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["a", "sums"])

    return run


def _correlate(first_b: int, upper_only: bool, first_a: int):
    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros(1)
        for part in rows["sums"]:
            total = total + np.frombuffer(part.as_py(), np.float64)
        n, sa, sb, qa, qb, p = total.reshape(STATS, -1)
        a = first_a + rows["a"][0].as_py()
        with np.errstate(all="ignore"):
            va, vb, cov = qa - sa * sa / n, qb - sb * sb / n, p - sa * sb / n
            r = cov / np.sqrt(va * vb)
            # sums of centred values that cancel leave rounding errors: those are no variance
            flat = (n < 2) | (va <= 1e-14 * qa) | (vb <= 1e-14 * qb)
        r = np.where(flat | ~np.isfinite(r), 0.0, np.clip(r, -1, 1))
        b = first_b + np.arange(len(r))
        keep = b >= a if upper_only else np.ones(len(b), bool)
        return pa.table({"a": pa.array(np.full(keep.sum(), a), pa.int32()), "b": pa.array(b[keep], pa.int32()), "r": pa.array(r[keep])})

    return run


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for column numbers a <= b; an undefined correlation is 0."""
    means = np.array(column_means(df, cols))
    out = None
    for i in range(0, len(cols), TILE):
        for j in range(i, len(cols), TILE):
            a, b = cols[i:i + TILE], ([] if i == j else cols[j:j + TILE])
            here = means[[*range(i, i + len(a)), *range(j, j + len(b))]]
            tile = df.select(*[v.alias(f"c{k}") for k, v in enumerate(_values(df, a + b))])
            sums = tile.mapInArrow(_sums(len(a), here), "a int, sums binary")
            part = sums.groupBy("a").applyInArrow(_correlate(j, i == j, i), "a int, b int, r double")
            out = part if out is None else out.unionByName(part)
    return out
