"""Scalar Column -> Column helpers (K1-K8, T3). All native expressions, so
they stay inside whole-stage codegen; no Python UDF anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's display text.
PENDING = "Pending"
BYTE_UNITS = ["B", "KB", "MB", "GB"]  # then "TB" for everything larger
TRUNCATE_MARK = "..."


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _c(x) -> Column:
    return quoted(x) if isinstance(x, str) else x


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_missing(col, dtype: T.DataType | None = None) -> Column:
    """K8: null, or NaN for float/double columns."""
    c = _c(col)
    if dtype is not None and is_float_type(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def format_metric(x) -> Column:
    """K1: null -> Pending; within [-1, 1] -> percent with 2 dp; else 4 dp."""
    c = _c(x).cast("double")
    return (F.when(c.isNull(), F.lit(PENDING))
            .when((c >= -1) & (c <= 1), F.format_string("%.2f%%", c * 100))
            .otherwise(F.format_string("%.4f", c)))


def format_bytes(n) -> Column:
    """K2: base-1024 ladder B/KB/MB/GB, then TB, one decimal."""
    v = _c(n).cast("double")
    out = None
    for i, unit in enumerate(BYTE_UNITS):
        scaled = v / float(1024 ** i)
        branch = F.format_string("%.1f " + unit, scaled)
        out = F.when(scaled < 1024, branch) if out is None else out.when(scaled < 1024, branch)
    return out.otherwise(F.format_string("%.1f TB", v / float(1024 ** len(BYTE_UNITS))))


def title_case(s, underscores: bool = True) -> Column:
    """K3: empty/null -> Pending; words capitalised (underscores read as spaces)."""
    c = _c(s).cast("string")
    txt = F.regexp_replace(c, "_", " ") if underscores else c
    return F.when(c.isNull() | (c == ""), F.lit(PENDING)).otherwise(F.initcap(txt))


def safe_name(s) -> Column:
    """K4: runs of non-alphanumerics -> one '_', trimmed, lower case."""
    c = F.regexp_replace(_c(s).cast("string"), r"[^\p{L}\p{N}]+", "_")
    return F.lower(F.regexp_replace(c, r"^_+|_+$", ""))


def truncate(s, n: int = 140) -> Column:
    """K5: longer than n characters -> first n-3 characters + '...'."""
    c = _c(s).cast("string")
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit(TRUNCATE_MARK))).otherwise(c)


def run_seconds(start, end) -> Column:
    """Seconds between two timestamps (ntz or ltz)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / 1e6


def run_duration(start, end) -> Column:
    """K6: 'x.xx Sec'; Pending when either side is missing."""
    secs = run_seconds(start, end)
    return F.when(_c(start).isNull() | _c(end).isNull(), F.lit(PENDING)).otherwise(
        F.format_string("%.2f Sec", secs))


def percent(x, dp: int = 0) -> Column:
    """K7: share as percent text with dp decimals."""
    return F.format_string(f"%.{int(dp)}f%%", _c(x).cast("double") * 100)


def is_integer_like(col, dtype: T.DataType) -> Column:
    """T3 (aggregate): every non-missing value is a whole number.
    Integral types are trivially true; infinities are not whole."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return F.lit(True)
    c = _c(col).cast("double")
    whole = F.when(~is_missing(c, T.DoubleType()), (c % 1) == 0)
    return F.coalesce(F.bool_and(whole), F.lit(True))
