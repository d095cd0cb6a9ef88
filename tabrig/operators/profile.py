"""Profiling aggregations (Q1-Q18, P1). One wide aggregate pass covers counts
and missing cells for every column; duplicates need one all-column grouping.
Only bounded results (one value per column, or <= 20 classes) reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_missing, quoted
from .quantiles import COLUMNS, column_quantiles

# The class-distribution cut-off and the width of the
# ranked-missing chart, as in the reference.
CLASS_DISTRIBUTION_MAX = 20
MISSING_RANKED_TOP = 12
PREVIEW_ROWS = 100
MISSING_LABEL = "nan"  # text key of the missing class in a distribution report

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def data_columns(df: DataFrame, row_key: str | None = None) -> list[str]:
    """Columns that carry data: everything except the explicit row key."""
    return [c for c in df.columns if c != row_key]


def is_numeric_type(dt: T.DataType, bool_is_numeric: bool = True) -> bool:
    if isinstance(dt, NUMERIC_TYPES):
        return True
    return bool_is_numeric and isinstance(dt, T.BooleanType)


def feature_types(df: DataFrame, row_key: str | None = None, exclude: list[str] | None = None,
                  bool_is_numeric: bool = True) -> tuple[list[str], list[str]]:
    """P1 on the schema: (numeric names, categorical names) in column order."""
    skip = set(exclude or []) | ({row_key} if row_key else set())
    fields = [f for f in df.schema.fields if f.name not in skip]
    num = [f.name for f in fields if is_numeric_type(f.dataType, bool_is_numeric)]
    cat = [f.name for f in fields if f.name not in num]
    return num, cat


def _dtype(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def _missing(df: DataFrame, c: str):
    return is_missing(quoted(c), _dtype(df, c))


def _kv_rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------------- P1, Q5, Q6, Q13
def split_feature_types(df: DataFrame, row_key: str | None = None,
                        bool_is_numeric: bool = True) -> DataFrame:
    """(column_name, kind) with kind numeric|categorical."""
    num, cat = feature_types(df, row_key, bool_is_numeric=bool_is_numeric)
    rows = [(c, "numeric" if c in num else "categorical") for c in data_columns(df, row_key)]
    return _kv_rows(df.sparkSession, rows, "column_name string, kind string")


def data_types(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Q5: column -> Spark type name."""
    rows = [(c, _dtype(df, c).simpleString()) for c in data_columns(df, row_key)]
    return _kv_rows(df.sparkSession, rows, "column_name string, data_type string")


def dtype_summary(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Q6: number of columns per type name."""
    return data_types(df, row_key).groupBy("data_type").agg(F.count(F.lit(1)).alias("n_columns"))


def type_counts(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Q13: numeric vs non-numeric column counts (displays exclude booleans)."""
    num, cat = feature_types(df, row_key, bool_is_numeric=False)
    return _kv_rows(df.sparkSession, [(len(num), len(cat))],
                    "numeric_columns long, categorical_columns long")


# --------------------------------------------------------------------------- one-pass stats
def column_stats(df: DataFrame, row_key: str | None = None, target: str | None = None) -> dict:
    """One aggregate job: rows, missing per column, target missing/distinct."""
    cols = data_columns(df, row_key)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)]
    if target is not None:
        tgt = F.when(~_missing(df, target), quoted(target))
        aggs.append(F.count_distinct(tgt).alias("_tdistinct"))
    r = df.agg(*aggs).first()
    out = {"rows": int(r["_rows"]), "columns": len(cols),
           "missing": {c: int(r[f"_m{i}"]) for i, c in enumerate(cols)}}
    if target is not None:
        out["target_missing"] = out["missing"][target]
        out["target_distinct"] = int(r["_tdistinct"])
    return out


# --------------------------------------------------------------------------- Q1-Q4
def shape(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Q1: one row (n_rows, n_columns)."""
    n_cols = len(data_columns(df, row_key))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(n_cols).cast("long").alias("n_columns"))


def missing_by_column(df: DataFrame, row_key: str | None = None,
                      only_positive: bool = False) -> DataFrame:
    """Q2: (column_name, missing). Pipeline A keeps only columns with missing > 0."""
    cols = data_columns(df, row_key)
    wide = df.agg(*[F.count_if(_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("missing"))
        for i, c in enumerate(cols)])))
    return long.where(F.col("missing") > 0) if only_positive else long


def missing_total(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Q3: total missing cells."""
    cols = data_columns(df, row_key)
    total = sum((F.count_if(_missing(df, c)) for c in cols), F.lit(0).cast("long"))
    return df.agg(total.cast("long").alias("missing_total"))


def duplicate_groups(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Groups of fully equal data rows (nulls and NaNs group together) with sizes.
    Partial aggregation means a hot group never travels as raw rows."""
    cols = data_columns(df, row_key)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if row_key:
        aggs.append(F.min(quoted(row_key)).alias("_first_key"))
    return df.groupBy(*[quoted(c) for c in cols]).agg(*aggs)


def duplicate_count(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Q4: rows beyond the first of each equal group: one grouping by all columns, whose
    partial counts fold equal rows before the (single) wide shuffle."""
    g = duplicate_groups(df, row_key)
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


# --------------------------------------------------------------------------- Q7-Q9
def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Q7: missing count and exact distinct count of the target."""
    m = _missing(df, target)
    return df.agg(F.count_if(m).alias("target_missing"),
                  F.count_distinct(F.when(~m, quoted(target))).alias("target_distinct"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Q9: value counts including missing (label null), no cap."""
    m = _missing(df, target)
    label = F.when(~m, quoted(target)).alias("label")
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, target: str,
                       max_classes: int = CLASS_DISTRIBUTION_MAX) -> DataFrame:
    """Q8: value counts incl. missing, only when distinct (non-missing) <= max."""
    dist = target_distribution(df, target)
    n_distinct = dist.where(F.col("label").isNotNull()).count()
    if n_distinct > max_classes:
        return dist.limit(0)
    return dist


# --------------------------------------------------------------------------- Q10, Q11
def _long_values(df: DataFrame, cols: list[str], cast: str) -> DataFrame:
    """Unpivot columns into (column_name, v), skipping missing cells."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             F.when(~_missing(df, c), quoted(c)).cast(cast).alias("v"))
                    for c in cols])
    return df.select(F.inline(arr)).where(F.col("v").isNotNull())


def describe_numeric(df: DataFrame, row_key: str | None = None,
                     cols: list[str] | None = None) -> DataFrame:
    """Q10: count, mean, sample std, min, exact interpolated quartiles, max."""
    if cols is None:
        cols, _ = feature_types(df, row_key, bool_is_numeric=False)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, count long, mean double, std double, min double, "
                "p25 double, p50 double, p75 double, max double")
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    q = column_quantiles(df, cols, list(quartiles.values()))
    rows = []
    for i in range(0, len(cols), COLUMNS):  # one plain aggregate for as many columns
        part = cols[i:i + COLUMNS]
        v = {c: F.when(~_missing(df, c), quoted(c)).cast("double") for c in part}
        r = df.agg(*[f(v[c]).alias(f"_{n}{j}") for j, c in enumerate(part) for n, f in (
            ("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))]).first()
        rows += [(c, r[f"_n{j}"], r[f"_m{j}"], r[f"_s{j}"], r[f"_lo{j}"], *[q.get((c, p)) for p in quartiles.values()], r[f"_hi{j}"])
                 for j, c in enumerate(part) if r[f"_n{j}"]]
    return _kv_rows(df.sparkSession, rows, "column_name string, count long, mean double, std double, min double, "
                                           "p25 double, p50 double, p75 double, max double")


def describe_categorical(df: DataFrame, row_key: str | None = None,
                         cols: list[str] | None = None) -> DataFrame:
    """Q11: count, unique, top (most frequent, ties -> least value), freq."""
    if cols is None:
        _, cols = feature_types(df, row_key, bool_is_numeric=False)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, count long, unique long, top string, freq long")
    long = _long_values(df, cols, "string")
    vc = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("w"))
    return vc.groupBy("column_name").agg(
        F.sum("w").cast("long").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct((-F.col("w")).alias("nw"), F.col("v").alias("vv"))).alias("top"),
        F.max("w").alias("freq"))


# --------------------------------------------------------------------------- Q12, Q14-Q16
def dataset_health(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Q12: max(0, 100 - (missing + duplicates * columns) / max(cells, 1) * 100)."""
    st = column_stats(df, row_key)
    dups = duplicate_count(df, row_key).first()[0]
    cells = max(st["rows"] * st["columns"], 1)
    miss = sum(st["missing"].values())
    health = max(0.0, 100.0 - (miss + dups * st["columns"]) / cells * 100)
    return df.sparkSession.createDataFrame(
        [(st["rows"], st["columns"], miss, int(dups), float(health))],
        "n_rows long, n_columns long, missing_total long, duplicate_rows long, health double")


_FIXED_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
                T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8,
                T.TimestampNTZType: 8, T.DecimalType: 16}


def estimated_bytes(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Q14 (re-aimed): per column, fixed width x rows, or the UTF-8 bytes of
    strings / binary / JSON text of nested values. Not a heap measurement."""
    cols = data_columns(df, row_key)
    aggs = []
    for i, c in enumerate(cols):
        dt = _dtype(df, c)
        width = next((w for t, w in _FIXED_WIDTH.items() if isinstance(dt, t)), None)
        if width is not None:
            aggs.append((F.count(F.lit(1)) * width).cast("long").alias(f"_b{i}"))
        elif isinstance(dt, (T.StringType, T.BinaryType)):
            aggs.append(F.coalesce(F.sum(F.octet_length(quoted(c))), F.lit(0)).cast("long").alias(f"_b{i}"))
        else:
            aggs.append(F.coalesce(F.sum(F.octet_length(F.to_json(quoted(c)))), F.lit(0))
                        .cast("long").alias(f"_b{i}"))
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_b{i}").alias("bytes"))
        for i, c in enumerate(cols)])))


def missing_ranked(df: DataFrame, row_key: str | None = None,
                   n: int = MISSING_RANKED_TOP) -> DataFrame:
    """Q15: top-n columns by missing count (> 0), ties by name."""
    return (missing_by_column(df, row_key, only_positive=True)
            .orderBy(F.col("missing").desc(), F.col("column_name").asc()).limit(n))


def duplicate_members(df: DataFrame, row_key: str, n: int | None = PREVIEW_ROWS) -> DataFrame:
    """Q16: every member of a duplicate group (not only the extras), first n by key.

    One grouping by all columns gives the repeated rows. For the first n, keys and row digests
    are joined with these groups' digests and the n least keys looked up, so that full rows are exchanged only by the
    grouping; without n the table is joined with the groups (null-safe)."""
    cols = data_columns(df, row_key)
    groups = duplicate_groups(df, row_key).where(F.col("_n") > 1)
    if n:
        many = groups.select(*row_digest(groups, cols))
        members = df.select(quoted(row_key).alias("_key"), *row_digest(df, cols)).join(many, ["_d1", "_d2"], "left_semi")
        return rows_of_keys(df, row_key, least_keys(members, n))
    groups = groups.select(*[quoted(c).alias(f"_g{i}") for i, c in enumerate(cols)])
    cond = F.lit(True)
    for i, c in enumerate(cols):
        cond = cond & quoted(c).eqNullSafe(F.col(f"_g{i}"))
    return df.join(groups, cond, "left_semi").orderBy(quoted(row_key))


def row_digest(df: DataFrame, cols: list[str]) -> list:
    """128 bits that stand for a row's cells (``_d1``, ``_d2``); a null differs from any value and from a null
    elsewhere. Rows are told apart up to a chance of about rows squared / 2 ** 129."""
    cells = [x for c in cols for x in (quoted(c).isNull(), quoted(c))]
    return [F.xxhash64(F.lit(1), *cells).alias("_d1"), F.xxhash64(F.lit(2), *reversed(cells)).alias("_d2")]


def least_keys(rows: DataFrame, n: int) -> list:
    """The ``n`` least of ``_key`` (each task passes on its own ``n`` least)."""
    return [r["_key"] for r in rows.select("_key").orderBy("_key").limit(n).collect()]


def rows_of_keys(df: DataFrame, row_key: str, keys: list) -> DataFrame:
    """The rows of a few keys in key order: a lookup that is pushed down to the scan."""
    return df.where(quoted(row_key).isin(keys) if keys else F.lit(False)).orderBy(quoted(row_key))


def split_xy(df: DataFrame, target: str | None = None,
             row_key: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(features, target); the key, if any, stays on both sides so they can
    be joined back. Without a target (or when it is absent) y is None."""
    keys = [quoted(row_key)] if row_key else []
    feats = [quoted(c) for c in df.columns if c != target]
    y = df.select(*keys, quoted(target)) if target and target in df.columns else None
    return df.select(*feats), y


def preview(df: DataFrame, row_key: str, cols: list[str] | None = None,
            n: int = PREVIEW_ROWS) -> DataFrame:
    """Optional column subset, first n rows in key order (TakeOrdered)."""
    keep = [row_key] + [c for c in (cols or data_columns(df, row_key)) if c != row_key]
    return df.select(*[quoted(c) for c in keep]).orderBy(quoted(row_key)).limit(n)


# --------------------------------------------------------------------------- Q17, Q18
def inspect(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Q17: rows, columns, missing total, duplicates, numeric / categorical
    names and type names as one (item, value) table."""
    st = column_stats(df, row_key)
    dups = int(duplicate_count(df, row_key).first()[0])
    num, cat = feature_types(df, row_key, bool_is_numeric=False)
    rows = [("rows", str(st["rows"])), ("columns", str(st["columns"])),
            ("missing_values", str(sum(st["missing"].values()))), ("duplicate_rows", str(dups)),
            ("numeric_columns", ",".join(num)), ("categorical_columns", ",".join(cat))]
    rows += [(f"data_type:{c}", _dtype(df, c).simpleString()) for c in data_columns(df, row_key)]
    return _kv_rows(df.sparkSession, rows, "item string, value string")


def quality_facts(df: DataFrame, target: str, row_key: str | None = None) -> dict:
    """The bounded facts behind Q18 (and the report's quality section): one
    wide aggregate and one all-column grouping."""
    st = column_stats(df, row_key, target)
    st["duplicates"] = int(duplicate_count(df, row_key).first()[0])
    return st


def quality_report(df: DataFrame, target: str, row_key: str | None = None,
                   facts: dict | None = None) -> DataFrame:
    """Q18: composite Q1-Q4, Q7, Q8 as a long (section, item, value) table.
    Three scans: one wide aggregate, one all-column grouping for duplicates and
    one grouping by target (its class distribution, kept only if <= 20 classes)."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' was not found in the dataset.")
    st = facts or quality_facts(df, target, row_key)
    dups = st["duplicates"]
    rows = [("shape", "rows", st["rows"]), ("shape", "columns", st["columns"]),
            ("duplicate_rows", "", dups),
            ("missing_values_total", "", sum(st["missing"].values()))]
    rows += [("missing_values_by_column", c, m) for c, m in st["missing"].items() if m > 0]
    rows += [("target", "missing_values", st["target_missing"]),
             ("target", "unique_values", st["target_distinct"])]
    base = _kv_rows(df.sparkSession, rows, "section string, item string, value long")
    if st["target_distinct"] <= CLASS_DISTRIBUTION_MAX:
        dist = target_distribution(df, target).select(
            F.lit("class_distribution").alias("section"),
            F.coalesce(F.col("label").cast("string"), F.lit(MISSING_LABEL)).alias("item"),
            F.col("n").alias("value"))
        base = base.unionByName(dist)
    return base
