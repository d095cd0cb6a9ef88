"""Cleaning operators.

Duplicates are removed by grouping on every data column and keeping the least
row key, so a duplicate group of any size is folded map-side before it is
shuffled. Removed rows are the other rows of the groups that hold several.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quoted
from ..session import cut_lineage, with_row_id
from .profile import _missing, data_columns, least_keys, row_digest, rows_of_keys

# Change-log wording and limits as in the reference.
CHANGE_DUPLICATE = "Removed Duplicate Row"
CHANGE_EMPTY_COLUMN = "Removed Empty Column"
CHANGE_MISSING_TARGET = "Removed Missing Target Row"
CHANGE_NOOP = "No Destructive Cleaning Required"
ALL_COLUMNS = "All Columns"
ALL_ROWS = "All Rows"
TARGET_LABEL = "Target"
ALL_MISSING = "All values missing"
ROW_REMOVED = "Row Removed"
COLUMN_REMOVED = "Column Removed"
NOOP_BEFORE = "Dataset already structurally valid"
NOOP_AFTER = "Dataset preserved"
LOGGED_ROWS = 25

LOG_SCHEMA = "change string, row_key string, column_name string, before string, after string"


def empty_columns(df: DataFrame, row_key: str | None = None) -> list[str]:
    """Names of columns missing in every row (one aggregate job)."""
    cols = data_columns(df, row_key)
    if not cols:
        return []
    r = df.agg(*[F.count_if(~_missing(df, c)).alias(f"_p{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if r[f"_p{i}"] == 0]


def drop_empty_columns(df: DataFrame, row_key: str | None = None,
                       empty: list[str] | None = None) -> DataFrame:
    """Drop the columns that are missing in every row."""
    empty = empty_columns(df, row_key) if empty is None else empty
    return df.drop(*[quoted(c) for c in empty]) if empty else df


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """P5: drop rows whose target is missing."""
    return df.where(~_missing(df, target))


def drop_duplicates(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """One row per fully equal group; with a key, the least key is kept."""
    if row_key is None:
        return df.dropDuplicates()
    kept = _kept(df, row_key)
    return kept.select(*[quoted(c) for c in df.columns])


def _kept(df: DataFrame, row_key: str) -> DataFrame:
    """C1 with ``_copies``, the size of each group."""
    cols = data_columns(df, row_key)
    return df.groupBy(*[quoted(c) for c in cols]).agg(F.min(quoted(row_key)).alias(row_key), F.count(F.lit(1)).alias("_copies"))


def duplicate_rows(df: DataFrame, row_key: str, n: int | None = LOGGED_ROWS,
                   kept: DataFrame | None = None) -> DataFrame:
    """The rows removed by C1 (all but the least key of each group), first n by key.
    ``kept`` (C1's rows with ``_copies``) saves the grouping. For the first n, keys and row digests
    are joined with those of the groups of several rows and the n least keys looked up: full rows are not
    exchanged again. Without n the groups of several rows are joined back."""
    kept = _kept(df, row_key) if kept is None else kept
    cols = [c for c in data_columns(df, row_key) if c in kept.columns]
    many = kept.where(F.col("_copies") > 1)
    if n:
        least = many.select(quoted(row_key).alias("_least"), *row_digest(many, cols))
        keys = df.select(quoted(row_key).alias("_key"), *row_digest(df, cols)).join(least, ["_d1", "_d2"])
        return rows_of_keys(df, row_key, least_keys(keys.where("_key <> _least"), n))
    many = many.select(quoted(row_key).alias("_least"), *[quoted(c).alias(f"_g{i}") for i, c in enumerate(cols)])
    cond = F.lit(True)
    for i, c in enumerate(cols):
        cond = cond & quoted(c).eqNullSafe(F.col(f"_g{i}"))
    return df.join(many, cond & (quoted(row_key) != F.col("_least")), "left_semi").orderBy(quoted(row_key))


def changes_of_type(log: DataFrame, change: str) -> DataFrame:
    """Change-log rows of one kind."""
    return log.where(F.col("change") == change)


def is_noop_cleaning(log: DataFrame) -> DataFrame:
    """True when every entry is the no-op entry (or the log is empty)."""
    return log.agg(F.coalesce(F.bool_and(F.col("change") == CHANGE_NOOP), F.lit(True))
                   .alias("is_noop"))


def change_counts(log: DataFrame) -> DataFrame:
    """Entries per change kind."""
    return log.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _row_json(df: DataFrame, cols: list[str]):
    return F.to_json(F.struct(*[quoted(c) for c in cols]), {"ignoreNullFields": "false"})


@dataclass
class CleanResult:
    cleaned: DataFrame
    summary: dict
    empty_columns: list[str]
    deduped: DataFrame
    log: DataFrame | None = None
    extras: dict = field(default_factory=dict)

    def summary_frame(self) -> DataFrame:
        return cleaning_summary_frame(self.cleaned.sparkSession, self.summary)


def basic_clean(df: DataFrame, row_key: str | None = None) -> CleanResult:
    """Drop empty columns, then duplicates; counts of what went and what is left."""
    cols = data_columns(df, row_key)
    empty = empty_columns(df, row_key)
    no_empty = drop_empty_columns(df, row_key, empty)
    deduped = drop_duplicates(no_empty, row_key)
    before_rows = df.count()
    after_rows = deduped.count()
    summary = {"rows_removed": before_rows - after_rows,
               "columns_removed": len(empty),
               "remaining_rows": after_rows,
               "remaining_columns": len(cols) - len(empty)}
    return CleanResult(cleaned=deduped, summary=summary, empty_columns=empty, deduped=deduped)


def clean(df: DataFrame, target: str, row_key: str | None = None,
          persist: bool = False) -> CleanResult:
    """C4 (pipeline A): C3, error if the target was dropped, then P5.
    C5 quirk kept: ``remaining_rows`` is counted before missing-target rows go.
    Without a row key a synthetic ``_row_id`` is added (positions have no
    meaning in a distributed table)."""
    if row_key is None:
        df, row_key = with_row_id(df), "_row_id"
    cols = data_columns(df, row_key)
    if target not in cols:
        raise ValueError(f"Target column '{target}' was not found in the dataset.")
    empty = empty_columns(df, row_key)
    if target in empty:
        raise ValueError("Target column was removed during cleaning.")
    no_empty = drop_empty_columns(df, row_key, empty)
    # The grouped table feeds the counts, the log and the result: it is written once into
    # the shared folder, so nothing stays cached (``persist`` keeps it in memory besides).
    grouped = cut_lineage(_kept(no_empty, row_key))
    deduped = grouped.select(*[quoted(c) for c in no_empty.columns])
    if persist:
        deduped = deduped.persist()
    kept_cols = data_columns(deduped, row_key)
    tmiss = _missing(deduped, target)
    # One job over the deduplicated table: sizes and the missing cells left.
    r = deduped.agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(tmiss).alias("_tmiss"),
        *[F.count_if(~tmiss & _missing(deduped, c)).alias(f"_m{i}") for i, c in enumerate(kept_cols)]
    ).first()
    before_rows = int(grouped.agg(F.sum("_copies")).first()[0] or 0)
    cleaned = drop_missing_target(deduped, target)
    summary = {"rows_removed": before_rows - int(r["_rows"]),
               "columns_removed": len(empty),
               "remaining_rows": int(r["_rows"]),
               "remaining_columns": len(cols) - len(empty),
               "rows_removed_missing_target": int(r["_tmiss"]),
               "missing_values_remaining": int(sum(r[f"_m{i}"] for i in range(len(kept_cols))))}
    res = CleanResult(cleaned=cleaned, summary=summary, empty_columns=empty, deduped=deduped,
                      extras={"row_key": row_key, "grouped": grouped})
    res.log = change_log(df, target, row_key, res)
    return res


SUMMARY_FIELDS = ["rows_removed", "columns_removed", "remaining_rows", "remaining_columns",
                  "rows_removed_missing_target", "missing_values_remaining"]


def cleaning_summary_frame(spark, summary: dict) -> DataFrame:
    """One-row summary table."""
    fields = [f for f in SUMMARY_FIELDS if f in summary]
    return spark.createDataFrame([tuple(int(summary[f]) for f in fields)],
                                 ", ".join(f"{f} long" for f in fields))


def change_log(df: DataFrame, target: str, row_key: str, res: CleanResult,
               n: int = LOGGED_ROWS) -> DataFrame:
    """Up to 25 removed duplicates, every empty column, up to 25
    missing-target rows; one no-op entry when nothing changed. ``row_key`` is
    the stable key as text (the reference logs a positional index)."""
    spark = df.sparkSession
    all_cols = data_columns(df, row_key)
    # Dropping all-missing columns leaves the equal groups as they were, so
    # the grouping of the cleaned table is reused.
    dups = duplicate_rows(df, row_key, n, res.extras.get("grouped")).select(
        F.lit(CHANGE_DUPLICATE).alias("change"), quoted(row_key).cast("string").alias("row_key"),
        F.lit(ALL_COLUMNS).alias("column_name"), _row_json(df, all_cols).alias("before"),
        F.lit(ROW_REMOVED).alias("after"))
    empties = spark.createDataFrame(
        [(CHANGE_EMPTY_COLUMN, ALL_ROWS, c, ALL_MISSING, COLUMN_REMOVED) for c in res.empty_columns],
        LOG_SCHEMA)
    d = res.deduped
    kept = data_columns(d, row_key)
    miss = (d.where(_missing(d, target)).orderBy(quoted(row_key)).limit(n).select(
        F.lit(CHANGE_MISSING_TARGET).alias("change"), quoted(row_key).cast("string").alias("row_key"),
        F.lit(TARGET_LABEL).alias("column_name"), _row_json(d, kept).alias("before"),
        F.lit(ROW_REMOVED).alias("after")))
    log = dups.unionByName(empties).unionByName(miss)
    if res.summary.get("rows_removed", 0) == 0 and not res.empty_columns \
            and res.summary.get("rows_removed_missing_target", 0) == 0:
        return spark.createDataFrame([(CHANGE_NOOP, "-", "-", NOOP_BEFORE, NOOP_AFTER)], LOG_SCHEMA)
    return log


def before_after(df: DataFrame, cleaned: DataFrame, row_key: str | None = None) -> DataFrame:
    """C8 (re-aimed): rows, columns and missing cells before and after cleaning."""
    def side(name, d):
        cols = data_columns(d, row_key)
        miss = sum((F.count_if(_missing(d, c)) for c in cols), F.lit(0).cast("long"))
        return d.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n_rows"),
                     F.lit(len(cols)).cast("long").alias("n_columns"),
                     miss.cast("long").alias("missing"))
    return side("before", df).unionByName(side("after", cleaned))
