"""Preprocessing (F1-F9): exact-median and most-frequent imputation,
population standardisation and sorted one-hot encoding.

Statistics are distributed aggregates; the categories are a table that rows are joined with
(``encode.py``), so their number bounds neither a task nor the driver. The fitted transform is a
``PipelineModel``, so it saves and loads with the standard ML writers and runs as JVM expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, quoted
from .clean import drop_duplicates
from .encode import TableEncoder, category_dictionary, category_values
from .quantiles import column_quantiles
from .profile import _missing, feature_types

FEATURES_COL = "features"


# --------------------------------------------------------------------------- F1-F3 statistics
def fit_median(train: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """F1 fit: exact interpolated median per numeric column (missing skipped)."""
    got = column_quantiles(train, cols, [0.5])
    return {c: got.get((c, 0.5)) for c in cols}


def impute_median(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """F1 transform: missing (null/NaN) -> train median."""
    return df.select(*[
        (F.when(is_missing(quoted(c), df.schema[c].dataType), F.lit(medians[c]))
         .otherwise(quoted(c)).cast("double").alias(c)) if c in medians else quoted(c)
        for c in df.columns])


def fit_most_frequent(train: DataFrame, cols: list[str]) -> dict[str, dict]:
    """F2 fit: most frequent value per column (ties -> least value), with the
    distinct count so callers can bound the category lists."""
    if not cols:
        return {}
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             F.when(~_missing(train, c), quoted(c)).cast("string").alias("v")) for c in cols])
    long = train.select(F.inline(arr)).where(F.col("v").isNotNull())
    vc = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("w"))
    res = vc.groupBy("column_name").agg(
        F.min_by("v", F.struct((-F.col("w")).alias("nw"), F.col("v").alias("vv"))).alias("mode"),
        F.count(F.lit(1)).alias("n_distinct")).collect()
    got = {r["column_name"]: {"mode": r["mode"], "n_distinct": int(r["n_distinct"])} for r in res}
    return {c: got.get(c, {"mode": None, "n_distinct": 0}) for c in cols}


def impute_most_frequent(df: DataFrame, modes: dict[str, str | None]) -> DataFrame:
    """F2 transform: missing -> most frequent train value (as text)."""
    return df.select(*[
        F.coalesce(F.when(~_missing(df, c), quoted(c)).cast("string"), F.lit(modes[c])).alias(c)
        if c in modes else quoted(c) for c in df.columns])


def fit_standardize(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """F3 fit: (mean, population std) per column; zero std -> 1."""
    if not cols:
        return {}
    r = train.agg(*[x for i, c in enumerate(cols) for x in (
        F.avg(quoted(c).cast("double")).alias(f"_m{i}"),
        F.stddev_pop(quoted(c).cast("double")).alias(f"_s{i}"))]).first()
    out = {}
    for i, c in enumerate(cols):
        s = r[f"_s{i}"]
        out[c] = (r[f"_m{i}"], 1.0 if (s is None or s == 0) else s)
    return out


def standardize(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """F3 transform."""
    return df.select(*[((quoted(c).cast("double") - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c)
                       if c in params else quoted(c) for c in df.columns])


def one_hot_long(df: DataFrame, row_key: str, categories: DataFrame) -> DataFrame:
    """F4 in long form: (row_key, feature) for each active indicator; values unseen at
    fit time produce no indicator. ``categories``: the table of ``category_values``; the
    input is unpivoted once and joined with it."""
    cols = [c for c in df.columns if c != row_key]
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("v")) for c in cols])
    long = df.select(quoted(row_key), F.inline(arr)).join(categories, ["column_name", "v"])
    return long.select(quoted(row_key), F.concat_ws("_", "column_name", "v").alias("feature"))


# --------------------------------------------------------------------------- F5-F8
@dataclass
class Preprocessor:
    """A fitted preprocessor: ``model`` is the transformer (a pipeline of one ``TableEncoder``).
    Feature names are a table; ``feature_names`` lists them for tables that are as wide anyway."""
    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    dropped: list[str] = field(default_factory=list)
    stats: dict = field(default_factory=dict)
    output_col: str = FEATURES_COL

    @property
    def encoder(self) -> TableEncoder:
        return self.model.stages[0]

    @property
    def input_columns(self) -> list[str]:
        return self.numeric + self.categorical

    @property
    def feature_names(self) -> list[str]:
        return [r["feature"] for r in self.encoder.feature_table().orderBy("idx").collect()]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def build_preprocessor(train: DataFrame, features: list[str] | None = None, target: str | None = None,
                       row_key: str | None = None, bool_is_numeric: bool = True, output_col: str = FEATURES_COL) -> Preprocessor:
    """median + standardise numeric features, most-frequent + one-hot the
    categorical ones (numeric first); everything else is dropped."""
    exclude = [c for c in [target, row_key] if c]
    if features is not None:
        exclude += [c for c in train.columns if c not in features]
    num, cat = feature_types(train, exclude=exclude, bool_is_numeric=bool_is_numeric)
    unsupported = [c for c in cat if train.schema[c].dataType.typeName() in ("array", "map", "struct")]
    cat = [c for c in cat if c not in unsupported]
    medians = fit_median(train, num)
    num = [c for c in num if medians.get(c) is not None]  # all-missing columns carry nothing
    # Means and population std of the imputed values, one aggregate.
    imputed = impute_median(train.select(*[quoted(c) for c in num]), medians) if num else None
    scale = fit_standardize(imputed, num) if num else {}
    dictionary, sizes = category_dictionary(category_values(train, cat), cat, len(num))
    dropped = unsupported + [c for c in cat if c not in sizes]
    cat = [c for c in cat if c in sizes]
    modes = {c: m["mode"] for c, m in fit_most_frequent(train, cat).items()}
    encoder = TableEncoder([[c, medians[c], *scale[c]] for c in num], [[c, modes[c], sizes[c]] for c in cat], dictionary, output_col)
    return Preprocessor(PipelineModel(stages=[encoder]), num, cat, dropped,
                        {"medians": medians, "scale": scale, "modes": modes, "sizes": sizes}, output_col)


def feature_names(prep: Preprocessor) -> DataFrame:
    """(idx, feature): numeric names, then ``col_value`` for each category."""
    return prep.encoder.feature_table()


def align_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Fail when an expected column is absent, else select in fitted order."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"Missing expected columns for transform: {missing}")
    return df.select(*[quoted(c) for c in expected])


def to_wide(df: DataFrame, prep: Preprocessor, keep: list[str] | None = None) -> DataFrame:
    """Assembled vector -> one column per feature name. For as many features as a table can have
    columns; the long form has no such bound."""
    arr = vector_to_array(quoted(prep.output_col))
    return df.select(*[quoted(c) for c in keep or []], *[arr[i].alias(n) for i, n in enumerate(prep.feature_names)])


@dataclass
class FitTransformResult:
    target: DataFrame | None
    preprocessor: Preprocessor
    assembled: DataFrame  # deduplicated rows with the feature vector (and target)
    rows: DataFrame  # deduplicated rows
    row_key: str | None = None

    @property
    def features(self) -> DataFrame:
        """Wide table: row key (if any) + one column per feature."""
        return to_wide(self.assembled, self.preprocessor, [self.row_key] if self.row_key else [])

    @property
    def features_long(self) -> DataFrame:
        """(row key, feature, value), for any number of features."""
        return self.preprocessor.encoder.long_features(self.rows, self.row_key)


def fit_transform(df: DataFrame, target: str | None = None, row_key: str | None = None) -> FitTransformResult:
    """F7 (pipeline B): drop duplicates, split X / y, fit on the whole table
    (as the reference does, which leaks test statistics), transform."""
    deduped = drop_duplicates(df, row_key)
    prep = build_preprocessor(deduped, target=target if target in df.columns else None, row_key=row_key,
                              bool_is_numeric=False)
    assembled = prep.transform(deduped)
    keys = [quoted(row_key)] if row_key else []
    y = assembled.select(*keys, quoted(target)) if target and target in df.columns else None
    return FitTransformResult(y, prep, assembled, deduped, row_key)


def _new_rows(prep: Preprocessor | None, df: DataFrame, row_key: str | None, dedupe: bool) -> DataFrame:
    if prep is None:
        raise RuntimeError("There is no fitted preprocessor to apply.")
    align_columns(df, prep.input_columns)
    return drop_duplicates(df, row_key) if dedupe else df


def transform(prep: Preprocessor | None, df: DataFrame, row_key: str | None = None,
              dedupe: bool = True) -> DataFrame:
    """F8: apply a fitted preprocessor to new rows; dedupes first unless told
    not to (a plain transform, so it also runs on a streaming DataFrame)."""
    src = _new_rows(prep, df, row_key, dedupe)
    return to_wide(prep.transform(src), prep, [row_key] if row_key else [])


def transform_long(prep: Preprocessor | None, df: DataFrame, row_key: str, dedupe: bool = True) -> DataFrame:
    """F8 in long form: (row_key, feature, value), for any number of features."""
    src = _new_rows(prep, df, row_key, dedupe)
    return prep.encoder.long_features(src, row_key)


# --------------------------------------------------------------------------- F9
NOTE_MISSING = "Missing feature values handled during model preprocessing"


def preprocessing_actions(df: DataFrame, target: str, row_key: str | None = None) -> DataFrame:
    """the preprocessing notes shown after cleaning, one row each, in order."""
    num, cat = feature_types(df, exclude=[target] + ([row_key] if row_key else []), bool_is_numeric=False)
    feats = num + cat
    any_missing = F.lit(False)
    for c in feats:
        any_missing = any_missing | F.max(_missing(df, c).cast("int")).cast("boolean")
    a = df.agg(F.coalesce(any_missing, F.lit(False)).alias("_m"))
    notes = F.array(
        F.when(F.col("_m"), F.struct(F.lit(1).alias("ord"), F.lit(NOTE_MISSING).alias("note"))),
        F.when(F.lit(len(cat) > 0), F.struct(F.lit(2).alias("ord"),
                                             F.lit(f"{len(cat)} categorical feature(s) encoded").alias("note"))),
        F.when(F.lit(len(num) > 0), F.struct(F.lit(3).alias("ord"),
                                             F.lit(f"{len(num)} numerical feature(s) standardized").alias("note"))))
    return a.select(F.explode(notes).alias("n")).where(F.col("n").isNotNull()).select("n.ord", "n.note")
