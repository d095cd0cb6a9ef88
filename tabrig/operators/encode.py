"""One-hot encoding against a dictionary table.

The categories of all columns are one table (column_name, v, idx): the distinct values with
their feature number, numbered per column in value order by distributed running totals.
Rows meet it in joins; neither a task nor the driver ever holds the values of a column, and what the
driver knows (medians, scales, modes, sizes) is bounded by the number of columns.

``TableEncoder`` is a Spark ML transformer, so it is a stage of a ``PipelineModel``, is saved
and loaded with it and works on streams: one left join for each categorical column (the planner
broadcasts a small dictionary, sorts a large one and splits its hot values), then a
sparse vector built by JVM expressions. The long form (``long_features``) unpivots instead and joins once.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalars import quoted
from ..session import cut_lineage
from .ordered import row_index
from .profile import _missing

DICTIONARY_SCHEMA = "column_name string, v string, idx long"


def category_values(train: DataFrame, cols: list[str]) -> DataFrame:
    """F4 fit as a table: (column_name, v) of the distinct non-missing values."""
    if not cols:
        return train.sparkSession.createDataFrame([], "column_name string, v string")
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             F.when(~_missing(train, c), quoted(c)).cast("string").alias("v")) for c in cols])
    return train.select(F.inline(arr)).where(F.col("v").isNotNull()).distinct()


def _pick(column: Column, values: dict[str, int]) -> Column:
    """The number that belongs to a column name (one branch for each column of the table)."""
    out = F.lit(None).cast("long")
    for name, n in values.items():
        out = F.when(column == F.lit(name), F.lit(n).cast("long")).otherwise(out)
    return out


def category_dictionary(values: DataFrame, cols: list[str], first: int) -> tuple[DataFrame, dict[str, int]]:
    """(column_name, v, idx) with consecutive feature numbers from ``first`` on, columns in the given
    order and values ascending; and the number of values of each column that has any."""
    if not cols:
        return values.sparkSession.createDataFrame([], DICTIONARY_SCHEMA), {}
    placed = cut_lineage(row_index(values, ["v"], ["column_name"], name="_pos"))
    found = {r["column_name"]: int(r["n"]) for r in placed.groupBy("column_name").agg(F.max("_pos").alias("n")).collect()}
    sizes = {c: found[c] for c in cols if c in found}
    starts, at = {}, first
    for c, n in sizes.items():
        starts[c] = at
        at += n
    idx = F.col("_pos") - 1 + _pick(F.col("column_name"), starts)
    return placed.select("column_name", "v", idx.alias("idx")), sizes


class TableEncoder(Transformer, MLWritable, MLReadable):
    """Median-imputed standardised numbers, then mode-imputed one-hot categories, as one vector.

    ``numeric``: [column, median, mean, std]; ``categorical``: [column, mode, number of
    values], in feature order; ``dictionary``: the table of ``category_dictionary``."""

    def __init__(self, numeric: list[list] | None = None, categorical: list[list] | None = None,
                 dictionary: DataFrame | None = None, output_col: str = "features"):
        super().__init__()
        self.numeric = numeric or []
        self.categorical = categorical or []
        self.dictionary = dictionary
        self.output_col = output_col

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(n for _, _, n in self.categorical)

    def _number(self, df: DataFrame, i: int) -> Column:
        c, median, mean, std = self.numeric[i]
        value = F.when(_missing(df, c), F.lit(float(median))).otherwise(quoted(c).cast("double"))
        return (value - F.lit(float(mean))) / F.lit(float(std))

    def _category(self, df: DataFrame, i: int) -> Column:
        c, mode, _ = self.categorical[i]
        return F.coalesce(F.when(~_missing(df, c), quoted(c)).cast("string"), F.lit(mode))

    def _transform(self, df: DataFrame) -> DataFrame:
        out, found = df, []
        for i, (c, _, _) in enumerate(self.categorical):
            part = self.dictionary.where(F.col("column_name") == F.lit(c)).select(
                F.col("v").alias(f"__value_{i}"), F.col("idx").cast("int").alias(f"__idx_{i}"))
            out = out.join(part, self._category(df, i) == F.col(f"__value_{i}"), "left")
            found.append(F.col(f"__idx_{i}"))
        numbers = [self._number(df, i) for i in range(len(self.numeric))]
        doubles = F.array(*numbers).cast("array<double>")
        hits = F.filter(F.array(*found).cast("array<int>"), lambda x: x.isNotNull())  # ascending: columns are in feature order
        if self.categorical:
            parts = [F.lit(0).cast("tinyint").alias("type"), F.lit(self.width).alias("size"),
                     F.concat(F.array(*[F.lit(i) for i in range(len(numbers))]).cast("array<int>"), hits).alias("indices"),
                     F.concat(doubles, F.transform(hits, lambda x: F.lit(1.0))).alias("values")]
        else:
            parts = [F.lit(1).cast("tinyint").alias("type"), F.lit(None).cast("int").alias("size"),
                     F.lit(None).cast("array<int>").alias("indices"), doubles.alias("values")]
        # A vector column is this struct with a type of its own; reading it from text gives it that type.
        kind = StructType([StructField("v", VectorUDT())])
        vector = F.from_json(F.to_json(F.struct(F.struct(*parts).alias("v"))), kind).getField("v")
        return out.select(*[quoted(c) for c in df.columns if c != self.output_col], vector.alias(self.output_col))

    def feature_table(self) -> DataFrame:
        """F6 as a table: (idx, feature), numeric names first, then ``col_value``."""
        spark = self.dictionary.sparkSession
        numbers = spark.createDataFrame([(i, row[0]) for i, row in enumerate(self.numeric)], "idx long, feature string")
        named = self.dictionary.select("idx", F.concat_ws("_", "column_name", "v").alias("feature"))
        return numbers.unionByName(named)

    def long_features(self, df: DataFrame, row_key: str) -> DataFrame:
        """F5 / F8 in long form: (row_key, feature, value) of every numeric feature and every active indicator.
        The rows are unpivoted once and their categories joined once; values unknown to the dictionary make no row."""
        key = quoted(row_key)
        cells = [F.struct(F.lit(row[0]).alias("feature"), self._number(df, i).alias("value")) for i, row in enumerate(self.numeric)]
        numbers = df.select(key, F.inline(F.array(*cells))) if cells else None
        pairs = [F.struct(F.lit(row[0]).alias("__column"), self._category(df, i).alias("__value")) for i, row in enumerate(self.categorical)]
        if not pairs:
            return numbers
        long = df.select(key, F.inline(F.array(*pairs)))
        known = self.dictionary.select(F.col("column_name").alias("__column"), F.col("v").alias("__value"))
        hits = long.join(known, ["__column", "__value"]).select(
            key, F.concat_ws("_", "__column", "__value").alias("feature"), F.lit(1.0).alias("value"))
        return hits if numbers is None else numbers.unionByName(hits)

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader()


class _EncoderWriter(MLWriter):
    """Metadata with the bounded statistics, and the dictionary as Parquet beside it."""

    def __init__(self, encoder: TableEncoder):
        super().__init__()
        self.encoder = encoder

    def saveImpl(self, path: str) -> None:
        e = self.encoder
        DefaultParamsWriter.saveMetadata(e, path, self.sparkSession, extraMetadata={
            "numeric": e.numeric, "categorical": e.categorical, "output_col": e.output_col})
        e.dictionary.write.mode("overwrite").parquet(f"{path.rstrip('/')}/dictionary")


class _EncoderReader(MLReader):
    def load(self, path: str) -> TableEncoder:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        dictionary = self.sparkSession.read.schema(DICTIONARY_SCHEMA).parquet(f"{path.rstrip('/')}/dictionary")
        out = TableEncoder(meta["numeric"], meta["categorical"], dictionary, meta["output_col"])
        out._resetUid(meta["uid"])
        return out
