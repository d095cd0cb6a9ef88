"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrig.session import shared_dir

#: A word: a run of characters other than blank, tab, line feed, vertical tab,
#: form feed and carriage return (the same in Python, Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole input row as struct ``row`` beside the given working columns, so
    that working columns cannot clash with columns of the input."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("row"),
                     *[c.alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Back from ``row`` to the input's columns, in their order."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` once into the shared folder (``spark.checkpoint.dir``) and
    reads it back: cuts the lineage, survives lost executors, and makes every
    later use see the same rows."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sql_crc_table() -> str:
    """DuckDB SQL for the 256 remainders of CRC-32 as one list ``t``, made from its polynomial."""
    return ("SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), "
            "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))")


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8, beside the list ``t`` of ``sql_crc_table``."""
    code = f"hex(encode({text}))"
    value = f"CAST('0x' || substr({code}, 2 * i + 1, 2) AS BIGINT)"
    octets = f"list_transform(range(strlen({text})), lambda i: {value})"
    return (f"xor(list_reduce(list_prepend(4294967295, {octets}), "
            "lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)")
