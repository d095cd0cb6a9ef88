"""Query registry: each entry pairs a Spark callable (spark, sf_dir) -> DataFrame
with its DuckDB oracle SQL. Float columns listed in ``rounded`` are rounded to
the same number of decimals on both sides so that summation order cannot
change the compared value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECIMALS = 6


@dataclass
class Check:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounded: tuple[str, ...] = ()
    decimals: int = DECIMALS


REGISTRY: dict[str, Check] = {}


def register(name: str, sql: str | None = None, rounded: tuple[str, ...] | list[str] = (),
             decimals: int = DECIMALS):
    def deco(fn):
        REGISTRY[name] = Check(name, fn, sql, tuple(rounded), decimals)
        return fn
    return deco


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    chk = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = chk.fn(spark, sf_dir)
        if chk.rounded:
            df = df.select(*[F.round(F.col(c), chk.decimals).alias(c) if c in chk.rounded else F.col(c)
                             for c in df.columns])
        return df
    run.__name__ = name
    return run


def oracle(name: str) -> str | None:
    chk = REGISTRY[name]
    if chk.sql is None:
        return None
    if not chk.rounded:
        return chk.sql
    repl = ", ".join(f"round(\"{c}\", {chk.decimals}) AS \"{c}\"" for c in chk.rounded)
    return f"SELECT * REPLACE ({repl}) FROM (\n{chk.sql}\n) AS _q"
