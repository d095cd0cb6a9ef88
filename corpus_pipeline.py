"""The corpus pipeline: documents in, token ids of the mixed, cleaned corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrig.llm import common, linededup, mixing, neardup, pieces, toxicity


#: Rows in a batch that goes to a Python worker. A batch is held several times over (as rows and as columns in the JVM,
#: as columns and as strings in the worker), and documents are long.
BATCH_ROWS = 1000


def _bounded_batches(stage):
    """The stage, run with batches of at most ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(key))
        spark.conf.set(key, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@_bounded_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on ``labels``, does not reject."""
    return toxicity.reject_toxic(docs, common.table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are equal, at any length, or near-equal (one edit from 16 characters on, two
    from 100, four from 200), to an earlier one; a document all of whose lines go is dropped."""
    return linededup.dedup_lines(docs, classes=linededup.CLASSES, equal_chars=linededup.EQUAL_CHARS)


@_bounded_batches
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, 0.8)."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each copy that the mix takes, in its order."""
    return mixing.mix(docs)


@_bounded_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of the text that they decode to."""
    out = pieces.encode(docs, pieces.default_model())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Training, hashing and tokenization have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
