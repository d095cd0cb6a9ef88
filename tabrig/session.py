"""Session helpers: a sensible local session for tests/bench and the shared
work folder used to cut lineage or stage files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tabrig", extra: dict | None = None) -> SparkSession:
    """Local session with AQE on, UI off and UTC time (tests and bench only;
    on a cluster use the session you are given)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("TABRIG_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is read from the session; only
    when it is unset on a local master (tests) a scratch folder is created and
    registered. On a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            # A machine-local folder would not survive an executor loss.
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder (HDFS, object store) "
                               "before running jobs that cut lineage.")
        base = tempfile.mkdtemp(prefix="tabrig-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    base = base.rstrip("/")
    return f"{base}/{name or 'work'}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (survives executor loss).
    The input is kept in memory/disk while it is written so that the plan is
    computed once, not once for the count and again for the write."""
    from pyspark import StorageLevel
    shared_dir(df.sparkSession)  # makes sure a checkpoint dir is registered
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=eager)
    finally:
        if eager:
            held.unpersist()


def written(df, name: str):
    """``df`` written once into the shared folder as Parquet and read from there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_id(df, name: str = "_row_id"):
    """``df`` with a unique row number, written once into the shared folder: generated
    numbers depend on the partitioning of the run that made them, so every later use
    must read the same ones."""
    from pyspark.sql import functions as F
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))
