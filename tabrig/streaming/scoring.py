"""Scoring arriving rows with a saved pipeline (F8 + S3 on a stream).

The reference has no streaming operators; its one path that applies to a
stream is the plain transform of new rows by a fitted preprocessor and model
(without the deduplication step, which would need unbounded state). This
module wires that transform into Structured Streaming: read new files from a
folder, apply the saved ``PipelineModel`` and write predictions out.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def score_stream(stream: DataFrame, model: PipelineModel, keep: list[str]) -> DataFrame:
    """Apply a fitted pipeline to a streaming DataFrame (stateless, so any
    output mode and any number of executors work)."""
    out = model.transform(stream)
    cols = [c for c in keep if c in out.columns] + ["prediction"]
    if "probability" in out.columns:
        from pyspark.ml.functions import vector_to_array
        out = out.withColumn("score", vector_to_array(F.col("probability"))[1])
        cols.append("score")
    return out.select(*cols)


def start_scoring(spark: SparkSession, source_dir: str, schema, model_path: str, sink_dir: str,
                  checkpoint_dir: str, keep: list[str], trigger_once: bool = True):
    """Read parquet files arriving in ``source_dir``, score them and append to
    ``sink_dir``; the checkpoint folder makes the query restartable."""
    model = PipelineModel.load(model_path)
    stream = spark.readStream.schema(schema).parquet(source_dir)
    writer = (score_stream(stream, model, keep).writeStream.format("parquet")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()
