"""Scoring of incoming applications as a stateless Structured Streaming
query (the one-applicant form re-aimed at a stream).

``readStream`` with a fixed schema -> the live formulas and the fitted
models (the same map-only ``score`` function as batch) -> ``writeStream``
append to parquet: the result, the models' votes and the score's band, as the
live page shows them. Fitted models are loaded once on the driver when the
query is defined and shipped with the tasks. The checkpoint location must be
a shared folder: a query that stopped or failed in the middle of a batch is
started again with the same arguments and goes on from there, and the sink's log
of finished batches keeps each application once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loanlens.plans.models import Bundle
from loanlens.plans.score import LIVE_COLUMNS, score_with_models, with_votes


def start_scoring_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                         bundle: Bundle, sink_dir: str, checkpoint_dir: str,
                         key: str = "RespondentID", fmt: str = "parquet",
                         available_now: bool = False,
                         processing_time: str | None = "10 seconds",
                         files_per_batch: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    scored = with_votes(score_with_models(reader.load(source_dir), bundle, mode="live"))
    out_cols = [c for c in [key] if c in schema.fieldNames()] + LIVE_COLUMNS
    writer = (scored.select(*out_cols).writeStream.format("parquet")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
              .outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
