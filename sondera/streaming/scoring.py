"""Streaming extension: items that arrive as files are scored against a fixed bank, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vectors
from ..operators import search

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def score_stream(spark: SparkSession, source: str, bank: DataFrame, sink: str, checkpoint: str, files_per_trigger: int = 16) -> StreamingQuery:
    """Reads new Parquet files of (vec_id, embedding, label) once each and writes (vec_id, bank_id, distance, batch) under the sink,
    one folder per batch, so that a batch that is run again replaces itself. Stops when all files there are done."""

    def write(batch: DataFrame, number: int) -> None:
        found = search.nearest(batch.select("vec_id", F.col("embedding").cast("array<double>")), bank, 1)
        out = found.select(F.col("query_id").alias("vec_id"), "bank_id", vectors.distance(F.col("similarity")).alias("distance"), F.lit(number).alias("batch"))
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; works on a stream and on a table."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
