"""Streams: windowed counts with late data, and resumable ingestion that writes each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed(events: DataFrame, time: str, by: list[str], width: str, late: str, value: str | None = None) -> DataFrame:
    """Counts (and sums) per window; rows later than the watermark are dropped, windows are final when it has passed."""
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    w = events.withWatermark(time, late) if events.isStreaming else events
    return w.groupBy(F.window(time, width).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("start"), *by, "n", *(["total"] if value else []))


def deduplicated(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark; state is bounded by the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    w = events.withWatermark(time, late) if events.isStreaming else events
    return w.groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def ingest(stream: DataFrame, table: str, checkpoint: str, key: list[str]) -> None:
    """All that is there, in batches, each written to its own folder of the table: a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{table}/batch={epoch:08d}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(result: DataFrame, table: str, checkpoint: str) -> None:
    """An append-mode aggregate as a table, all that is there."""
    result.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
