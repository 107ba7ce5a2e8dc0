"""Structured Streaming forms of cloud ingestion. Nothing here depends on event time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.plans import ingest


def file_stream(
    spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16, name_filter: str | None = None
) -> DataFrame:
    """New parquet files of a folder, a bounded number of them per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def start_ingest(
    stream: DataFrame, config: ingest.IngestConfig, target: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Transform arriving points row by row and append them to a parquet folder."""
    writer = (
        ingest.place(stream, config)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_counts(
    stream: DataFrame, by: Sequence[str] = ("class",), kept: Column | None = None
) -> DataFrame:
    """Seen and kept rows per class so far; the state is one row per class."""
    hit = F.lit(True) if kept is None else kept
    return stream.groupBy(*by).agg(F.count("*").alias("n_original"), F.count_if(hit).alias("n_kept"))


def start_counts(
    counts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Hand the complete table of counts to ``sink`` after each micro-batch."""
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_sampled_ingest(
    stream: DataFrame, config: ingest.IngestConfig, target: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Down-sample each micro-batch on its own, then transform and store it.

    Each batch has a folder of its own that a retried batch overwrites, so a
    restart neither repeats nor loses rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        ingest.ingest(batch, config).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
