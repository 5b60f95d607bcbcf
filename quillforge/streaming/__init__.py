"""Structured Streaming forms: incremental scoring, resumed keys, live metric series and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import documents


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream over Parquet with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def idempotent_sink(rows: DataFrame, path: str, checkpoint: str, keys: list[str], time: str | None = None, late: str = "1 day"):
    """One row a key, however often and in however many batches it arrives; a batch that is repeated overwrites its own folder.

    With a time column, keys are remembered for ``late`` (bounded state); a key that comes again later than that is a new
    one. Without one, each batch is held against what earlier batches have written.
    """
    if time:
        rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(keys)
        if not time and epoch:
            before = [f"{path}/batch={k}" for k in range(epoch) if documents.exists(batch.sparkSession, f"{path}/batch={k}")]
            if before:
                done = batch.sparkSession.read.parquet(*before).select(*keys)
                new = new.join(done, keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run an append-mode stream to its end into Parquet."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed(events: DataFrame, time: str, late: str, width: str, value: str, *keys: str) -> DataFrame:
    """Counts and sums per time window, closed by a watermark."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
        .select(F.col("w.start").alias("window_start"), *keys, "n", "total")
    )


def collected(rows: DataFrame, reduce: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Partial aggregates per micro-batch, appended; the reader merges them."""

    def write(batch: DataFrame, epoch: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
