"""An extension beyond the batch engine: event streams into the same panels, with watermarks and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, at: str, keys: list[str], value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per key and tumbling window; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def upsert_panel(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Appends closed windows to a parquet panel; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
