"""Records that arrive continuously: nested records into flat tables, late duplicates dropped, counts by window.

Structured Streaming over the same operators as the batch plans; state is bounded by watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.shred import DOSSIER, Level, shred


def record_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """(raw_id, payload, recu_at) as Parquet files that arrive in a folder."""
    return spark.readStream.schema("raw_id BIGINT, payload STRING, recu_at TIMESTAMP").option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(stream: DataFrame, key: str = "raw_id", time: str = "recu_at", delay: str = "1 day") -> DataFrame:
    """Rows whose key wasn't seen inside the delay; later copies than that count as new."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, kind: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(start, kind, n): rows in each window; a window closes when the watermark has passed it."""
    agg = stream.withWatermark(time, delay).groupBy(F.window(time, width), F.col(kind)).agg(F.count("*").alias("n"))
    return agg.select(F.col("window.start").alias("start"), kind, "n")


def shred_stream(stream: DataFrame, level: Level = DOSSIER) -> DataFrame:
    """The flat rows of all levels; shredding keeps no state, so it streams as it is."""
    return shred(stream, level=level)


def write_tables(shredded: DataFrame, path: str, checkpoint: str, once_only: bool = True):
    """A query that appends each batch to one folder for each level; a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("niveau", "batch_id").parquet(path)

    writer = shredded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_only else writer).start()
