"""Rasters kept up to date from a stream of events.

Counts by cell and event-time window are a watermarked streaming aggregation; each finished window is a
raster in the engine's form, which any operator takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_raster(events: DataFrame, time: str, row: Column, col: Column, window: str, delay: str) -> DataFrame:
    """start, row, col, value: events of each cell in each window; late ones beyond ``delay`` are dropped."""
    return (
        events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
        .groupBy(F.window("_t", window).alias("w"), row.cast("int").alias("row"), col.cast("int").alias("col"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.col("w.start").alias("start"), "row", "col", "value")
    )


def run_on_rasters(raster: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply ``operator`` to the raster rows of each micro-batch and append its result as Parquet.

    A batch that is run again overwrites its own folder, so each appears once.
    """

    def each(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return raster.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
