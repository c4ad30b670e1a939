"""Streams: engine messages as they come, windows of events, and a stack that grows frame by frame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightloom.sources import messages


def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Typed messages of the text files that arrive in a folder."""
    return messages.parsed(spark.readStream.text(folder).withColumnRenamed("value", "line"))


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Events by tumbling window and type; what comes later than the watermark is left out."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def running_stack(pixels: DataFrame) -> DataFrame:
    """Sums and counts by pixel: what a live stack's mean is made of; works on a stream (update mode) and on a table."""
    return pixels.groupBy("channel", "y", "x").agg(F.sum("v").alias("total"), F.count("v").alias("n"))


class LiveStack:
    """Folds micro-batches of pixels into a stored table of sums, one version for each batch.

    A batch that is run again after a failure starts from the version before it, so it counts once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _version(self, n: int) -> str:
        return f"{self.folder}/v{n}"

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        sums = running_stack(batch)
        if batch_id > 0 and self._exists(batch_id - 1):
            sums = sums.unionByName(batch.sparkSession.read.parquet(self._version(batch_id - 1))).groupBy("channel", "y", "x").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(self._version(batch_id))
        self.latest = batch_id

    def _exists(self, n: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self._version(n), "_SUCCESS"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def image(self) -> DataFrame:
        return self.spark.read.parquet(self._version(self.latest)).select("channel", "y", "x", (F.col("total") / F.col("n")).alias("v"))
