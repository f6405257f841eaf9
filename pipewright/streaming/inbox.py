"""Territories dropped into a folder are inspected as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipewright.sources import geojson


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of path, file_size, value, arrived: a row for each new file."""
    stream = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), "value", F.col("_metadata.file_modification_time").alias("arrived"))


def inspect_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the inspection of each new file to Parquet in out; a batch is written as a whole and again if it failed."""
    def batch(df: DataFrame, number: int) -> None:
        geojson.inspect(geojson.parse(df)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_by_hour(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Files and bytes by hour of arrival, with a watermark so that old hours are closed."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
