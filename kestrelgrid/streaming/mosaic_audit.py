"""Mosaic audits as dates arrive: new pixel files are aggregated by date and their audit rows appended.

An extension beside the batch operators: a date's pixels arrive together in files of their own, and each
date's audit row is written once it is past the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.pixels import coverage_status, token_date, vegetation_index

SCHEMA = "date_str string, pixel_y int, pixel_x int, ndvi_raw int, qa int"


def audit_stream(pixels: DataFrame, total_pixels: int, late: str = "32 days") -> DataFrame:
    """Per date of a stream of SCHEMA: valid pixels, mean, status. A date is closed once later dates are ``late`` past it."""
    at = token_date(F.col("date_str")).cast("timestamp").alias("at")
    rows = pixels.select(at, vegetation_index(F.col("ndvi_raw"), F.col("qa")).alias("value")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", "1 day").alias("day")).agg(F.count("value").alias("valid_pixels"), F.avg("value").alias("ndvi_mean"))
    return out.select(F.col("day.start").cast("date").alias("date"), "valid_pixels", "ndvi_mean", coverage_status(F.col("valid_pixels"), F.lit(float(total_pixels))).alias("status"))


def append_audit(spark: SparkSession, source: str, target: str, checkpoint: str, total_pixels: int, late: str = "32 days") -> StreamingQuery:
    """Reads what is new below ``source`` and appends closed dates to the Parquet table ``target``, exactly once."""
    pixels = spark.readStream.schema(SCHEMA).parquet(source)
    out = audit_stream(pixels, total_pixels, late)
    return out.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
