"""Structured Streaming over uploads and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import validate
from paperloom.sources import files

#: How late a delivery may come; later ones are not counted.
LATENESS = "2 days"


def read_uploads(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Deliveries that keep arriving as parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def checked(stream: DataFrame) -> DataFrame:
    """Each delivery with its error code. Stateless, so it runs on streams and tables alike."""
    return stream.withColumn("error_code", validate.file_status(F.col("path"), F.col("n_bytes"), F.col("head_bytes")))


def without_copies(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Deliveries without exact copies that come within the lateness."""
    return stream.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["upload_id"])


def per_account(stream: DataFrame, width: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Deliveries and bytes by account and window of their arrival, late ones included up to the lateness."""
    windowed = stream.withWatermark("received_at", lateness).groupBy("account", F.window("received_at", width).alias("w"))
    return windowed.agg(F.count("*").alias("deliveries"), F.sum("n_bytes").alias("bytes")).select("account", F.col("w.start").alias("window_start"), "deliveries", "bytes")


def parsed_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files that keep arriving, scanned as they come."""
    return files.scan_text(files.stream_files(spark, path, "*.txt"))
