"""A store of finished reports, keyed by content, role and engine version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import paperloom


def cache_key(content: Column, role: Column | None = None) -> Column:
    role = F.coalesce(role, F.lit("")) if role is not None else F.lit("")
    return F.sha2(F.concat_ws("|", F.sha2(content, 256), F.lower(F.trim(role)), F.lit(paperloom.__version__)), 256)


def lookup(wanted: DataFrame, cached: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Rows whose report is there already, with it, and rows that must be worked out."""
    usable = cached.where(F.try_parse_json("report").isNotNull()).select(key, "report").dropDuplicates([key])
    return wanted.join(usable, key), wanted.join(usable, key, "left_anti")


def write(reports: DataFrame, path: str, key: str = "cache_key") -> None:
    """Appends reports (key, report as JSON text), in buckets of their keys' first characters."""
    reports.select(key, "report", F.substring(key, 1, 1).alias("part")).write.mode("append").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clear(spark: SparkSession, path: str, key: str = "cache_key") -> None:
    """Empties the store; it stays readable."""
    spark.createDataFrame([], f"{key} string, report string, part string").write.mode("overwrite").parquet(path)


def export_json(reports: DataFrame, path: str) -> None:
    """Whole rows as JSON lines."""
    reports.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
