"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
