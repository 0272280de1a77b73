"""Archive tables as Parquet under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of the archive in `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
