"""Current tables written once and read by all queries, instead of being derived from the raw archive each time.

A table is kept per folder, clustered by month and instant where it has one, so that a report's window prunes partitions and
row groups, and its filters reach the scan. It is written again when a file of the raw table has changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fingerprint, remove, work_path

_KEPT: dict[tuple, tuple[str, str]] = {}


def maintained(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], at: str | None = None) -> DataFrame:
    """Table `name` of the archive in `folder`, in its current state; `at` is the instant it is clustered by.

    With `at`, the table has a column month, text `yyyy-MM`, null where there is no instant.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    state = fingerprint(spark, f"{folder}/{name}.parquet")
    path, seen = _KEPT.get(key, ("", ""))
    if seen != state:
        if path:
            remove(spark, path)
        path = work_path(spark, f"current-{name}")
        df = build()
        if at:
            df = df.withColumn("month", F.date_format(at, "yyyy-MM")).hint("rebalance", "month").sortWithinPartitions("month", at)
            df.write.partitionBy("month").parquet(path)
        else:
            df.write.parquet(path)
        _KEPT[key] = (path, state)
    kept = spark.read.parquet(path)
    return kept.withColumn("month", F.col("month").cast("string")) if at else kept
