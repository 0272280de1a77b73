"""Current row of each id among copies and outdated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_us


def current_rows(df: DataFrame, columns: dict[str, Column], key: str = "id", updated: str = "updated_at") -> DataFrame:
    """One row per key, one with the latest instant in `updated`; rows of that instant are copies of each other.

    `columns` are computed before the exchange, so only what the caller needs is moved. The rank filter is pushed
    below the exchange as a group limit, so a key with very many copies sends one row per task. Rows without a key
    are no records and are left out; a row whose instant can't be read counts as oldest. Copies that differ all the
    same are settled by the smallest hash of the kept columns, so the result doesn't depend on the order of rows.
    """
    out = df.select(F.trim(F.col(key)).alias("_key"), F.coalesce(instant_us(updated), F.lit(-(2**62))).alias("_at"), *[c.alias(n) for n, c in columns.items()])
    out = out.where(F.col("_key").isNotNull() & (F.col("_key") != ""))
    w = Window.partitionBy("_key").orderBy(F.col("_at").desc(), F.xxhash64(*[F.col(n) for n in columns]) if columns else F.lit(0))
    return out.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_at").withColumnRenamed("_key", key)
