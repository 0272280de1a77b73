"""Batch write semantics: keep-newer merge, change capture, compaction, run-length series, failure ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_newer(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str, tombstone: str) -> DataFrame:
    """Rows after a merge: a stored tombstone stays whatever comes; otherwise the greater version wins; at equal versions a
    tombstone beats none, else the stored row stays.

    A null version is older than any. Rows with a null key are kept as they are on either side.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc((F.col("_new") == 0) & F.col(tombstone).isNotNull()), F.desc_nulls_last(version), F.desc(F.col(tombstone).isNotNull()), "_new")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def capture_changes(before: DataFrame, after: DataFrame, keys: list[str], table_name: str) -> DataFrame:
    """(table_name, op, row_key) between two versions of a table with unique keys; equal rows, nulls included, give none."""
    rest = [c for c in before.columns if c not in keys]
    b = before.select(*keys, F.struct(*rest).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(*keys, F.struct(*rest).alias("_a"), F.lit(True).alias("_in_a"))
    j = b.join(a, keys, "full_outer")
    op = F.when(F.col("_in_b").isNull(), "i").when(F.col("_in_a").isNull(), "d").when(~F.col("_a").eqNullSafe(F.col("_b")), "u")
    return j.select(F.lit(table_name).alias("table_name"), op.alias("op"), F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).alias("row_key")).where("op is not null")


def compact_prefix(log: DataFrame, seq: str, at: str, cutoff: int) -> DataFrame:
    """The log without its longest prefix, by seq, of entries older than the cutoff."""
    first = log.where(F.col(at) >= cutoff).agg(F.min(seq)).first()[0]
    return log.where(F.col(seq) >= first) if first is not None else log.limit(0)


def run_length(series: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Observations whose value differs, nulls compared as values, from the one before within keys."""
    w = Window.partitionBy(*keys).orderBy(at)
    p = series.withColumn("_p", F.lag(F.struct(value)).over(w))
    return p.where(F.col("_p").isNull() | ~F.struct(value).eqNullSafe(F.col("_p"))).drop("_p")


def failure_ledger(failures: DataFrame, identity: list[str], at: str) -> DataFrame:
    """One row per identity: first and last time seen and how often it came again."""
    return failures.groupBy(*identity).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), (F.count(F.lit(1)) - 1).alias("retry_count"))


def cut_parts(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Each row's part when a group's rows, in order, are cut where the running size passes a multiple of `most`."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.floor((F.sum(size).over(w) - 1) / most))
