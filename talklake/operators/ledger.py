"""Ledger of failures: recorded under their identity, reopened when they come again, resolved, replayed, pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns that make up a failure's identity.
IDENTITY = ["operation", "source", "guild_id", "channel_id", "message_id", "related_kind", "related_id"]
#: Resolved failures are kept this long.
KEPT_US = 90 * 86_400_000_000


def record(failures: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Ledger rows of failures (identity, us, error_class) and resolutions (any of the identity, null for any, us).

    One row per identity: first_seen_us, last_seen_us, the last error_class, retry_count (how often it came again) and
    resolved_us, the first resolution at or after the last failure, null while it is open. Null ids are empty.
    """
    f = failures.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in IDENTITY], "us", "error_class").where("operation <> '' and source <> ''")
    out = f.groupBy(*IDENTITY).agg(F.min("us").alias("first_seen_us"), F.max("us").alias("last_seen_us"), F.max_by("error_class", F.struct("us", "error_class")).alias("error_class"), (F.count(F.lit(1)) - 1).alias("retry_count"))
    if resolutions is None:
        return out.withColumn("resolved_us", F.lit(None).cast("long"))
    # resolutions name operation and source, and any of the other columns
    r = resolutions.select(*IDENTITY[:2], *[F.col(c).alias(f"_{c}") for c in IDENTITY[2:]], F.col("us").alias("_us"))
    fits = [F.col(f"_{c}").isNull() | (F.col(f"_{c}") == "") | (F.col(f"_{c}") == F.col(c)) for c in IDENTITY[2:]]
    cond = F.col("_us") >= F.col("last_seen_us")
    for x in fits:
        cond = cond & x
    j = out.join(r, IDENTITY[:2]).where(cond).groupBy(*IDENTITY).agg(F.min("_us").alias("resolved_us"))
    return out.join(j, IDENTITY, "left")


def replay_candidates(ledger: DataFrame, limit: int, source: str | None = None, after: int | None = None) -> DataFrame:
    """Open failures, those seen last the longest ago first; `after` continues behind that instant."""
    open_ = ledger.where("resolved_us is null")
    open_ = open_ if source is None else open_.where(F.col("source") == source)
    open_ = open_ if after is None else open_.where(F.col("last_seen_us") > after)
    return open_.orderBy("last_seen_us", *IDENTITY).limit(limit)


def prune(ledger: DataFrame, now_us: int, kept_us: int = KEPT_US) -> DataFrame:
    """The ledger without failures that were resolved too long ago."""
    return ledger.where(F.col("resolved_us").isNull() | (F.col("resolved_us") >= now_us - kept_us))
