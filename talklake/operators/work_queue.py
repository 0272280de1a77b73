"""Queue of work on messages, such as embedding them: what to do, leases, results that may be stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Guild of direct messages, which stay local; fixed value.
LOCAL = "@me"


def enqueue(jobs: DataFrame, messages: DataFrame, now_us: int) -> DataFrame:
    """Jobs (message_id, state, revision, priority, attempts, input_sha, available_us) after a look at the messages.

    messages: id, guild_id, text, deleted. A message without a job, or whose text isn't the job's, is pending with a new
    revision; jobs of deleted, local and missing messages are dropped. Null texts are empty.
    """
    m = messages.where((F.col("guild_id") != LOCAL) & ~F.col("deleted")).select(F.col("id").alias("message_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"))
    j = m.join(jobs, "message_id", "left")
    new = F.col("state").isNull() | ~F.col("input_sha").eqNullSafe(F.col("_sha"))
    return j.select(
        "message_id",
        F.when(new, "pending").otherwise(F.col("state")).alias("state"),
        F.when(new, F.coalesce(F.col("revision") + 1, F.lit(1))).otherwise(F.col("revision")).cast("long").alias("revision"),
        F.when(F.col("state").isNull(), 0).when(new, 1).otherwise(F.col("priority")).alias("priority"),
        F.when(new, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.col("_sha").alias("input_sha"),
        F.when(new, F.lit(now_us)).otherwise(F.col("available_us")).alias("available_us"),
    )


def claim(jobs: DataFrame, now_us: int, limit: int, priority: int | None = None) -> DataFrame:
    """The next pending jobs that are available and not leased, oldest first; jobs may carry lease_until_us."""
    free = jobs.where((F.col("state") == "pending") & (F.col("available_us") <= now_us))
    free = free.where(F.coalesce("lease_until_us", F.lit(0)) <= now_us) if "lease_until_us" in jobs.columns else free
    free = free if priority is None else free.where(F.col("priority") == priority)
    return free.orderBy("available_us", "message_id").limit(limit)


def settle(jobs: DataFrame, results: DataFrame, messages: DataFrame, most_chars: int, now_us: int, most_attempts: int = 3) -> DataFrame:
    """Jobs after results (message_id, revision, input, ok) came in; `outcome` says what became of each.

    A result of another revision than the job's counts for nothing. A message that is gone takes its job along: dropped.
    A result whose input isn't the message's present text, cut to most_chars code points, is stale: pending again with a
    new revision. A failure counts an attempt, and the job is failed at most_attempts. Without a result a job stays.
    """
    m = messages.where((F.col("guild_id") != LOCAL) & ~F.col("deleted")).select(F.col("id").alias("message_id"), F.substring(F.coalesce("text", F.lit("")), 1, most_chars).alias("_text"))
    r = results.dropDuplicates(["message_id", "revision"]).select("message_id", "revision", F.col("input").alias("_input"), F.col("ok").alias("_ok"))
    j = jobs.join(r, ["message_id", "revision"], "left").join(m, "message_id", "left")
    outcome = (
        F.when(F.col("_ok").isNull(), "waiting").when(F.col("_text").isNull(), "dropped").when(~F.col("_ok") & (F.col("attempts") + 1 >= most_attempts), "failed").when(~F.col("_ok"), "retry").when(F.col("_input") != F.col("_text"), "stale").otherwise("done")
    )
    j = j.withColumn("outcome", outcome).where("outcome <> 'dropped'")
    return j.select(
        "message_id",
        F.when(F.col("outcome").isin("done", "failed"), F.col("outcome")).otherwise(F.col("state")).alias("state"),
        (F.col("revision") + (F.col("outcome") == "stale").cast("int")).alias("revision"),
        F.when(F.col("outcome").isin("retry", "failed"), F.col("attempts") + 1).when(F.col("outcome") == "done", 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(F.col("outcome").isin("stale", "retry"), F.lit(now_us)).otherwise(F.col("available_us")).alias("available_us"),
        "outcome",
    )
