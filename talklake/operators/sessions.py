"""Sessions of an entity's events, separated by inactivity, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release

#: Half an hour in microseconds.
GAP_US = 30 * 60 * 1_000_000


def sessionise(events: DataFrame, key: str, at_us: str, gap_us: int = GAP_US, distinct: str | None = None) -> DataFrame:
    """Sessions per key: (key, start_us, end_us, duration_us, n_events[, n_distinct]).

    A session goes on while an event follows the key's previous one by at most gap_us. Events are first gathered in
    slots as wide as the gap: all events of a slot belong together, and only neighbouring slots can be linked. Each slot
    points to its predecessor if first and last instant are within the gap; the pointers are then joined with
    themselves until every one names a root, and the slots are aggregated by root. Slots come out of a map-side
    aggregation, so a key with a third of all events is spread over its slots, and rounds grow with the
    logarithm of the longest session.

    Rows without key (null or empty) or instant are in no session. Repeated events count; events at the same instant
    share a session. An empty input gives an empty result. Other columns are ignored.
    """
    if gap_us <= 0:
        raise ValueError("the gap must be positive")
    e = events.select(F.col(key).alias("_k"), F.col(at_us).alias("_t"), *([F.col(distinct).alias("_d")] if distinct else []))
    e = e.where((F.col("_k") != "") & F.col("_t").isNotNull())
    e = e.withColumn("_slot", F.expr(f"(_t - pmod(_t, {gap_us}L)) div {gap_us}L"))
    slots = materialise(e.groupBy("_k", "_slot").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n")), "slots")
    before = slots.select("_k", (F.col("_slot") + 1).alias("_slot"), F.col("_hi").alias("_prev"))
    links = slots.select("_k", "_slot", "_lo").join(before, ["_k", "_slot"]).where(F.col("_lo") - F.col("_prev") <= gap_us)
    # a pointer of a slot without a link is missing: such a slot is a root
    ptr = materialise(links.select("_k", "_slot", (F.col("_slot") - 1).alias("_ptr")), "pointers")
    while True:
        step = ptr.select("_k", F.col("_slot").alias("_ptr"), F.col("_ptr").alias("_next"))
        doubled = ptr.join(step, ["_k", "_ptr"], "left").select("_k", "_slot", F.coalesce("_next", "_ptr").alias("_ptr"), F.col("_next").isNotNull().alias("_moved"))
        doubled = materialise(doubled, "pointers")
        moved = not doubled.where("_moved").isEmpty()
        release(ptr)
        ptr = doubled.drop("_moved")
        ptr._talklake_path = doubled._talklake_path
        if not moved:
            break
    rooted = slots.join(ptr, ["_k", "_slot"], "left").withColumn("_root", F.coalesce("_ptr", "_slot"))
    out = rooted.groupBy("_k", "_root").agg(F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"), F.sum("_n").alias("n_events"))
    extra: list[Column] = []
    if distinct:
        seen = e.where(F.col("_d").isNotNull()).groupBy("_k", "_slot", "_d").agg(F.lit(1).alias("_one"))
        seen = seen.join(ptr, ["_k", "_slot"], "left").withColumn("_root", F.coalesce("_ptr", "_slot"))
        seen = seen.groupBy("_k", "_root").agg(F.countDistinct("_d").alias("n_distinct"))
        out = out.join(seen, ["_k", "_root"], "left")
        extra = [F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")]
    return out.select(F.col("_k").alias(key), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events", *extra)
