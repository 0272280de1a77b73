"""Queries of change capture, merges and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changefeed import read_changes
from ..operators.writes import capture_changes, compact_prefix, cut_parts, failure_ledger, merge_newer, run_length
from ..sources.tables import table

#: Cut between the two table versions and cutoff of the log, in the test archive's time.
CUTOFF_MS = 1_760_000_000_000


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.round("o_totalprice", 2).alias("v"))


def cdc_capture(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    before = o.where("s <> 'O'")
    after = o.where("s <> 'F' or v > 1000").withColumn("v", F.when(F.col("s") == "P", F.col("v") + 1).otherwise(F.col("v"))).where("s <> 'P' or v < 100000")
    return capture_changes(before, after, ["k"], "orders")


def cdc_compaction(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "change_log").select("seq", "recorded_at_ms").distinct()
    return compact_prefix(log, "seq", "recorded_at_ms", CUTOFF_MS)


def cdc_changed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Last change of each key by order of arrival."""
    c = read_changes(table(spark, sf, "change_log")).groupBy("table_name", "row_key").agg(F.max_by("live", "seq").alias("live"), F.max("seq").alias("seq"))
    return c.select("table_name", "row_key", "seq", F.when(F.col("live"), "upsert").otherwise("delete").alias("op"))


def cdc_status(spark: SparkSession, sf: str) -> DataFrame:
    c = read_changes(table(spark, sf, "change_log"))
    return c.groupBy("table_name").agg(F.countDistinct("seq").alias("entries"), F.min("seq").alias("floor"), F.max("seq").alias("head"))


def merge_tables_whole(spark: SparkSession, sf: str) -> DataFrame:
    """A second version of every order merged into the first."""
    o = _orders(spark, sf).withColumn("gone", F.when(F.col("s") == "F", F.lit("x")))
    incoming = o.withColumn("version", F.col("k") % 5).withColumn("v", F.col("v") + 1)
    return merge_newer(o.withColumn("version", F.col("k") % 7), incoming, ["k"], "version", "gone").select("k", "version", "v")


def metric_series(spark: SparkSession, sf: str) -> DataFrame:
    """Event types of each user, once per change."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return run_length(e, ["user_id"], "event_id", "event_type")


def failure_report(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return failure_ledger(e, ["user_id", "event_type"], "us")


def delivery_parts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.length("props").alias("bytes"))
    return cut_parts(e, "user_id", "event_id", "bytes", 256).groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


QUERIES = {f.__name__: f for f in (cdc_capture, cdc_compaction, cdc_changed_keys, cdc_status, merge_tables_whole, metric_series, failure_report, delivery_parts)}

_O = "o as (select o_orderkey as k, o_orderstatus as s, round(o_totalprice, 2) as v from orders)"
_C = r"""c as (select lower(regexp_replace(table_name, '^\s+|\s+$', '', 'g')) as table_name, from_json(case when json_valid(row_key) and json_type(row_key) = 'ARRAY' then row_key end, '["VARCHAR"]') as k, recorded_at_ms as ms, seq, lower(regexp_replace(op, '^\s+|\s+$', '', 'g')) as op from change_log),
v as (select table_name, to_json(k)::varchar as row_key, ms, seq, op not in ('d', 'delete') as live from c where k is not null and table_name <> '' and ms is not null and op in ('i', 'insert', 'u', 'update', 'd', 'delete'))"""
SQL = {
    "cdc_capture": f"with {_O}, b as (select * from o where s <> 'O'), a as (select k, s, case when s = 'P' then v + 1 else v end as v from o where s <> 'F' or v > 1000), a2 as (select * from a where s <> 'P' or v < 100000) select 'orders' as table_name, case when b.k is null then 'i' when a2.k is null then 'd' else 'u' end as op, '[\"' || coalesce(a2.k, b.k) || '\"]' as row_key from b full join a2 on a2.k = b.k where b.k is null or a2.k is null or (a2.s, a2.v) is distinct from (b.s, b.v)",
    "cdc_compaction": f"select distinct seq, recorded_at_ms from change_log where seq >= (select min(seq) from change_log where recorded_at_ms >= {CUTOFF_MS})",
    "cdc_changed_keys": f"with {_C} select table_name, row_key, max(seq) as seq, case when arg_max(live, seq) then 'upsert' else 'delete' end as op from v group by 1, 2",
    "cdc_status": f"with {_C} select table_name, count(distinct seq) as entries, min(seq) as floor, max(seq) as head from v group by 1",
    "merge_tables_whole": f"with {_O}, x as (select k, k % 7 as version, v, s = 'F' as gone, 0 as new from o union all select k, k % 5, v + 1, s = 'F', 1 from o) select k, version, v from x qualify row_number() over (partition by k order by gone and new = 0 desc, version desc, gone desc, new) = 1",
    "metric_series": "select user_id, event_id, event_type from events window w as (partition by user_id order by event_id) qualify row_number() over w = 1 or event_type is distinct from lag(event_type) over w",
    "failure_report": "select user_id, event_type, epoch_us(min(ts)) as first_seen, epoch_us(max(ts)) as last_seen, count(*) - 1 as retry_count from events where event_type = 'error' group by 1, 2",
    "delivery_parts": "with x as (select user_id, length(props) as bytes, (sum(length(props)) over (partition by user_id order by event_id rows unbounded preceding)::bigint - 1) // 256 as part from events) select user_id, part, count(*) as n, sum(bytes)::bigint as bytes from x group by 1, 2",
}
