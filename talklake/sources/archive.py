"""The archive's tables in their current state, with typed helper columns."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import instant, instant_us, none_if_empty, reference
from ..operators.current import current_rows
from .maintained import maintained
from .tables import table


class Archive:
    """Current tables of one folder, kept by maintained(); nothing is read or written before a query uses it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def guilds(self) -> DataFrame:
        g = table(self.spark, self.folder, "guilds")
        return g.select("id", "name", "icon", "updated_at", none_if_empty("deleted_at").alias("deleted_at"))

    @cached_property
    def channels(self) -> DataFrame:
        columns = {c: F.col(c) for c in ("kind", "name", "topic", "position", "is_archived", "collection_scope")}
        columns |= {"guild_id": F.trim("guild_id"), "parent_id": reference("parent_id"), "deleted_at": none_if_empty("deleted_at")}
        return maintained(self.spark, self.folder, "channels", lambda: current_rows(table(self.spark, self.folder, "channels"), columns))

    @cached_property
    def members(self) -> DataFrame:
        """Latest observation of each member."""
        columns = ("username", "global_name", "display_name", "nick", "bot", "joined_at", "role_ids_json", "deleted_at")
        m = table(self.spark, self.folder, "members").where("trim(guild_id) <> '' and trim(user_id) <> ''")
        kept = F.struct(*[(none_if_empty(c) if c != "bot" else F.col(c)).alias(c) for c in columns])
        latest = lambda: m.groupBy(F.trim("guild_id").alias("guild_id"), F.trim("user_id").alias("user_id")).agg(F.max_by(kept, F.struct(F.coalesce(instant_us("updated_at"), F.lit(-(2**62))), F.xxhash64("raw_json"))).alias("s"))
        return maintained(self.spark, self.folder, "members", lambda: latest().select("guild_id", "user_id", "s.*"))

    @cached_property
    def messages(self) -> DataFrame:
        columns = {
            "guild_id": F.trim("guild_id"),
            "channel_id": F.trim("channel_id"),
            "author_id": none_if_empty(F.trim("author_id")),
            "reply_id": reference("reply_to_message_id"),
            "ts": instant("created_at"),
            "deleted": none_if_empty("deleted_at").isNotNull(),
            "content": F.col("content"),
            "normalized_content": F.col("normalized_content"),
            "pinned": F.col("pinned"),
            "has_attachments": F.col("has_attachments"),
        }
        return maintained(self.spark, self.folder, "messages", lambda: current_rows(table(self.spark, self.folder, "messages"), columns), at="ts")

    @cached_property
    def attachments(self) -> DataFrame:
        """Attachments, taken from lineitem: one per order line."""
        a = table(self.spark, self.folder, "lineitem")
        return a.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("attachment_id"),
            F.col("l_orderkey").cast("string").alias("message_id"),
            F.concat_ws(".", "l_returnflag", "l_linestatus").alias("filename"),
            F.col("l_quantity").cast("long").alias("size"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        """Mention events, taken from lineitem and part."""
        x = table(self.spark, self.folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
        p = table(self.spark, self.folder, "part").select("p_partkey", "p_brand")
        o = table(self.spark, self.folder, "orders").select("o_orderkey", "o_custkey")
        j = x.join(p, x.l_partkey == p.p_partkey).join(o, x.l_orderkey == o.o_orderkey)
        return j.select(
            F.col("l_orderkey").cast("string").alias("message_id"),
            F.pmod("o_custkey", F.lit(25)).cast("string").alias("channel_id"),
            F.when(F.col("l_linenumber") % 2 == 0, "user").otherwise("role").alias("target_type"),
            F.col("p_brand").alias("target_name"),
            F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("event_us"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        )


# The same tables for DuckDB.
SQL = {
    "c": r"""c as (select * from (select trim(id) as id, kind, name, topic, position, is_archived, collection_scope, trim(guild_id) as guild_id, nullif(nullif(regexp_replace(parent_id, '^\s+|\s+$', '', 'g'), ''), '0') as parent_id, nullif(deleted_at, '') as deleted_at,
  row_number() over (partition by trim(id) order by try_cast(updated_at as timestamptz) desc nulls last) as _r from channels where trim(id) <> '') where _r = 1)""",
    "p": """p as (select * from (select trim(guild_id) as guild_id, trim(user_id) as user_id, nullif(username, '') as username, nullif(global_name, '') as global_name, nullif(display_name, '') as display_name, nullif(nick, '') as nick, bot, nullif(deleted_at, '') as deleted_at,
  row_number() over (partition by trim(guild_id), trim(user_id) order by try_cast(updated_at as timestamptz) desc nulls last) as _r from members where trim(guild_id) <> '' and trim(user_id) <> '') where _r = 1)""",
    "m": r"""m as (select * from (select trim(id) as id, trim(guild_id) as guild_id, trim(channel_id) as channel_id, nullif(trim(author_id), '') as author_id, nullif(nullif(regexp_replace(reply_to_message_id, '^\s+|\s+$', '', 'g'), ''), '0') as reply_id,
  try_cast(created_at as timestamptz)::timestamp as ts, nullif(deleted_at, '') is not null as deleted, content, normalized_content, pinned, has_attachments,
  row_number() over (partition by trim(id) order by try_cast(updated_at as timestamptz) desc nulls last) as _r from messages where trim(id) <> '') where _r = 1)""",
    "a": """a as (select l_orderkey || '-' || l_linenumber as attachment_id, l_orderkey::varchar as message_id, l_returnflag || '.' || l_linestatus as filename, l_quantity::bigint as size from lineitem)""",
    "e": """e as (select l_orderkey::varchar as message_id, (o_custkey % 25)::varchar as channel_id, case when l_linenumber % 2 = 0 then 'user' else 'role' end as target_type, p_brand as target_name, epoch_us(l_shipdate) as event_us, l_orderkey * 10 + l_linenumber as event_id
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)""",
}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    """SQL over the current tables named by their letters."""
    return f"with {'recursive ' if recursive else ''}{', '.join(SQL[n] for n in names)} {body}"
