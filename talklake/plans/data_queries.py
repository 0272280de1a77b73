"""Queries of the data-processing operators in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import instant_us, none_if_empty
from ..operators.changefeed import ChangeStore, read_changes
from ..operators.current import current_rows
from ..operators.history import HistoryStore, member_observations
from ..operators.orphans import find_orphans
from ..operators.sessions import sessionise
from ..session import work_path
from ..sources.tables import table


#: Share of each file's rows, by their order, that comes as the first of the two batches.
FIRST_BATCH = 0.75


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """History of members, loaded in the order of arrival in two batches.

    The rows lie far out of order, so the second batch holds late observations all over the chains of the first: only the
    rebuilding of the affected chains makes the versions right.
    """
    members = table(spark, sf, "members").select("*", F.col("_metadata.row_index").alias("_at_row"), F.col("_metadata.file_path").alias("_file"))
    last = members.groupBy("_file").agg(F.max("_at_row").alias("_last"))  # one row per file
    members = members.join(last, "_file")
    first = F.col("_at_row") < FIRST_BATCH * (F.col("_last") + 1)
    store = HistoryStore(spark, work_path(spark, "history"), ["guild_id", "user_id"])
    for part in (members.where(first), members.where(~first)):
        store.apply(member_observations(part))
    versions = store.versions()
    if versions is None:
        return spark.createDataFrame([], "guild_id string, user_id string, display_name string, nick string, roles array<string>, valid_from_us long, valid_to_us long")
    return versions


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).select("guild_id", "user_id", "valid_from_us", "valid_to_us")


def p1_history(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).select("guild_id", "user_id", "display_name", "nick", F.to_json("roles").alias("role_ids_json"), "valid_from_us", "valid_to_us")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "change_log")
    store = ChangeStore(spark, work_path(spark, "changes"))
    store.apply(read_changes(log), rows=log.count())
    return store.rows()


def _orphans(spark: SparkSession, sf: str, cascade: bool = True) -> DataFrame:
    return find_orphans(table(spark, sf, "messages"), table(spark, sf, "channels"), table(spark, sf, "members"), cascade)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The direct stage alone: no row of it depends on the cascade, which p5_report has."""
    return _orphans(spark, sf, cascade=False).select("table_name", "field", "record_id", "status")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).groupBy("table_name", "field", "month", "status", "kind").agg(F.count(F.lit(1)).alias("n"))


def _sessions(spark: SparkSession, sf: str, distinct: str | None = None) -> DataFrame:
    events = current_rows(table(spark, sf, "messages"), {"author_id": F.trim("author_id"), "channel_id": none_if_empty(F.trim("channel_id")), "us": instant_us("created_at")})
    return sessionise(events, "author_id", "us", distinct=distinct)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).select("author_id", "start_us", "end_us", F.col("n_events").cast("int").alias("n_messages"))


def p7_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = _sessions(spark, sf, "channel_id")
    return s.select("author_id", "start_us", "end_us", "duration_us", F.col("n_events").alias("n_messages"), F.col("n_distinct").alias("n_channels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p4_found, p5_found, p5_report, p7_found, p7_sessions)}


def _current(t: str, columns: str) -> str:
    return f"{t}_c as (select {columns} from (select *, row_number() over (partition by trim(id) order by try_cast(updated_at as timestamptz) desc nulls last) as _rank from {t} where trim(id) <> '') where _rank = 1)"


def _ref(c: str) -> str:
    b = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return f"nullif(nullif({b}, ''), '0')"


_VERSIONS = r"""
with o as (
  select trim(guild_id) as guild_id, trim(user_id) as user_id, epoch_us(try_cast(updated_at as timestamptz)) as us, nullif(deleted_at, '') is null as present,
    nullif(display_name, '') as display_name, nullif(nick, '') as nick,
    coalesce(list_sort(list_distinct(from_json(nullif(role_ids_json, ''), '["VARCHAR"]'))), []) as roles
  from members where trim(guild_id) <> '' and trim(user_id) <> ''),
d as (select distinct * from o where us is not null),
s as (select *, case when present then struct_pack(d := display_name, n := nick, r := roles) end as state from d),
c as (select *, row_number() over w = 1 or (present, state) is distinct from (lag(present) over w, lag(state) over w) as starts from s window w as (partition by guild_id, user_id order by us)),
r as (select *, coalesce(lead(us) over (partition by guild_id, user_id order by us), -1) as valid_to_us from c where starts)
"""

_ORPHANS = rf"""
with {_current("messages", rf"trim(id) as id, trim(guild_id) as guild_id, {_ref('channel_id')} as channel_id, nullif(trim(author_id), '') as author_id, {_ref('reply_to_message_id')} as reply_id, coalesce(strftime(try_cast(created_at as timestamptz), '%Y-%m'), 'unknown') as month, nullif(deleted_at, '') is not null as deleted")},
{_current("channels", rf"trim(id) as id, {_ref('parent_id')} as parent_id, coalesce(strftime(try_cast(updated_at as timestamptz), '%Y-%m'), 'unknown') as month, nullif(deleted_at, '') is not null as deleted")},
members_c as (select trim(guild_id) as guild_id, trim(user_id) as author_id, arg_max(nullif(deleted_at, '') is not null, try_cast(updated_at as timestamptz)) as deleted from members group by 1, 2),
direct as (
  select 'messages' as table_name, 'channel_id' as field, m.id as record_id, m.month, case when c.id is null then 'missing' else 'deleted' end as status from messages_c m left join channels_c c on c.id = m.channel_id where m.channel_id is not null and (c.id is null or c.deleted)
  union all
  select 'messages', 'author_id', m.id, m.month, case when p.author_id is null then 'missing' else 'deleted' end from messages_c m left join members_c p on p.guild_id = m.guild_id and p.author_id = m.author_id where m.author_id is not null and m.guild_id is not null and (p.author_id is null or p.deleted)
  union all
  select 'messages', 'reply_to_message_id', m.id, m.month, case when t.id is null then 'missing' else 'deleted' end from messages_c m left join messages_c t on t.id = m.reply_id where m.reply_id is not null and (t.id is null or t.deleted)
  union all
  select 'channels', 'parent_id', c.id, c.month, case when t.id is null then 'missing' else 'deleted' end from channels_c c left join channels_c t on t.id = c.parent_id where c.parent_id is not null and (t.id is null or t.deleted))
"""

_SESSIONS = f"""
with {_current("messages", "trim(author_id) as author_id, nullif(trim(channel_id), '') as channel_id, epoch_us(try_cast(created_at as timestamptz)) as us")},
m as (select *, us - lag(us) over (partition by author_id order by us) as gap from messages_c where author_id <> '' and us is not null),
s as (select *, sum(case when gap <= 1800000000 then 0 else 1 end) over (partition by author_id order by us, gap desc nulls first rows unbounded preceding) as k from m)
"""

SQL = {
    "p1_found": _VERSIONS + "select guild_id, user_id, us as valid_from_us, valid_to_us from r where present",
    "p1_history": _VERSIONS + "select guild_id, user_id, display_name, nick, to_json(roles)::varchar as role_ids_json, us as valid_from_us, valid_to_us from r where present",
    "p4_found": r"""
with c as (select lower(regexp_replace(table_name, '^\s+|\s+$', '', 'g')) as table_name, from_json(case when json_valid(row_key) and json_type(row_key) = 'ARRAY' then row_key end, '["VARCHAR"]') as k, recorded_at_ms as ms, seq, lower(regexp_replace(op, '^\s+|\s+$', '', 'g')) as op from change_log),
v as (select table_name, to_json(k)::varchar as row_key, ms, seq, op not in ('d', 'delete') as live from c where k is not null and table_name <> '' and ms is not null and op in ('i', 'insert', 'u', 'update', 'd', 'delete')),
l as (select *, row_number() over (partition by table_name, row_key order by ms desc, seq desc) as n from v)
select table_name, row_key, ms as changed_ms from l where n = 1 and live""",
    "p5_found": _ORPHANS + "select table_name, field, record_id, status from direct",
    "p5_report": _ORPHANS.replace("with ", "with recursive ", 1)
    + """, edges as (
  select 'messages' as t, id, month, 'reply_to_message_id' as field, 'messages' as to_t, reply_id as to_id from messages_c where reply_id is not null
  union all select 'messages', id, month, 'channel_id', 'channels', channel_id from messages_c where channel_id is not null
  union all select 'channels', id, month, 'parent_id', 'channels', parent_id from channels_c where parent_id is not null),
walk as (
  select distinct table_name as t, record_id as id, 0 as depth from direct
  union select e.t, e.id, w.depth + 1 from walk w join edges e on e.to_t = w.t and e.to_id = w.id where w.depth < (select count(*) from messages_c)),
first as (select t, id, min(depth) as depth from walk group by 1, 2),
rows as (
  select table_name, field, month, status, 'direct' as kind from direct
  union all
  select e.t, e.field, e.month, 'inherited', 'inherited' from edges e join first f on f.t = e.t and f.id = e.id join first g on g.t = e.to_t and g.id = e.to_id where f.depth > 0 and g.depth = f.depth - 1)
select table_name, field, month, status, kind, count(*) as n from rows group by all""",
    "p7_found": _SESSIONS + "select author_id, min(us) as start_us, max(us) as end_us, count(*)::int as n_messages from s group by author_id, k",
    "p7_sessions": _SESSIONS + "select author_id, min(us) as start_us, max(us) as end_us, max(us) - min(us) as duration_us, count(*) as n_messages, count(distinct channel_id) as n_channels from s group by author_id, k",
}
