"""Queries of the archive's writes, ledger, queue and publication, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.instants import instant, instant_us, none_if_empty
from ..operators import archive_writes, ledger, public_metrics, publish, work_queue
from ..operators.changefeed import read_changes
from ..operators.trees import up_the_tree
from ..sources.archive import Archive, with_sql
from ..sources.tables import table

#: Instants of the named queries, in the tables' own time.
NOW_US, LEDGER_NOW_US, LEDGER_KEPT_US = 1_764_547_200_000_000, 1_706_572_800_000_000, 10 * 86_400_000_000
#: Longest input of a job in characters, entries of the change feed between two cursors.
MOST_CHARS, FROM_SEQ, TO_SEQ = 200, 100, 900


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every different row of a message, numbered by the instant of updated_at."""
    m = table(spark, sf, "messages").select(F.trim("id").alias("id"), "edited_at", "deleted_at", "content", "reply_to_message_id", instant_us("updated_at").alias("us")).where("id <> '' and us is not null").distinct()
    w = Window.partitionBy("id").orderBy("us", F.xxhash64("edited_at", "deleted_at", "content", "reply_to_message_id"))
    return m.withColumn("n", F.row_number().over(w)).withColumn("last", F.max("us").over(Window.partitionBy("id")))


def keep_newer_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Oldest row of each message stored, the latest ones coming in; and the other way round, as `turn` says."""
    v = _versions(spark, sf)
    first, last = (v.where(c).drop("n", "last", "us") for c in ("n = 1", "us = last"))
    one = last.dropDuplicates(["id"])
    out = None
    for turn, (a, b) in enumerate(((first, one), (one, first))):
        k = archive_writes.keep_newer(a, b, shape=["reply_to_message_id"]).select("id", F.coalesce("content", F.lit("")).alias("content"), none_if_empty("deleted_at").isNotNull().alias("deleted"), F.lit(turn).alias("turn"))
        out = k if out is None else out.unionByName(k)
    return out


def messages_marked_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of archived channels deleted, and one that has no row."""
    a = Archive(spark, sf)
    m = a.messages.select("id", F.when(F.col("deleted"), "before").alias("deleted_at"), F.lit(None).cast("string").alias("deletion_source"), "channel_id")
    gone = m.join(a.channels.where("is_archived = 1").select(F.col("id").alias("channel_id")), "channel_id", "left_semi").select("id", F.lit("now").alias("at"))
    stub = spark.createDataFrame([("404", "now")], "id string, at string")
    return archive_writes.mark_deleted(m, gone.unionByName(stub), ["id"], "gateway").select("id", "deleted_at", "deletion_source")


def guilds_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left per table after the data of deleted guilds was removed from all."""
    a = Archive(spark, sf)
    gone = a.guilds.where("deleted_at is not null").select("id")
    left = archive_writes.delete_guild({"guilds": a.guilds, "channels": a.channels, "members": a.members, "messages": a.messages}, gone)
    out = None
    for name, df in left.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def attachments_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments read again: some renamed, some gone, some new; a local size is kept where the new row has none."""
    a = Archive(spark, sf).attachments.groupBy("attachment_id").agg(F.min(F.struct("filename", "size", "message_id")).alias("s")).select("attachment_id", "s.*")
    x = a.withColumn("line", F.split_part("attachment_id", F.lit("-"), F.lit(2)).cast("int"))
    stored = x.where("line <> 3").drop("line")
    again = x.where("line <> 2").select("attachment_id", "message_id", F.when(F.col("line") == 1, F.concat(F.lit("new-"), "filename")).otherwise(F.col("filename")).alias("filename"), F.when(F.col("line") > 3, F.col("size")).alias("size"))
    parents = x.select("message_id").distinct()
    return archive_writes.reconcile(stored, again, parents, "message_id", ["attachment_id"], ["size"]).select("attachment_id", "filename", "size", "op")


def cursors_advanced(spark: SparkSession, sf: str) -> DataFrame:
    """Cursors of channels moved to their latest message, and back to the first, which changes nothing."""
    b = Archive(spark, sf).messages.groupBy("channel_id").agg(F.min(F.col("id").cast("decimal(38,0)")).alias("a"), F.max(F.col("id").cast("decimal(38,0)")).alias("b"))
    scope = F.concat(F.lit("channel:"), "channel_id", F.lit(":latest_message_id"))
    old, new = (b.select(scope.alias("scope"), F.col(c).cast("string").alias("cursor")) for c in "ab")
    return archive_writes.advance(archive_writes.advance(old, new), old)


def events_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Events by user, type and value: those of the second half of the month that the first half doesn't have."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.floor("value").alias("v"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("old"))
    return archive_writes.append_events(e.where("old"), e.where("not old"), ["user_id", "event_type", "v"]).select("user_id", "event_type", "v")


def evidence_payloads(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("props", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return archive_writes.evidence(e, "props", "us")


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of users as failures; a later sign-up resolves all of a user's, a purchase none."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("u"), "event_type", F.get_json_object("props", "$.k").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    none = F.lit(None).cast("string")
    names = lambda op, related: [op.alias("operation"), F.lit("tail").alias("source"), none.alias("guild_id"), F.col("u").alias("channel_id"), none.alias("message_id"), F.lit("").alias("related_kind"), related.alias("related_id")]
    failures = e.where("event_type = 'error'").select(*names(F.lit("write"), F.col("k")), "us", F.col("event_type").alias("error_class"))
    solved = e.where("event_type = 'signup'").select(*names(F.lit("write"), none), "us")
    return ledger.record(failures, solved)


def failures_recorded(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf).select("channel_id", "related_id", "first_seen_us", "last_seen_us", "retry_count", "resolved_us")


def failures_replay(spark: SparkSession, sf: str, limit: int = 100) -> DataFrame:
    return ledger.replay_candidates(_ledger(spark, sf), limit, "tail").select("channel_id", "related_id", "last_seen_us")


def failures_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.prune(_ledger(spark, sf), LEDGER_NOW_US, LEDGER_KEPT_US).select("channel_id", "related_id", "resolved_us")


def _queue_messages(spark: SparkSession, sf: str, n: str) -> DataFrame:
    v = _versions(spark, sf)
    return v.where(n).dropDuplicates(["id"]).select("id", F.lit("g").alias("guild_id"), F.col("content").alias("text"), none_if_empty("deleted_at").isNotNull().alias("deleted"))


def queue_enqueued(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs over the first rows of messages, then over the latest ones: what changed is pending again."""
    none = spark.createDataFrame([], "message_id string, state string, revision long, priority int, attempts int, input_sha string, available_us long")
    first = work_queue.enqueue(none, _queue_messages(spark, sf, "n = 1"), 1).withColumn("state", F.lit("done"))
    return work_queue.enqueue(first, _queue_messages(spark, sf, "us = last"), 2).select("message_id", "state", "revision", "priority", "available_us")


def queue_claimed(spark: SparkSession, sf: str, limit: int = 64) -> DataFrame:
    """The next jobs of the lane that is caught up with, those of early messages first."""
    m = Archive(spark, sf).messages.select(F.col("id").alias("message_id"), F.lit("pending").alias("state"), F.unix_micros("ts").alias("available_us"), F.lit(0).alias("priority"), F.when(F.col("pinned") == 1, NOW_US + 1).alias("lease_until_us"))
    return work_queue.claim(m, NOW_US, limit, 0).select("message_id", "available_us")


def queue_settled(spark: SparkSession, sf: str) -> DataFrame:
    """Results for the first rows of messages against the latest ones; every fifth try of a channel's length fails."""
    first, last = _queue_messages(spark, sf, "n = 1"), _queue_messages(spark, sf, "us = last")
    jobs = first.select(F.col("id").alias("message_id"), F.lit("pending").alias("state"), F.lit(1).cast("long").alias("revision"), F.pmod(F.length("id"), F.lit(3)).alias("attempts"), F.lit(0).cast("long").alias("available_us"))
    results = first.where(F.length(F.coalesce("text", F.lit(""))) % 7 != 0).select(F.col("id").alias("message_id"), F.lit(1).cast("long").alias("revision"), F.substring(F.coalesce("text", F.lit("")), 1, MOST_CHARS).alias("input"), (F.length(F.coalesce("text", F.lit(""))) % 5 != 0).alias("ok"))
    return work_queue.settle(jobs, results, last, MOST_CHARS, 9).select("message_id", "state", "revision", "attempts", "outcome")


def _planted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Guilds and channels with permissions in their JSON, made of their other columns."""
    a = Archive(spark, sf)
    g = a.guilds.select("id", F.concat(F.lit('{"roles":[{"id":"1","permissions":"8"},{"id":"'), "id", F.lit('","permissions":"'), F.when(F.length("name") % 3 == 0, "0").otherwise("1024"), F.lit('"}]}')).alias("raw_json"))
    deny, allow = F.when(F.col("position") % 4 == 0, "1024").otherwise("0"), F.when(F.col("is_archived") == 1, "1024").otherwise("0")
    raw = F.concat(F.lit('{"permission_overwrites":[{"id":"7","type":0,"allow":"1024","deny":"0"},{"id":"'), F.coalesce("guild_id", F.lit("")), F.lit('","type":0,"allow":"'), allow, F.lit('","deny":"'), deny, F.lit('"}]}'))
    return g, a.channels.withColumn("raw_json", raw)


def publish_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Whether everyone may see each channel: admitted all the way up, and by the bits of roles and overwrites."""
    g, c = _planted(spark, sf)
    ways = up_the_tree(c.select("id", "parent_id", (~F.coalesce(F.col("collection_scope") == "allowed", F.lit(False)) | F.col("deleted_at").isNotNull()).alias("barred")), "parent_id", ["barred"])
    open_ = ways.select("id", (~F.col("barred") & ~F.col("lost") & ~F.col("looped")).alias("open"))
    return publish.public_channels(c, g, open_).select(F.col("id").alias("channel_id"), F.col("public").cast("int").alias("public"))


def publish_chosen(spark: SparkSession, sf: str, kinds: str = "category") -> DataFrame:
    """Channels by an include and an exclude list: the channels with the least ids of two kinds."""
    c = Archive(spark, sf).channels.select("id", "parent_id", "kind")
    first = lambda kind, n: [r[0] for r in c.where(F.col("kind") == kind).orderBy("id").limit(n).collect()]
    return publish.chosen(c, first("text", 40), first(kinds, 20)).select("id")


def publish_scopes(spark: SparkSession, sf: str) -> DataFrame:
    a = Archive(spark, sf)
    c = a.channels.select("id", "collection_scope", "guild_id")
    each = F.explode(F.array(*[F.concat(F.lit("channel:"), "id", F.lit(s)) for s in ("", ":latest_message_id", ":archived_private_threads_after")], *[F.concat(F.lit("guild:"), "guild_id", F.lit(s)) for s in ("", ":members:last_success")], F.concat(F.lit("wiretap:"), "id")))
    state = c.select(each.alias("scope")).distinct()
    return publish.publishable_scopes(state, c.where("collection_scope = 'allowed'"), a.guilds.where("deleted_at is null")).select("scope")


def publish_people(spark: SparkSession, sf: str) -> DataFrame:
    a = Archive(spark, sf)
    m = a.messages.where("not deleted").select("id", "guild_id", "channel_id", "author_id", "content").join(a.channels.where("collection_scope = 'allowed'").select(F.col("id").alias("channel_id")), "channel_id", "left_semi")
    named = m.select("guild_id", F.lit("user").alias("target_type"), F.explode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"<@!?([0-9]+)>"), F.lit(1))).alias("target_id"))
    return publish.allowed_members(m, named)


def rows_faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of members that a snapshot may not carry: planted are some instants and reasons without a deletion."""
    m = table(spark, sf, "members").select("guild_id", "user_id", F.when(F.length("username") % 11 == 0, "soon").otherwise(F.col("updated_at")).alias("updated_at"), "deleted_at", F.when(F.length("username") % 7 == 0, "left").otherwise(F.col("deletion_reason")).alias("deletion_reason"), "deletion_source")
    return m.withColumn("fault", publish.row_faults(m)).where("fault is not null").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def snapshot_merged(spark: SparkSession, sf: str) -> DataFrame:
    """First observation of each member local, last one incoming, ties and offsets included."""
    m = table(spark, sf, "members").select(F.trim("guild_id").alias("guild_id"), F.trim("user_id").alias("user_id"), "nick", "updated_at", "deleted_at", instant_us("updated_at").alias("us")).where("us is not null and guild_id <> '' and user_id <> ''")
    order = F.struct("us", F.coalesce("deleted_at", F.lit("")), F.coalesce("nick", F.lit("")), "updated_at")
    pick = lambda f: m.groupBy("guild_id", "user_id").agg(f(F.struct("nick", "updated_at", "deleted_at"), order).alias("s")).select("guild_id", "user_id", "s.*")
    merged = publish.merge_snapshot(pick(F.min_by), pick(F.max_by), ["guild_id", "user_id"])
    return merged.select("guild_id", "user_id", F.coalesce("nick", F.lit("")).alias("nick"), none_if_empty("deleted_at").isNotNull().cast("int").alias("deleted"), "kept")


def guilds_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that lost their guild, here all replies, and get it back from their channel."""
    a = Archive(spark, sf)
    m = a.messages.select("id", "channel_id", F.when(F.col("reply_id").isNull(), F.col("guild_id")).otherwise("").alias("guild_id"))
    return publish.repair_guilds(m, a.channels.select(F.col("id").alias("channel_id"), "guild_id"), "channel_id").select("id", "guild_id")


def scope_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """Channels whose stored scope isn't the one that the tree gives, with both."""
    from .publication import scope_decisions

    c = Archive(spark, sf).channels.select(F.col("id").alias("channel_id"), F.coalesce("collection_scope", F.lit("")).alias("stored"))
    return c.join(scope_decisions(spark, sf), "channel_id").where("stored <> scope").select("channel_id", "stored", "scope")


def category_admitted(spark: SparkSession, sf: str) -> DataFrame:
    """Channels below an admitted category, here those at an even position; a missing or endless way up is none."""
    c = Archive(spark, sf).channels
    t = up_the_tree(c.select("id", "parent_id", (F.coalesce(F.col("kind") == "category", F.lit(False)) & (F.col("position") % 2 == 0)).alias("admitted")), "parent_id", ["admitted"])
    return t.where("admitted and not lost and not looped").select(F.col("id").alias("channel_id"))


def cdc_delta(spark: SparkSession, sf: str, since: int = FROM_SEQ, until: int = TO_SEQ) -> DataFrame:
    """Keys changed behind one cursor up to another, each once with its last change."""
    c = read_changes(table(spark, sf, "change_log")).where((F.col("seq") > since) & (F.col("seq") <= until))
    return c.groupBy("table_name", "row_key").agg(F.max("seq").alias("seq"), F.max_by("live", "seq").alias("live"))


def cdc_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of each entry, by which a cursor is recognised."""
    c = read_changes(table(spark, sf, "change_log")).distinct()
    return c.select("seq", F.sha2(F.concat_ws("|", "table_name", F.when(F.col("live"), "u").otherwise("d"), "row_key", F.col("ms").cast("string")), 256).alias("digest")).distinct()


def metrics_written(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of a metrics feed that are valid, each id once; repeated values under other ids stay."""
    return public_metrics.write(_observations(spark, sf)).select("id", "entity", "value", "ts")


def metrics_status(spark: SparkSession, sf: str) -> DataFrame:
    return public_metrics.status(public_metrics.write(_observations(spark, sf)))


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(
        F.concat(F.lit("m"), (F.col("event_id") % 5000).cast("string")).alias("id"), F.lit("metric").alias("type"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity"), F.lit("community").alias("target"), F.col("event_type").alias("metric"),
        F.when(F.col("event_type") == "error", "gauge").otherwise("counter").alias("kind"), F.when(F.col("user_id") % 9 == 0, "yesterday").otherwise(text).alias("ts"), F.floor("value").cast("double").alias("value"), text.alias("observed_at"), F.lit("feed").alias("provenance"), F.col("event_id").alias("sequence"),
    )


QUERIES = {f.__name__: f for f in (keep_newer_messages, messages_marked_deleted, guilds_deleted, attachments_reconciled, cursors_advanced, events_appended, evidence_payloads, failures_recorded, failures_replay, failures_pruned, queue_enqueued, queue_claimed, queue_settled, publish_channels, publish_chosen, publish_scopes, publish_people, rows_faulty, snapshot_merged, guilds_repaired, scope_refreshed, category_admitted, cdc_delta, cdc_digests, metrics_written, metrics_status)}

_INSTANT = "try_cast({} as timestamptz)"
_V = f"""v as (select *, max(us) over (partition by id) as last from (select distinct trim(id) as id, edited_at, deleted_at, content, reply_to_message_id, epoch_us({_INSTANT.format('updated_at')}) as us, {_INSTANT.format('edited_at')} as edit, coalesce(deleted_at, '') <> '' as gone from messages where trim(id) <> '') where us is not null),
f as (select * from v qualify us = min(us) over (partition by id)), l as (select * from v where us = last),
f1 as (select distinct on (id) * from f), l1 as (select distinct on (id) * from l)"""
_KEEP = """case when s.gone then true when s.edit is distinct from i.edit then coalesce(i.edit, timestamptz '0001-01-01') < coalesce(s.edit, timestamptz '0001-01-01') when coalesce(i.content, '') <> '' or i.gone then false else coalesce(s.content, '') <> '' and s.reply_to_message_id is not distinct from i.reply_to_message_id end"""
_TREE = """, up as (select id as root, parent_id, {flag} as flag, false as looped, [id] as path from c union all select u.root, c.parent_id, {flag}, list_contains(u.path, c.id), list_append(u.path, c.id) from up u join c on c.id = u.parent_id where not u.looped),
w as (select root as id, bool_or(flag) as flag, bool_or(looped) as looped, bool_or(u.parent_id is not null and t.id is null) as lost from up u left join c t on t.id = u.parent_id group by root)"""
_L = """e as (select user_id::varchar as u, event_type, json_extract_string(props, '$.k') as k, epoch_us(ts) as us from events),
x as (select u as channel_id, k as related_id, min(us) as first_seen_us, max(us) as last_seen_us, count(*) - 1 as retry_count from e where event_type = 'error' group by 1, 2),
g as (select x.*, (select min(us) from e where e.event_type = 'signup' and e.u = x.channel_id and e.us >= x.last_seen_us) as resolved_us from x)"""
_CHANGES = r"""c as (select lower(regexp_replace(table_name, '^\s+|\s+$', '', 'g')) as table_name, from_json(case when json_valid(row_key) and json_type(row_key) = 'ARRAY' then row_key end, '["VARCHAR"]') as k, recorded_at_ms as ms, seq, lower(regexp_replace(op, '^\s+|\s+$', '', 'g')) as op from change_log),
v as (select distinct table_name, to_json(k)::varchar as row_key, ms, seq, op not in ('d', 'delete') as live from c where k is not null and table_name <> '' and ms is not null and op in ('i', 'insert', 'u', 'update', 'd', 'delete'))"""
_METRICS = """m as (select distinct on (id) 'm' || (event_id % 5000) as id, 'user-' || user_id as entity, floor(value)::double as value, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ts, event_id as sequence from events where event_type <> 'error' and user_id % 9 <> 0 and floor(value) >= 0 order by id, event_id)"""

SQL = {
    "keep_newer_messages": f"with {_V} select s.id, coalesce(case when {_KEEP} then s.content else i.content end, '') as content, case when {_KEEP} then s.gone else i.gone end as deleted, 0::int as turn from f1 s join l1 i using (id) union all select s.id, coalesce(case when {_KEEP} then s.content else i.content end, ''), case when {_KEEP} then s.gone else i.gone end, 1 from l1 s join f1 i using (id)",
    "messages_marked_deleted": with_sql("cm", "select m.id, case when m.deleted then 'before' when c.is_archived = 1 then 'now' end as deleted_at, case when not m.deleted and c.is_archived = 1 then 'gateway' end as deletion_source from m left join c on c.id = m.channel_id union all select '404', 'now', 'gateway'"),
    "guilds_deleted": with_sql("cpm", ", g as (select id from guilds where nullif(deleted_at, '') is not null) select 'guilds' as table_name, count(*) as n from guilds where id not in (select id from g) union all select 'channels', count(*) from c where guild_id is null or guild_id not in (select id from g) union all select 'members', count(*) from p where guild_id not in (select id from g) union all select 'messages', count(*) from m where guild_id is null or guild_id not in (select id from g)"),
    "attachments_reconciled": with_sql("a", ", b as (select distinct on (attachment_id) * from a order by attachment_id, filename, size) select attachment_id, case when split_part(attachment_id, '-', 2) = '1' then 'new-' || filename else filename end as filename, size, case split_part(attachment_id, '-', 2) when '1' then 'update' when '2' then 'delete' when '3' then 'insert' else 'same' end as op from b").replace("filename end as filename, size,", "filename end as filename, case when split_part(attachment_id, '-', 2) = '3' then null else size end as size,"),
    "cursors_advanced": with_sql("m", "select 'channel:' || channel_id || ':latest_message_id' as scope, max(id::hugeint)::varchar as cursor from m group by channel_id"),
    "events_appended": "with e as (select user_id, event_type, floor(value)::bigint as v, ts < timestamp '2024-01-16' as old from events) select distinct user_id, event_type, v from e where not old and not exists (select 1 from e o where o.old and o.user_id is not distinct from e.user_id and o.event_type is not distinct from e.event_type and o.v is not distinct from e.v)",
    "evidence_payloads": "select sha256(props) as sha256, props as payload, epoch_us(min(ts)) as first_at, epoch_us(max(ts)) as last_at, count(*) as observations from events where props is not null group by props",
    "failures_recorded": f"with {_L} select * from g",
    "failures_replay": f"with {_L} select channel_id, related_id, last_seen_us from g where resolved_us is null order by last_seen_us, channel_id, related_id limit 100",
    "failures_pruned": f"with {_L} select channel_id, related_id, resolved_us from g where resolved_us is null or resolved_us >= {LEDGER_NOW_US - LEDGER_KEPT_US}",
    "queue_enqueued": f"with {_V} select l1.id as message_id, case when f1.gone or coalesce(f1.content, '') <> coalesce(l1.content, '') then 'pending' else 'done' end as state, (case when not f1.gone and coalesce(f1.content, '') <> coalesce(l1.content, '') then 2 else 1 end)::bigint as revision, case when not f1.gone and coalesce(f1.content, '') <> coalesce(l1.content, '') then 1 else 0 end::int as priority, (case when f1.gone or coalesce(f1.content, '') <> coalesce(l1.content, '') then 2 else 1 end)::bigint as available_us from l1 join f1 using (id) where not l1.gone",
    "queue_claimed": with_sql("m", f"select id as message_id, epoch_us(ts) as available_us from m where epoch_us(ts) <= {NOW_US} and pinned is distinct from 1 order by available_us, message_id limit 64"),
    "queue_settled": f"with {_V}, j as (select f1.id, length(f1.id) % 3 as attempts, coalesce(f1.content, '') as t, l1.gone, left(coalesce(l1.content, ''), {MOST_CHARS}) as now from f1 join l1 using (id)), o as (select *, case when length(t) % 7 = 0 then 'waiting' when gone then 'dropped' when length(t) % 5 = 0 and attempts + 1 >= 3 then 'failed' when length(t) % 5 = 0 then 'retry' when left(t, {MOST_CHARS}) <> now then 'stale' else 'done' end as outcome from j) select id as message_id, case when outcome in ('done', 'failed') then outcome else 'pending' end as state, (1 + (outcome = 'stale')::int)::bigint as revision, (case when outcome in ('retry', 'failed') then attempts + 1 when outcome = 'done' then 0 else attempts end)::int as attempts, outcome from o where outcome <> 'dropped'",
    "publish_channels": with_sql("c", _TREE.format(flag="coalesce(c.collection_scope <> 'allowed', true) or c.deleted_at is not null") + """, o as (select c.*, not w.flag and not w.looped and not w.lost as open from c join w on w.id = c.id),
s as (select o.id, o.parent_id, o.kind, o.open, case when g.id is null or o.position is null and false then false when o.is_archived = 1 then true when o.position % 4 = 0 then false when k.kind = 'category' and k.guild_id = o.guild_id and k.is_archived = 1 then true when k.kind = 'category' and k.guild_id = o.guild_id and k.position % 4 = 0 then false else length(g.name) % 3 <> 0 end as sees from o left join guilds g on g.id = o.guild_id left join c k on k.id = o.parent_id)
select s.id as channel_id, (coalesce(case when s.kind = 'thread_private' then false when starts_with(coalesce(s.kind, ''), 'thread_') then coalesce(t.sees and t.open, false) and s.open else s.sees and s.open end, false))::int as public from s left join s t on t.id = s.parent_id and not starts_with(coalesce(t.kind, ''), 'thread_')""", True),
    "publish_chosen": with_sql("c", ", i as (select id from c where kind = 'text' order by id limit 40), x as (select id from c where kind = 'category' order by id limit 20) select id from c where id not in (select id from x) and (parent_id is null or parent_id not in (select id from x)) and (id in (select id from i) or (kind like 'thread!_%' escape '!' and parent_id in (select id from i)))"),
    "publish_scopes": with_sql("c", "select 'channel:' || id as scope from c where collection_scope = 'allowed' union all select 'channel:' || id || ':latest_message_id' from c where collection_scope = 'allowed' union all select distinct 'guild:' || guild_id from c where guild_id in (select id from guilds where nullif(deleted_at, '') is null)"),
    "publish_people": with_sql("cm", ", x as (select m.* from m where not deleted and channel_id in (select id from c where collection_scope = 'allowed')), a as (select distinct guild_id, author_id as user_id from x where author_id is not null), n as (select guild_id, unnest(regexp_extract_all(coalesce(content, ''), '<@!?([0-9]+)>', 1)) as user_id from x) select guild_id, user_id from a union select guild_id, user_id from n where guild_id in (select guild_id from a)"),
    "rows_faulty": f"with m as (select *, case when length(username) % 11 = 0 then 'soon' else updated_at end as u, case when length(username) % 7 = 0 then 'left' else deletion_reason end as r from members), f as (select case when {_INSTANT.format('u')} is null then 'updated_at' when nullif(trim(deleted_at), '') is not null and {_INSTANT.format('deleted_at')} is null then 'deleted_at' when nullif(trim(deleted_at), '') is null and (nullif(deletion_source, '') is not null or nullif(r, '') is not null) then 'deletion' end as fault from m) select fault, count(*) as n from f where fault is not null group by 1",
    "snapshot_merged": f"with m as (select trim(guild_id) as guild_id, trim(user_id) as user_id, nick, updated_at, deleted_at, epoch_us({_INSTANT.format('updated_at')}) as us from members), o as (select *, row(us, coalesce(deleted_at, ''), coalesce(nick, ''), updated_at) as k from m where us is not null and guild_id <> '' and user_id <> ''), a as (select guild_id, user_id, arg_min(row(nick, deleted_at, us), k) as l, arg_max(row(nick, deleted_at, us), k) as i from o group by 1, 2), d as (select *, case when i[3] <> l[3] then i[3] > l[3] else coalesce(l[2], '') = '' or coalesce(i[2], '') <> '' end as take from a) select guild_id, user_id, coalesce(case when take then i[1] else l[1] end, '') as nick, (coalesce(case when take then i[2] else l[2] end, '') <> '')::int as deleted, case when take then 'incoming' else 'local' end as kept from d",
    "guilds_repaired": with_sql("cm", "select m.id, coalesce(case when reply_id is null then nullif(m.guild_id, '') end, nullif(c.guild_id, ''), case when reply_id is null then m.guild_id else '' end) as guild_id from m left join c on c.id = m.channel_id"),
    "scope_refreshed": with_sql("c", _TREE.format(flag="coalesce(c.collection_scope = 'excluded', false)") + " select c.id as channel_id, coalesce(collection_scope, '') as stored, case when flag then 'excluded' when looped or lost then 'unknown' else 'allowed' end as scope from c join w on w.id = c.id where coalesce(collection_scope, '') <> case when flag then 'excluded' when looped or lost then 'unknown' else 'allowed' end", True),
    "category_admitted": with_sql("c", _TREE.format(flag="coalesce(c.kind = 'category', false) and c.position % 2 = 0") + " select id as channel_id from w where flag and not looped and not lost", True),
    "cdc_delta": f"with {_CHANGES} select table_name, row_key, max(seq) as seq, arg_max(live, seq) as live from v where seq > {FROM_SEQ} and seq <= {TO_SEQ} group by 1, 2",
    "cdc_digests": f"with {_CHANGES} select distinct seq, sha256(table_name || '|' || case when live then 'u' else 'd' end || '|' || row_key || '|' || ms) as digest from v",
    "metrics_written": f"with {_METRICS} select id, entity, value, ts from m",
    "metrics_status": f"with {_METRICS} select 'metric' as type, count(*) as n, count(distinct entity) as entities, max(sequence) as last_sequence, epoch_us(max({_INSTANT.format('ts')})) as latest_us from m",
}
