"""Listings of messages, members, channels and attachments with their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_mentions
from ..sources.archive import Archive, with_sql
from .reports import author_name


def part_of(col: str, needle: str) -> Column:
    """Whether a column contains the text, in any case of letters; null is no text. `%` and `_` mean themselves."""
    return F.coalesce(F.contains(F.lower(F.col(col)), F.lit(needle.lower())), F.lit(False))


def named(frame: DataFrame, a: Archive) -> DataFrame:
    """Messages with channel_name and the names of their author; members that are gone give none."""
    p = a.members.where("deleted_at is null").select("guild_id", F.col("user_id").alias("author_id"), "username", "display_name", author_name().alias("author_name"))
    c = a.channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"))
    return frame.join(p, ["guild_id", "author_id"], "left").join(c, "channel_id", "left")


def list_messages(a: Archive, guilds: list[str] | None = None, channel: str | None = None, author: str | None = None, since: str | None = None, before: str | None = None, include_empty: bool = False, last: int | None = None, limit: int | None = None) -> DataFrame:
    """Messages in order of instant and id, with names and `display`, their text with mentions resolved.

    channel: an id, or a name or part of one; a leading # is ignored. author: an id, a user name or display name, or part
    of one. since and before bound the instants half-open. Messages without normalized text are left out unless
    include_empty. last: the newest ones; otherwise the first `limit`, or all. Filters on guild and instant reach the scan.
    """
    m = a.messages
    if guilds:
        m = m.where(F.col("guild_id").isin(guilds))
    if since:
        s = F.lit(since).cast("timestamp")
        m = m.where((F.col("month") >= F.date_format(s, "yyyy-MM")) & (F.col("ts") >= s))
    if before:
        b = F.lit(before).cast("timestamp")
        m = m.where((F.col("month") <= F.date_format(b, "yyyy-MM")) & (F.col("ts") < b))
    if not include_empty:
        m = m.where(F.trim(F.coalesce("normalized_content", F.lit(""))) != "")
    channel = (channel or "").strip().removeprefix("#")
    author = (author or "").strip()
    if channel:
        c = a.channels.where((F.col("id") == channel) | part_of("name", channel)).select(F.col("id").alias("channel_id"))
        m = m.where(F.col("channel_id") == channel) if channel.isdigit() else m.join(c, "channel_id", "left_semi")
    if author:
        p = a.members.where("deleted_at is null").where((F.col("user_id") == author) | part_of("username", author) | part_of("display_name", author)).select("guild_id", F.col("user_id").alias("author_id"))
        m = m.where(F.col("author_id") == author) if author.isdigit() else m.join(p, ["guild_id", "author_id"], "left_semi")
    if last:
        m = m.orderBy(F.desc_nulls_last("ts"), F.desc("id")).limit(last)
    elif limit:
        m = m.orderBy(F.asc_nulls_first("ts"), "id").limit(limit)
    m = with_labels(named(m, a), a)
    return m.select("id", "guild_id", "channel_id", F.coalesce("channel_name", F.lit("")).alias("channel_name"), "author_id", F.coalesce("author_name", F.lit("")).alias("author_name"), F.unix_micros("ts").alias("created_us"), "content", "display", "reply_id").orderBy(F.asc_nulls_first("created_us"), "id")


def with_labels(messages: DataFrame, a: Archive) -> DataFrame:
    """Messages with `display`: their text with the ids in it replaced by names of members of the guild and of channels."""
    text = F.when(F.trim(F.coalesce("content", F.lit(""))) != "", F.col("content")).otherwise(F.col("normalized_content"))
    m = messages.withColumn("display", text)
    found = m.where("display like '%<%'").select("id", "guild_id", F.explode(F.array_distinct(F.regexp_extract_all("display", F.lit(r"<(@!?|#)[0-9]+>"), F.lit(0)))).alias("token"))
    found = found.select("id", "guild_id", F.regexp_extract("token", "[0-9]+", 0).alias("target"), F.when(F.col("token").startswith("<#"), "channel").otherwise("user").alias("kind")).distinct()
    people = a.members.select("guild_id", F.col("user_id").alias("target"), author_name().alias("name"), F.lit("user").alias("kind"))
    rooms = a.channels.select(F.col("id").alias("target"), F.col("name").alias("_room"))
    named_ = found.join(people, ["guild_id", "target", "kind"], "left").join(rooms, "target", "left")
    name = F.when(F.col("kind") == "channel", F.col("_room")).otherwise(F.col("name"))
    # an id that nobody knows stays as it is
    known = named_.where(name.isNotNull() & (name != "")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", F.col("target").alias("id"), name.alias("name")))).alias("_mentions"))
    return m.join(known, "id", "left").withColumn("display", label_mentions(F.col("display"), F.col("_mentions"))).drop("_mentions")


def with_roots(first: DataFrame, a: Archive) -> DataFrame:
    """Ids of a listing and of the messages they answer that aren't in it: (id, context), context 1 for the latter."""
    wanted = first.where("reply_id is not null").select(F.col("reply_id").alias("id")).distinct()
    extra = a.messages.select("id").join(wanted, "id", "left_semi").join(first.select("id"), "id", "left_anti")
    return first.select("id", F.lit(0).alias("context")).unionByName(extra.select("id", F.lit(1).alias("context")))


def resolve_channel(a: Archive, needle: str, guild: str | None = None) -> DataFrame:
    """Channels for an id or a name: the id, else exact names in any case, else names that contain it; all of the best tier."""
    needle = needle.strip().removeprefix("#")
    c = a.channels if guild is None else a.channels.where(F.col("guild_id") == guild)
    tier = F.when(F.col("id") == needle, 0).when(F.lower("name") == needle.lower(), 1).when(part_of("name", needle), 2)
    hits = c.select("guild_id", "id", "name", tier.alias("tier")).where("tier is not null")
    return hits.join(hits.agg(F.min("tier").alias("tier")), "tier").select("guild_id", "id", "name", "tier")


def search_members(a: Archive, query: str, guild: str | None = None, limit: int = 100) -> DataFrame:
    """Members whose names and user name hold every word of the query, by name."""
    p = a.members.where("deleted_at is null")
    p = p if guild is None else p.where(F.col("guild_id") == guild)
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "username", "global_name", "display_name", "nick")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    p = p.withColumn("_w", words)
    for w in query.lower().split():
        p = p.where(F.array_contains("_w", w))
    return p.select("guild_id", "user_id", "username", author_name().alias("name")).orderBy(F.asc_nulls_first("name"), "guild_id", "user_id").limit(limit)


def member_profile(a: Archive, user: str, recent: int = 20) -> tuple[DataFrame, DataFrame]:
    """(member rows with counts of messages, their newest messages) of a user over all guilds."""
    m = a.messages.where(F.col("author_id") == user)
    stats = m.groupBy("guild_id").agg(F.count(F.lit(1)).alias("messages"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))
    p = a.members.where(F.col("user_id") == user).select("guild_id", "user_id", "username", author_name().alias("name"), "bot")
    newest = m.orderBy(F.desc_nulls_last("ts"), F.desc("id")).limit(recent).select("id", "guild_id", "channel_id", F.unix_micros("ts").alias("created_us"))
    return p.join(stats, "guild_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0))), newest


def channel_tree(a: Archive, roots: list[str]) -> DataFrame:
    """Channels of the list with all that lie below them, by way of the nodes above each."""
    from ..operators.trees import up_the_tree

    c = a.channels.select("id", "parent_id", F.col("id").isin(roots).alias("chosen"))
    return up_the_tree(c, "parent_id", ["chosen"]).where("chosen").select("id")


def list_attachments(a: Archive, name: str | None = None, least: int | None = None, messages: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Attachments by part of their name, least size and the messages (id) they hang on."""
    x = a.attachments
    x = x if name is None else x.where(part_of("filename", name))
    x = x if least is None else x.where(F.col("size") >= least)
    x = x if messages is None else x.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    return x if limit is None else x.orderBy("attachment_id", "filename", "size").limit(limit)


#: Filters of the named queries.
CHANNEL, AUTHOR, SINCE, BEFORE = "log", "en", "2025-06-01 00:00:00", "2025-11-01 00:00:00"


def messages_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of channels named like CHANNEL by authors named like AUTHOR between two instants, the newest 300."""
    out = list_messages(Archive(spark, sf), channel=CHANNEL, author=AUTHOR, since=SINCE, before=BEFORE, last=300)
    return out.select("id", "channel_name", "author_name", "created_us")


def messages_display(spark: SparkSession, sf: str) -> DataFrame:
    """All messages with mentions in their text, and the text with names in place of the ids."""
    a = Archive(spark, sf)
    m = a.messages.where("content like '%<@%'").select("id", "guild_id", "content", "normalized_content")
    return with_labels(m, a).select("id", "display")


def messages_context(spark: SparkSession, sf: str) -> DataFrame:
    a = Archive(spark, sf)
    return with_roots(list_messages(a, since=SINCE, before=BEFORE, include_empty=True), a)


def members_found(spark: SparkSession, sf: str) -> DataFrame:
    """Members with the word among their names."""
    return search_members(Archive(spark, sf), "ropod", limit=1000)


def member_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The member who wrote most, in every guild."""
    a = Archive(spark, sf)
    top = a.messages.where("author_id is not null").groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author_id").first()
    return member_profile(a, top["author_id"] if top else "")[0].select("guild_id", "user_id", "username", "messages", "first_us", "last_us")


def member_recent(spark: SparkSession, sf: str) -> DataFrame:
    a = Archive(spark, sf)
    top = a.messages.where("author_id is not null").groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author_id").first()
    return member_profile(a, top["author_id"] if top else "")[1]


def channels_below(spark: SparkSession, sf: str) -> DataFrame:
    """The categories with the ten least ids and all channels and threads below them."""
    a = Archive(spark, sf)
    roots = [r[0] for r in a.channels.where("kind = 'category'").orderBy("id").select("id").limit(10).collect()]
    return channel_tree(a, roots)


def attachments_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    return list_attachments(Archive(spark, sf), "n.", 30).select("attachment_id", "message_id", "filename", "size")


QUERIES = {f.__name__: f for f in (messages_filtered, messages_display, messages_context, members_found, member_stats, member_recent, channels_below, attachments_of_orders)}

_NAME = "coalesce(display_name, nick, global_name, username)"
_TOP = "(select author_id from m where author_id is not null group by 1 order by count(*) desc, author_id limit 1)"
SQL = {
    "messages_filtered": with_sql("cpm", f"""select m.id, coalesce(c.name, '') as channel_name, coalesce({_NAME}, '') as author_name, epoch_us(ts) as created_us from m join c on c.id = m.channel_id join p on p.guild_id = m.guild_id and p.user_id = m.author_id
where p.deleted_at is null and contains(lower(c.name), '{CHANNEL}') and (contains(lower(coalesce(username, '')), '{AUTHOR}') or contains(lower(coalesce(display_name, '')), '{AUTHOR}')) and ts >= timestamp '{SINCE}' and ts < timestamp '{BEFORE}' and trim(coalesce(normalized_content, ''), ' ') <> '' order by ts desc nulls last, m.id desc limit 300"""),
    "messages_display": with_sql("cpm", f""", x as (select id, guild_id, content from m where content like '%<@%'), t as (select distinct id, guild_id, content, unnest(regexp_extract_all(content, '<(?:@!?|#)[0-9]+>')) as token from x),
n as (select t.*, regexp_extract(token, '[0-9]+') as target from t), l as (select n.id, n.content, n.token, case when token like '<#%' then nullif(c.name, '') else nullif({_NAME.replace('username', 'p.username')}, '') end as name, target from n left join p on p.guild_id = n.guild_id and p.user_id = n.target left join c on c.id = n.target),
k as (select id, list(struct_pack(token := token, label := case when token like '<#%' then '#' else '@' end || trim(name)) order by token) as ms from l where name is not null group by 1)
select x.id, coalesce(list_reduce(list_prepend(x.content, list_transform(k.ms, lambda m: m.token || chr(1) || m.label)), lambda a, b: replace(a, split_part(b, chr(1), 1), split_part(b, chr(1), 2))), x.content) as display from x left join k using (id)"""),
    "messages_context": with_sql("m", f", f as (select * from m where ts >= timestamp '{SINCE}' and ts < timestamp '{BEFORE}') select id, 0 as context from f union all select id, 1 from m where id in (select reply_id from f) and id not in (select id from f)"),
    "members_found": with_sql("p", f"select guild_id, user_id, username, {_NAME} as name from p where deleted_at is null and list_contains(regexp_extract_all(lower(concat_ws(' ', username, global_name, display_name, nick)), '[\\p{{L}}\\p{{N}}]+'), 'ropod') order by name nulls first, guild_id, user_id limit 1000"),
    "member_stats": with_sql("pm", f"select p.guild_id, p.user_id, p.username, count(m.id) as messages, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from p left join m on m.guild_id = p.guild_id and m.author_id = p.user_id where p.user_id = {_TOP} group by all"),
    "member_recent": with_sql("m", f"select id, guild_id, channel_id, epoch_us(ts) as created_us from m where author_id = {_TOP} order by ts desc nulls last, id desc limit 20"),
    "channels_below": with_sql("c", ", d as (select id from (select id from c where kind = 'category' order by id limit 10) union select c.id from d join c on c.parent_id = d.id) select id from d", True),
    "attachments_of_orders": with_sql("a", "select attachment_id, message_id, filename, size from a where contains(lower(filename), 'n.') and size >= 30"),
}
