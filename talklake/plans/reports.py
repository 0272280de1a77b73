"""Activity reports, listings and integrity queries, each one pass where a loop of queries would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.trees import up_the_tree
from ..sources.archive import Archive, with_sql
from ..sources.tables import table

#: End of the reporting window of digest, trends and quiet in the named queries, and its length in days.
UNTIL, DAYS, TOP = "2025-12-01 00:00:00", 28, 3
#: The same end for mentions, whose table is of other years.
MENTIONS_UNTIL = "1995-06-01 00:00:00"
_D_SINCE = f"timestamp '{UNTIL}' - interval '{DAYS} days'"
TEXT_KINDS = ("text", "announcement", "news")
TREND_KINDS = (*TEXT_KINDS, "thread_public", "thread_private", "thread_announcement", "thread_news")
_kinds = lambda k: "(" + ", ".join(f"'{x}'" for x in k) + ")"


def _rows() -> Column:
    return F.count(F.lit(1))


def in_window(df: DataFrame, until: str = UNTIL, days: int = DAYS, at: str = "ts") -> DataFrame:
    """Rows of a half-open window whose ends are whole milliseconds, as the reports compare instants.

    The table is partitioned by month and clustered by instant: both conditions reach the scan.
    """
    end = F.lit(until).cast("timestamp")
    since = end - F.make_dt_interval(F.lit(days))
    t = F.col(at)
    return df.where((F.col("month") >= F.date_format(since, "yyyy-MM")) & (F.col("month") <= F.date_format(end, "yyyy-MM")) & (t >= since) & (t < end))


def of(df: DataFrame, guild: str | None = None, channel: str | None = None) -> DataFrame:
    """Rows of one guild and one channel, where they are given."""
    df = df if guild is None else df.where(F.col("guild_id") == guild)
    return df if channel is None else df.where(F.col("channel_id") == channel)


_D_WINDOW = f"date_trunc('milliseconds', ts) >= {_D_SINCE} and date_trunc('milliseconds', ts) < timestamp '{UNTIL}'"


def author_name(p: str = "") -> Column:
    """Display name, nick, global name, user name, else the id."""
    return F.coalesce(*[F.col(p + c) for c in ("display_name", "nick", "global_name", "username")])


def digest_channels(spark: SparkSession, sf: str, until: str = UNTIL, days: int = DAYS, guild: str | None = None, channel: str | None = None) -> DataFrame:
    """Messages, replies and active authors per catalogued channel; channels without messages are left out."""
    a = Archive(spark, sf)
    m = of(in_window(a.messages, until, days), guild, channel).groupBy("guild_id", "channel_id").agg(_rows().alias("messages"), F.count("reply_id").alias("replies"), F.countDistinct("author_id").alias("active_authors"))
    c = a.channels.select("guild_id", F.col("id").alias("channel_id"), F.coalesce(F.nullif("name", F.lit("")), "id").alias("channel_name"), F.coalesce("kind", F.lit("")).alias("kind"))
    return m.join(c, ["guild_id", "channel_id"]).select("guild_id", "channel_id", "channel_name", "kind", "messages", "replies", "active_authors")


def digest_top_posters(spark: SparkSession, sf: str, until: str = UNTIL, days: int = DAYS, top: int = TOP, guild: str | None = None, channel: str | None = None) -> DataFrame:
    """The top posters of every channel in one pass; equal counts go by name, then id."""
    a = Archive(spark, sf)
    m = of(in_window(a.messages, until, days), guild, channel).where("author_id is not null").groupBy("guild_id", "channel_id", "author_id").agg(_rows().alias("messages"))
    p = a.members.select("guild_id", F.col("user_id").alias("author_id"), author_name().alias("name"))
    m = m.join(p, ["guild_id", "author_id"], "left").withColumn("name", F.coalesce("name", "author_id"))
    w = Window.partitionBy("guild_id", "channel_id").orderBy(F.desc("messages"), "name", "author_id")
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("guild_id", "channel_id", "place", "author_id", "name", "messages")


def digest_top_mentions(spark: SparkSession, sf: str, until: str = MENTIONS_UNTIL, days: int = DAYS, top: int = TOP, channel: str | None = None) -> DataFrame:
    """The top mentioned names of every channel by the instant of the mention; equal counts go by type, then name."""
    end = F.lit(until).cast("timestamp")
    m = of(Archive(spark, sf).mentions, channel=channel).where((F.col("event_us") >= F.unix_micros(end - F.make_dt_interval(F.lit(days)))) & (F.col("event_us") < F.unix_micros(end)))
    m = m.groupBy("channel_id", "target_type", "target_name").agg(_rows().alias("mentions"))
    w = Window.partitionBy("channel_id").orderBy(F.desc("mentions"), "target_type", "target_name")
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def digest_totals(spark: SparkSession, sf: str, until: str = UNTIL, days: int = DAYS, guild: str | None = None, channel: str | None = None) -> DataFrame:
    """Totals of the window; messages of channels outside the catalogue count."""
    m = of(in_window(Archive(spark, sf).messages, until, days), guild, channel)
    return m.agg(_rows().alias("messages"), F.count("reply_id").alias("replies"), F.countDistinct("author_id").alias("authors"), F.countDistinct("guild_id", "channel_id").alias("channels"))


def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    """All counts in one row, tombstoned rows included, with the latest message."""
    a = Archive(spark, sf)
    m = a.messages.agg(_rows().alias("messages"), F.max("ts").alias("t"))
    rows = a.channels.agg(_rows().alias("channels")).withColumn("k", F.lit(1)).join(a.members.agg(_rows().alias("members")).withColumn("k", F.lit(1)), "k").join(m.withColumn("k", F.lit(1)), "k")
    return rows.select("messages", "channels", "members", F.unix_micros("t").alias("latest_us"))


def report_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, authors and channels of the last 1, 7 and 30 days, counted back from the latest message, by one scan."""
    m = Archive(spark, sf).messages.where("ts is not null").select("ts", "author_id", "channel_id")
    last = m.agg(F.max("ts")).first()[0]
    days = F.explode(F.filter(F.array(*[F.lit(d) for d in (1, 7, 30)]), lambda d: F.col("ts") >= F.lit(last) - F.make_dt_interval(d)))
    return m.withColumn("days", days).groupBy("days").agg(_rows().alias("messages"), F.countDistinct("author_id").alias("authors"), F.countDistinct("channel_id").alias("channels"))


def recent(df: DataFrame, days: int) -> DataFrame:
    """Messages of the last days, counted back from the latest one."""
    last = df.agg(F.max("ts")).first()[0]
    since = F.lit(last) - F.make_dt_interval(F.lit(days))
    return df.where((F.col("month") >= F.date_format(since, "yyyy-MM")) & (F.col("ts") >= since))


def top_channels(spark: SparkSession, sf: str, days: int = 7, limit: int = 8) -> DataFrame:
    """The busiest channels of the last days; a channel without a name goes by its id."""
    a = Archive(spark, sf)
    m = recent(a.messages, days).groupBy("channel_id").agg(_rows().alias("messages"))
    c = a.channels.select(F.col("id").alias("channel_id"), "name")
    m = m.join(c, "channel_id", "left").withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "channel_id"))
    return m.orderBy(F.desc("messages"), "name", "channel_id").limit(limit)


def top_authors(spark: SparkSession, sf: str, days: int = 7, limit: int = 8) -> DataFrame:
    """Who wrote most in the last days."""
    a = Archive(spark, sf)
    m = recent(a.messages, days).groupBy("guild_id", "author_id").agg(_rows().alias("n"))
    p = a.members.select("guild_id", F.col("user_id").alias("author_id"), author_name().alias("name"))
    m = m.join(p, ["guild_id", "author_id"], "left").withColumn("name", F.coalesce("name", "author_id", F.lit("unknown")))
    return m.groupBy("author_id", "name").agg(F.sum("n").alias("messages")).orderBy(F.desc("messages"), "name", F.asc_nulls_first("author_id")).limit(limit)


def busiest_days(spark: SparkSession, sf: str, days: int = 30, limit: int = 7) -> DataFrame:
    m = recent(Archive(spark, sf).messages, days).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(_rows().alias("messages"))
    return m.orderBy(F.desc("messages"), F.desc("day")).limit(limit)


def trends_weekly(spark: SparkSession, sf: str, until: str = UNTIL, weeks: int = 8, guild: str | None = None, channel: str | None = None) -> DataFrame:
    """Messages per channel and Monday week, as many weeks, zero where none was written."""
    a = Archive(spark, sf)
    this_week = F.date_trunc("WEEK", F.lit(until).cast("timestamp"))
    first_week = this_week - F.make_dt_interval(F.lit(7 * (weeks - 1)))
    weeks_ = F.explode(F.sequence(first_week, this_week, F.expr("interval 7 days")))
    grid = a.channels.where(F.col("kind").isin(*TREND_KINDS)).select("guild_id", F.col("id").alias("channel_id"), weeks_.alias("week"))
    grid = of(grid, guild, channel)
    written = a.messages.where((F.col("month") >= F.date_format(first_week, "yyyy-MM")) & (F.col("ts") >= first_week) & (F.col("ts") < this_week + F.expr("interval 7 days")))
    n = of(written, guild, channel).groupBy("guild_id", "channel_id", F.date_trunc("WEEK", "ts").alias("week")).agg(_rows().alias("n"))
    g = grid.join(n, ["guild_id", "channel_id", "week"], "left")
    return g.select("guild_id", "channel_id", F.date_format("week", "yyyy-MM-dd").alias("week"), F.coalesce("n", F.lit(0)).alias("messages"))


def quiet_channels(spark: SparkSession, sf: str, until: str = UNTIL, silent: int = 30, guild: str | None = None) -> DataFrame:
    """Text channels silent for so many days; -1 for those never written to."""
    a = Archive(spark, sf)
    last = a.messages.where("ts is not null").groupBy("guild_id", "channel_id").agg(F.max("ts").alias("last"))
    c = a.channels.where(F.col("kind").isin(*TEXT_KINDS)).select("guild_id", F.col("id").alias("channel_id"), "name")
    c = of(c, guild)
    days = F.floor((F.unix_micros(F.lit(until).cast("timestamp")) - F.unix_micros("last")) / F.lit(86_400_000_000))
    q = c.join(last, ["guild_id", "channel_id"], "left").withColumn("days_silent", F.coalesce(days, F.lit(-1)).cast("long"))
    return q.where(F.col("last").isNull() | (F.col("days_silent") >= silent)).select("guild_id", "channel_id", "name", "days_silent")


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    a = Archive(spark, sf)
    m = a.messages.where("not deleted").groupBy("guild_id", "channel_id").agg(_rows().alias("messages"), F.unix_micros(F.min("ts")).alias("oldest_us"), F.unix_micros(F.max("ts")).alias("newest_us"))
    c = a.channels.where("deleted_at is null").select("guild_id", F.col("id").alias("channel_id"), "name", "kind")
    synthetic = F.col("name").isin("") | (F.col("name") == F.concat(F.lit("channel-"), F.substring("channel_id", -6, 6))) | (F.col("name") == F.concat(F.lit("dm-"), F.substring("channel_id", -6, 6)))
    return c.join(m, ["guild_id", "channel_id"], "left").withColumn("messages", F.coalesce("messages", F.lit(0))).withColumn("synthetic", F.coalesce(synthetic, F.lit(False)).cast("int"))


def coverage_channels(spark: SparkSession, sf: str) -> DataFrame:
    return _coverage(spark, sf).select("guild_id", "channel_id", "kind", "messages", "synthetic", "oldest_us", "newest_us")


def coverage_guilds(spark: SparkSession, sf: str) -> DataFrame:
    return _coverage(spark, sf).groupBy("guild_id").agg(_rows().alias("channels"), F.sum("messages").alias("messages"), F.sum("synthetic").alias("synthetic"), F.min("oldest_us").alias("oldest_us"), F.max("newest_us").alias("newest_us"))


def catalog_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose channel has no row: how many, in how many channels, the oldest and the newest of them."""
    a = Archive(spark, sf)
    m = a.messages.where("channel_id <> ''").join(a.channels.select(F.col("id").alias("channel_id")), "channel_id", "left_anti")
    order = F.struct("ts", "id")
    return m.agg(_rows().alias("messages"), F.countDistinct("channel_id").alias("channels"), F.min_by("id", order).alias("oldest_id"), F.max_by("id", order).alias("newest_id"))


def messages_list(spark: SparkSession, sf: str) -> DataFrame:
    """The last 200 messages with text, with author and channel names; tombstoned members give no name."""
    a = Archive(spark, sf)
    m = a.messages.where("trim(coalesce(normalized_content, '')) <> ''").orderBy(F.desc_nulls_last("ts"), F.desc("id")).limit(200)
    p = a.members.where("deleted_at is null").select("guild_id", F.col("user_id").alias("author_id"), author_name().alias("author_name"))
    c = a.channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"))
    text = F.when(F.trim(F.coalesce("content", F.lit(""))) != "", F.col("content")).otherwise(F.col("normalized_content"))
    m = m.join(p, ["guild_id", "author_id"], "left").join(c, "channel_id", "left")
    return m.select("id", "guild_id", "channel_id", F.coalesce("channel_name", F.lit("")).alias("channel_name"), "author_id", F.coalesce("author_name", F.lit("")).alias("author_name"), F.unix_micros("ts").alias("created_us"), text.alias("content"), "reply_id")


def messages_thread_context(spark: SparkSession, sf: str) -> DataFrame:
    """The last 100 messages of each guild and the messages they answer that aren't among them."""
    a = Archive(spark, sf)
    m = a.messages.select("id", "guild_id", "reply_id", "ts")
    w = Window.partitionBy("guild_id").orderBy(F.desc_nulls_last("ts"), F.desc("id"))
    first = m.withColumn("_r", F.row_number().over(w)).where("_r <= 100").drop("_r")
    wanted = first.where("reply_id is not null").select(F.col("reply_id").alias("id")).distinct()
    extra = m.join(wanted, "id", "left_semi").join(first.select("id"), "id", "left_anti")
    return first.select("id", "guild_id", F.lit(0).alias("context")).unionByName(extra.select("id", "guild_id", F.lit(1).alias("context")))


def mentions_list(spark: SparkSession, sf: str) -> DataFrame:
    return Archive(spark, sf).mentions.orderBy(F.desc("event_us"), F.desc("event_id")).limit(200)


def members_list(spark: SparkSession, sf: str) -> DataFrame:
    p = Archive(spark, sf).members.where("deleted_at is null")
    return p.select("guild_id", "user_id", "username", author_name().alias("name"), "bot").orderBy(F.asc_nulls_first("name"), F.asc_nulls_first("username"), "guild_id", "user_id").limit(100)


def member_search(spark: SparkSession, sf: str) -> DataFrame:
    """Members with `nel` in one of their names, in any case."""
    p = Archive(spark, sf).members.where("deleted_at is null")
    hit = F.lit(False)
    for c in ("username", "global_name", "display_name", "nick"):
        hit = hit | F.coalesce(F.col(c).ilike("%nel%"), F.lit(False))
    return p.where(hit).select("guild_id", "user_id", "username", author_name().alias("name"))


def member_message_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = Archive(spark, sf).messages.where("author_id is not null and ts is not null")
    return m.groupBy("guild_id", "author_id").agg(_rows().alias("messages"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


def channel_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """First and last message id of each channel, compared as text."""
    return Archive(spark, sf).messages.groupBy("channel_id").agg(F.min("id").alias("oldest_id"), F.max("id").alias("newest_id"))


def channels_list(spark: SparkSession, sf: str) -> DataFrame:
    return Archive(spark, sf).channels.select("guild_id", "id", "kind", "name", "position", "parent_id")


def attachments_list(spark: SparkSession, sf: str) -> DataFrame:
    return Archive(spark, sf).attachments.where(F.col("filename").ilike("r.%") & (F.col("size") >= 40)).orderBy("attachment_id").limit(500)


def attachment_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names of each message joined in the order of attachment ids."""
    a = Archive(spark, sf).attachments
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attachment_id", "filename"))), lambda x: x["filename"]), ", ")
    return a.groupBy("message_id").agg(names.alias("filenames"), _rows().alias("attachments"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Per channel: messages, authors (an empty one counts as one) and the first and last instant."""
    m = Archive(spark, sf).messages.where("ts is not null").groupBy("channel_id").agg(_rows().alias("messages"), F.countDistinct(F.coalesce("author_id", F.lit(""))).alias("authors"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))
    return m


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    a = Archive(spark, sf)
    parts = [("guilds", a.guilds.where("deleted_at is null")), ("channels", a.channels), ("threads", a.channels.where("kind like 'thread%'")), ("members", a.members.where("deleted_at is null")), ("messages", a.messages), ("deleted_messages", a.messages.where("deleted"))]
    out = None
    for name, df in parts:
        row = df.agg(F.lit(name).alias("counter"), _rows().alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def scope_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Visible, total and embeddable messages of catalogued channels per guild."""
    a = Archive(spark, sf)
    c = a.channels.select("guild_id", F.col("id").alias("channel_id"))
    m = a.messages.join(c, ["guild_id", "channel_id"], "left_semi")
    text = F.trim(F.coalesce("normalized_content", F.lit(""))) != ""
    return m.groupBy("guild_id").agg(_rows().alias("total"), F.count_if(~F.col("deleted")).alias("visible"), F.count_if(~F.col("deleted") & text).alias("embeddable"), F.unix_micros(F.min(F.when(~F.col("deleted"), F.col("ts")))).alias("oldest_us"))


def channel_tombstone_ancestry(spark: SparkSession, sf: str) -> DataFrame:
    """Channels with a deleted channel among themselves and their ancestors; circles end."""
    c = Archive(spark, sf).channels.select("id", "parent_id", F.col("deleted_at").isNotNull().alias("tombstoned"))
    return up_the_tree(c, "parent_id", ["tombstoned"]).select(F.col("id").alias("channel_id"), "tombstoned")


def snowflake_times(spark: SparkSession, sf: str) -> DataFrame:
    m = Archive(spark, sf).messages.select("id")
    return m.select("id", (F.shiftright(F.col("id").try_cast("long"), 22) + F.lit(1420070400000)).alias("created_ms"))


def inline_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Ids mentioned in message texts with the member's name in the guild, by kind of mention."""
    a = Archive(spark, sf)
    x = a.messages.where("content like '%<@%'").select("id", "guild_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"<@!?([0-9]+)>"), F.lit(1)))).alias("user_id"))
    p = a.members.select("guild_id", "user_id", author_name().alias("name"))
    return x.join(p, ["guild_id", "user_id"], "left").select("id", "user_id", F.coalesce("name", F.lit("")).alias("name"))


QUERIES = {f.__name__: f for f in (digest_channels, digest_top_posters, digest_top_mentions, digest_totals, report_totals, report_windows, top_channels, top_authors, busiest_days, trends_weekly, quiet_channels, coverage_channels, coverage_guilds, catalog_integrity, messages_list, messages_thread_context, mentions_list, members_list, member_search, member_message_stats, channel_bounds, channels_list, attachments_list, attachment_names, conversations, status_counts, scope_stats, channel_tombstone_ancestry, snowflake_times, inline_mentions)}

_NAME = "coalesce(display_name, nick, global_name, username)"
_COVERAGE = with_sql("cm", """, n as (select guild_id, channel_id, count(*) as messages, epoch_us(min(ts)) as oldest_us, epoch_us(max(ts)) as newest_us from m where not deleted group by 1, 2),
v as (select c.guild_id, c.id as channel_id, kind, coalesce(messages, 0) as messages, coalesce(name in ('', 'channel-' || right(c.id, 6), 'dm-' || right(c.id, 6)), false)::int as synthetic, oldest_us, newest_us from c left join n on n.guild_id = c.guild_id and n.channel_id = c.id where c.deleted_at is null) """)

SQL = {
    "digest_channels": with_sql("cm", f"select c.guild_id, c.id as channel_id, coalesce(nullif(c.name, ''), c.id) as channel_name, coalesce(c.kind, '') as kind, count(*) as messages, count(reply_id) as replies, count(distinct author_id) as active_authors from c join m on m.guild_id = c.guild_id and m.channel_id = c.id where {_D_WINDOW} group by all"),
    "digest_top_posters": with_sql("pm", f", x as (select guild_id, channel_id, author_id, count(*) as messages from m where author_id is not null and {_D_WINDOW} group by all), y as (select x.*, coalesce({_NAME}, author_id) as name from x left join p on p.guild_id = x.guild_id and p.user_id = x.author_id) select guild_id, channel_id, row_number() over (partition by guild_id, channel_id order by messages desc, name, author_id)::int as place, author_id, name, messages from y qualify place <= {TOP}"),
    "digest_top_mentions": with_sql("e", f", x as (select channel_id, target_type, target_name, count(*) as mentions from e where event_us >= epoch_us(timestamp '{MENTIONS_UNTIL}' - interval '{DAYS} days') and event_us < epoch_us(timestamp '{MENTIONS_UNTIL}') group by all) select *, row_number() over (partition by channel_id order by mentions desc, target_type, target_name)::int as place from x qualify place <= {TOP}"),
    "digest_totals": with_sql("m", f"select count(*) as messages, count(reply_id) as replies, count(distinct author_id) as authors, count(distinct (guild_id, channel_id)) as channels from m where {_D_WINDOW}"),
    "report_totals": with_sql("cpm", "select (select count(*) from m) as messages, (select count(*) from c) as channels, (select count(*) from p) as members, (select epoch_us(max(ts)) from m) as latest_us"),
    "report_windows": with_sql("m", "select days::int as days, count(*) as messages, count(distinct author_id) as authors, count(distinct channel_id) as channels from m, (select unnest([1, 7, 30]) as days) where ts >= (select max(ts) from m) - to_days(days::int) group by 1"),
    "top_channels": with_sql("cm", "select channel_id, coalesce(nullif(c.name, ''), channel_id) as name, count(*) as messages from m left join c on c.id = m.channel_id where ts >= (select max(ts) from m) - to_days(7) group by 1, 2 order by messages desc, name, channel_id limit 8"),
    "top_authors": with_sql("pm", f"select author_id, coalesce({_NAME}, author_id, 'unknown') as name, count(*) as messages from m left join p on p.guild_id = m.guild_id and p.user_id = m.author_id where ts >= (select max(ts) from m) - to_days(7) group by 1, 2 order by messages desc, name, author_id nulls first limit 8"),
    "busiest_days": with_sql("m", "select strftime(ts, '%Y-%m-%d') as day, count(*) as messages from m where ts >= (select max(ts) from m) - to_days(30) group by 1 order by 2 desc, 1 desc limit 7"),
    "trends_weekly": with_sql("cm", f", w as (select unnest(generate_series(date_trunc('week', timestamp '{UNTIL}') - interval 49 days, date_trunc('week', timestamp '{UNTIL}')::timestamp, interval 7 days)) as week), n as (select guild_id, channel_id, date_trunc('week', ts) as week, count(*) as n from m group by all) select c.guild_id, c.id as channel_id, strftime(w.week, '%Y-%m-%d') as week, coalesce(n.n, 0) as messages from c cross join w left join n on n.guild_id = c.guild_id and n.channel_id = c.id and n.week = w.week where kind in {_kinds(TREND_KINDS)}"),
    "quiet_channels": with_sql("cm", f", l as (select guild_id, channel_id, max(ts) as last from m group by all), q as (select c.guild_id, c.id as channel_id, name, last, coalesce(floor((epoch_us(timestamp '{UNTIL}') - epoch_us(last)) / 86400000000.0), -1)::bigint as days_silent from c left join l on l.guild_id = c.guild_id and l.channel_id = c.id where kind in {_kinds(TEXT_KINDS)}) select guild_id, channel_id, name, days_silent from q where last is null or days_silent >= 30"),
    "coverage_channels": _COVERAGE + "select * from v",
    "coverage_guilds": _COVERAGE + "select guild_id, count(*) as channels, sum(messages)::bigint as messages, sum(synthetic)::bigint as synthetic, min(oldest_us) as oldest_us, max(newest_us) as newest_us from v group by 1",
    "catalog_integrity": with_sql("cm", "select count(*) as messages, count(distinct channel_id) as channels, arg_min(id, (ts, id)) as oldest_id, arg_max(id, (ts, id)) as newest_id from m where channel_id <> '' and not exists (select 1 from c where c.id = m.channel_id)"),
    "messages_list": with_sql("cpm", f", l as (select * from m where trim(coalesce(normalized_content, ''), ' ') <> '' order by ts desc nulls last, id desc limit 200) select l.id, l.guild_id, l.channel_id, coalesce(c.name, '') as channel_name, author_id, coalesce({_NAME}, '') as author_name, epoch_us(ts) as created_us, case when trim(coalesce(content, ''), ' ') <> '' then content else normalized_content end as content, reply_id from l left join p on p.guild_id = l.guild_id and p.user_id = l.author_id and p.deleted_at is null left join c on c.id = l.channel_id"),
    "messages_thread_context": with_sql("m", ", f as (select * from m qualify row_number() over (partition by guild_id order by ts desc nulls last, id desc) <= 100) select id, guild_id, 0 as context from f union all select id, guild_id, 1 from m where id in (select reply_id from f) and id not in (select id from f)"),
    "mentions_list": with_sql("e", "select * from e order by event_us desc, event_id desc limit 200"),
    "members_list": with_sql("p", f"select guild_id, user_id, username, {_NAME} as name, bot from p where deleted_at is null order by name nulls first, username nulls first, guild_id, user_id limit 100"),
    "member_search": with_sql("p", f"select guild_id, user_id, username, {_NAME} as name from p where deleted_at is null and (username ilike '%nel%' or global_name ilike '%nel%' or display_name ilike '%nel%' or nick ilike '%nel%')"),
    "member_message_stats": with_sql("m", "select guild_id, author_id, count(*) as messages, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from m where author_id is not null and ts is not null group by all"),
    "channel_bounds": with_sql("m", "select channel_id, min(id) as oldest_id, max(id) as newest_id from m group by 1"),
    "channels_list": with_sql("c", "select guild_id, id, kind, name, position, parent_id from c"),
    "attachments_list": with_sql("a", "select * from a where filename ilike 'r.%' and size >= 40 order by attachment_id limit 500"),
    "attachment_names": with_sql("a", "select message_id, string_agg(filename, ', ' order by attachment_id, filename) as filenames, count(*) as attachments from a group by 1"),
    "conversations": with_sql("m", "select channel_id, count(*) as messages, count(distinct coalesce(author_id, '')) as authors, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from m where ts is not null group by 1"),
    "status_counts": with_sql("cpm", "select 'guilds' as counter, count(*) as n from guilds where nullif(deleted_at, '') is null union all select 'channels', count(*) from c union all select 'threads', count(*) from c where kind like 'thread%' union all select 'members', count(*) from p where deleted_at is null union all select 'messages', count(*) from m union all select 'deleted_messages', count(*) from m where deleted"),
    "scope_stats": with_sql("cm", "select m.guild_id, count(*) as total, count(*) filter (not m.deleted) as visible, count(*) filter (not m.deleted and trim(coalesce(normalized_content, ''), ' ') <> '') as embeddable, epoch_us(min(ts) filter (not m.deleted)) as oldest_us from m where exists (select 1 from c where c.id = m.channel_id and c.guild_id = m.guild_id) group by 1"),
    "channel_tombstone_ancestry": with_sql("c", ", up as (select id as root, parent_id, deleted_at is not null as gone, [id] as path from c union all select up.root, c.parent_id, c.deleted_at is not null, list_append(up.path, c.id) from up join c on c.id = up.parent_id where not list_contains(up.path, c.id)) select root as channel_id, bool_or(gone) as tombstoned from up group by 1", True),
    "snowflake_times": with_sql("m", "select id, (try_cast(id as bigint) >> 22) + 1420070400000 as created_ms from m"),
    "inline_mentions": with_sql("pm", f", x as (select distinct id, guild_id, unnest(regexp_extract_all(content, '<@!?([0-9]+)>', 1)) as user_id from m where content like '%<@%') select x.id, x.user_id, coalesce({_NAME}, '') as name from x left join p on p.guild_id = x.guild_id and p.user_id = x.user_id"),
}
