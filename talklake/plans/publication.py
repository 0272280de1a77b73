"""What may be published, repaired or still has to be embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trees import up_the_tree
from ..sources.archive import Archive, with_sql
from ..sources.tables import table
from .listing import resolve_channel


def scope_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Scope of each channel: excluded if it or an ancestor is, unknown if an ancestor is missing or the path is a circle."""
    c = Archive(spark, sf).channels.select("id", "parent_id", (F.col("collection_scope") == "excluded").alias("barred"))
    t = up_the_tree(c, "parent_id", ["barred"])
    scope = F.when(F.col("barred"), "excluded").when(F.col("lost") | F.col("looped"), "unknown").otherwise("allowed")
    return t.select(F.col("id").alias("channel_id"), scope.alias("scope"))


def publish_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members who wrote a visible message in a channel that is allowed and not deleted."""
    a = Archive(spark, sf)
    c = a.channels.where("collection_scope = 'allowed' and deleted_at is null").select("guild_id", F.col("id").alias("channel_id"))
    authors = a.messages.where("not deleted and author_id is not null").select("guild_id", "channel_id", F.col("author_id").alias("user_id")).distinct().join(c, ["guild_id", "channel_id"], "left_semi")
    return a.members.where("deleted_at is null").join(authors, ["guild_id", "user_id"], "left_semi").select("guild_id", "user_id", "username")


def publish_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of each guild, and those of them in channels that may be published."""
    a = Archive(spark, sf)
    c = a.channels.where("collection_scope = 'allowed' and deleted_at is null").select("guild_id", F.col("id").alias("channel_id"), F.lit(1).alias("open"))
    per = a.messages.groupBy("guild_id", "channel_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("deleted")).alias("visible"))
    return per.join(c, ["guild_id", "channel_id"], "left").groupBy("guild_id").agg(F.sum("n").alias("candidates"), F.coalesce(F.sum(F.when(F.col("open") == 1, F.col("visible"))), F.lit(0)).alias("selected"))


def embedding_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with text that have no vector, per source kind."""
    d = table(spark, sf, "documents").where("trim(coalesce(text, '')) <> ''").select("doc_id", "doc_kind")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return d.join(e, "doc_id", "left_anti").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("pending"))


def channel_resolve(spark: SparkSession, sf: str, needle: str = "log") -> DataFrame:
    """Channels for a name: exact matches in any case if there are any, else those that contain it."""
    return resolve_channel(Archive(spark, sf), needle)


QUERIES = {f.__name__: f for f in (scope_decisions, publish_members, publish_counts, embedding_backlog, channel_resolve)}

SQL = {
    "scope_decisions": with_sql("c", ", up as (select id as root, parent_id, coalesce(collection_scope = 'excluded', false) as barred, false as looped, [id] as path from c union all select u.root, c.parent_id, coalesce(c.collection_scope = 'excluded', false), list_contains(u.path, c.id), list_append(u.path, c.id) from up u join c on c.id = u.parent_id where not u.looped) select root as channel_id, case when bool_or(barred) then 'excluded' when bool_or(looped or (parent_id is not null and not exists (select 1 from c t where t.id = up.parent_id))) then 'unknown' else 'allowed' end as scope from up group by 1", True),
    "publish_members": with_sql("cpm", "select guild_id, user_id, username from p where deleted_at is null and exists (select 1 from m join c on c.guild_id = m.guild_id and c.id = m.channel_id where not m.deleted and m.guild_id = p.guild_id and m.author_id = p.user_id and c.collection_scope = 'allowed' and c.deleted_at is null)"),
    "publish_counts": with_sql("cm", "select m.guild_id, count(*) as candidates, count(*) filter (not m.deleted and c.id is not null) as selected from m left join c on c.guild_id = m.guild_id and c.id = m.channel_id and c.collection_scope = 'allowed' and c.deleted_at is null group by 1"),
    "embedding_backlog": "select doc_kind, count(*) as pending from documents where trim(coalesce(text, ''), ' ') <> '' and doc_id not in (select vec_id from embeddings) group by 1",
    "channel_resolve": with_sql("c", ", h as (select guild_id, id, name, case when lower(name) = 'log' then 1 when name ilike '%log%' then 2 end as tier from c) select * from h where tier = (select min(tier) from h)"),
}
