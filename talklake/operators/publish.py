"""What of an archive may be published, and how a published snapshot is merged."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant, none_if_empty

#: Bit of the permission to see a channel; fixed value.
VIEW_CHANNEL = 1 << 10


def everyone_permissions(guild_raw: Column, guild_id: Column) -> Column:
    """Permission bits of the role that has the guild's id, from the guild's JSON; null where they can't be read."""
    roles = F.from_json(guild_raw, "roles array<struct<id:string,permissions:string>>")["roles"]
    mine = F.get(F.filter(roles, lambda r: r["id"] == guild_id), F.lit(0))
    return F.when(mine.isNotNull(), F.coalesce(mine["permissions"], F.lit("0")).try_cast("long"))


def with_overwrites(permissions: Column, raw: Column, guild_id: Column) -> Column:
    """Bits after a channel's overwrites of that role: denied bits are taken away, then allowed ones added, one by one.

    Null where the JSON has no overwrites or their bits can't be read; an overwrite of a member is none of the role.
    """
    many = F.from_json(raw, "permission_overwrites array<struct<id:string,type:string,allow:string,deny:string>>")["permission_overwrites"]
    mine = F.filter(many, lambda o: (o["id"] == guild_id) & F.lower(o["type"]).isin("0", "role"))
    bits = lambda c: F.coalesce(c, F.lit("0")).try_cast("long")
    return F.aggregate(mine, permissions, lambda acc, o: acc.bitwiseAND(F.bitwise_not(bits(o["deny"]))).bitwiseOR(bits(o["allow"])))


def chosen(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Channels (id, parent_id, kind) by lists of ids: those in or below an excluded one are out; with an include list only
    these are in, and threads whose parent is. Null kinds are no threads."""
    out = df
    if exclude:
        out = out.where(~F.col("id").isin(exclude) & ~F.coalesce(F.col("parent_id").isin(exclude), F.lit(False)))
    if include:
        thread = F.coalesce(F.col("kind").startswith("thread_"), F.lit(False)) & F.coalesce(F.col("parent_id").isin(include), F.lit(False))
        out = out.where(F.col("id").isin(include) | thread)
    return out


def public_channels(channels: DataFrame, guilds: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, public): whether everyone may see a channel.

    channels: id, guild_id, parent_id, kind, raw_json; guilds: id, raw_json; ways: id, open, true where the channel and
    all above it are admitted and there. A private thread isn't public, another thread is as its parent; other channels
    are by the bits of the role everyone, after the overwrites of the category and then their own. What can't be read isn't.
    """
    c = channels.select("id", "guild_id", "parent_id", F.coalesce("kind", F.lit("")).alias("kind"), "raw_json")
    g = guilds.select(F.col("id").alias("guild_id"), F.col("raw_json").alias("_guild"))
    above = c.select(F.col("id").alias("parent_id"), F.col("kind").alias("_kind"), F.col("raw_json").alias("_raw"))
    j = c.join(g, "guild_id", "left").join(above, "parent_id", "left")
    bits = everyone_permissions(F.col("_guild"), F.col("guild_id"))
    bits = F.when(F.col("_kind") == "category", with_overwrites(bits, F.col("_raw"), F.col("guild_id"))).otherwise(bits)
    bits = with_overwrites(bits, F.col("raw_json"), F.col("guild_id"))
    sees = F.coalesce(bits.bitwiseAND(F.lit(VIEW_CHANNEL)) != 0, F.lit(False))
    own = j.select("id", "parent_id", "kind", sees.alias("sees")).join(ways.select("id", "open"), "id")
    thread = F.col("kind").startswith("thread_")
    parents = own.where(~thread).select(F.col("id").alias("parent_id"), (F.col("sees") & F.col("open")).alias("_parent"))
    shown = F.when(F.col("kind") == "thread_private", False).when(thread, F.coalesce("_parent", F.lit(False)) & F.col("open")).otherwise(F.col("sees") & F.col("open"))
    return own.join(parents, "parent_id", "left").select("id", F.coalesce(shown, F.lit(False)).alias("public"))


def publishable_scopes(state: DataFrame, channels: DataFrame, guilds: DataFrame) -> DataFrame:
    """Rows of sync state (scope) that may go out: of a published channel, without its private-thread cursor, or of a
    published guild, without its member marker. All others are local."""
    parts = F.split("scope", ":")
    kind, ident, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    s = state.withColumn("_kind", kind).withColumn("_id", ident).withColumn("_rest", F.coalesce(rest, F.lit("")))
    of_channel = s.where("_kind = 'channel' and _rest <> 'archived_private_threads_after'").join(channels.select(F.col("id").alias("_id")), "_id", "left_semi")
    of_guild = s.where("_kind = 'guild' and not scope like '%:members:last_success'").join(guilds.select(F.col("id").alias("_id")), "_id", "left_semi")
    return of_channel.unionByName(of_guild).drop("_kind", "_id", "_rest")


def allowed_members(messages: DataFrame, mentions: DataFrame) -> DataFrame:
    """(guild_id, user_id): authors of the messages, and users mentioned in guilds that have an author."""
    authors = messages.where("author_id is not null").select("guild_id", F.col("author_id").alias("user_id")).distinct()
    named = mentions.where("target_type = 'user'").select("guild_id", F.col("target_id").alias("user_id")).join(authors.select("guild_id").distinct(), "guild_id", "left_semi")
    return authors.unionByName(named).distinct()


def row_faults(rows: DataFrame, updated: str = "updated_at") -> Column:
    """What is wrong with an incoming row, null if nothing: its instant, or metadata of a deletion without one."""
    gone = none_if_empty(F.trim("deleted_at"))
    return F.when(instant(updated).isNull(), "updated_at").when(gone.isNotNull() & instant("deleted_at").isNull(), "deleted_at").when(gone.isNull() & (none_if_empty("deletion_source").isNotNull() | none_if_empty("deletion_reason").isNotNull()), "deletion")


def merge_snapshot(local: DataFrame, incoming: DataFrame, keys: list[str], checked: str | None = None) -> DataFrame:
    """Rows after merging a snapshot: the later revision wins; of equal ones a local deletion stays, unless both are deleted.

    Revisions are instants in updated_at; where one can't be read both are compared as text. `checked` is a local column
    with the last observation, which counts as the revision if it is later. `kept` says which side a row came from.
    """
    names = [c for c in local.columns if c != checked]
    gone = none_if_empty(F.trim("deleted_at")).isNotNull()
    rev = instant("updated_at")
    own = F.greatest(rev, F.col(checked)) if checked else rev
    l = local.select(*keys, F.struct(*names).alias("_l"), own.alias("_lr"), F.col("updated_at").alias("_lt"), gone.alias("_lg"))
    i = incoming.select(*keys, F.struct(*names).alias("_i"), rev.alias("_ir"), F.col("updated_at").alias("_it"), gone.alias("_ig"))
    j = l.join(i, keys, "full_outer")
    order = F.when(F.col("_lr").isNotNull() & F.col("_ir").isNotNull(), F.when(F.col("_ir") > F.col("_lr"), 1).when(F.col("_ir") < F.col("_lr"), -1).otherwise(0)).otherwise(
        F.when(F.coalesce("_it", F.lit("")) > F.coalesce("_lt", F.lit("")), 1).when(F.coalesce("_it", F.lit("")) < F.coalesce("_lt", F.lit("")), -1).otherwise(0)
    )
    take = F.when(F.col("_l").isNull(), True).when(F.col("_i").isNull(), False).when(order != 0, order > 0).otherwise(~F.col("_lg") | F.col("_ig"))
    return j.select(F.when(take, F.col("_i")).otherwise(F.col("_l")).alias("_k"), F.when(take, "incoming").otherwise("local").alias("kept")).select("_k.*", "kept")


def repair_guilds(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows with an empty guild_id filled from the parents (key, guild_id), such as a message's channel."""
    p = parents.where("guild_id <> ''").select(key, F.col("guild_id").alias("_g"))
    return rows.join(p, key, "left").withColumn("guild_id", F.coalesce(none_if_empty("guild_id"), "_g", "guild_id")).drop("_g").select(*rows.columns)


def policy_id(policy: dict) -> str:
    """Identity of a collection policy: the hash of its JSON with sorted keys and lists."""
    ordered = {k: sorted(v) if isinstance(v, (list, set, tuple)) else v for k, v in policy.items()}
    return hashlib.sha256(json.dumps(ordered, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def merge_plan(previous: dict | None, manifest: dict) -> dict[str, str]:
    """Per table what an import has to do: skip (as before), files (rows were added or columns at the end), replace."""
    out = {}
    before = (previous or {}).get("tables", {})
    for name, t in manifest.get("tables", {}).items():
        old = before.get(name)
        if old == t:
            out[name] = "skip"
        elif old and t["schema"].startswith(old["schema"]) and t["rows"] >= old["rows"]:
            out[name] = "files"
        else:
            out[name] = "replace"
    return out
