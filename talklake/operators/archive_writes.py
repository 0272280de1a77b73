"""Batch writes of the archive: which row stays, deletions, children of messages, cursors, events, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant, none_if_empty


def keep_newer(stored: DataFrame, incoming: DataFrame, observed: str | None = None, started: str | None = None, shape: list[str] = []) -> DataFrame:
    """Messages (id, edited_at, deleted_at, content and others) after a batch: one row per id, `kept` says which side.

    A stored tombstone always stays. Otherwise the later edit wins, whatever else differs; none is before any. With equal
    edits a stored row that was observed (instant in `observed`) after the batch's observation began (`started`) stays.
    Then an incoming row without content and without deletion doesn't clear a known content as long as the fields in
    `shape` are the same. In all other cases the incoming row wins. Of several incoming rows of an id the latest edit counts.
    """
    names = [c for c in stored.columns if c != observed]
    edit = F.coalesce(instant("edited_at"), F.timestamp_micros(F.lit(-(2**60))))
    gone = none_if_empty(F.trim("deleted_at")).isNotNull()
    text = F.coalesce("content", F.lit(""))
    facts = [edit.alias("edit"), gone.alias("gone"), text.alias("text"), F.struct(*shape).alias("shape") if shape else F.lit(1).alias("shape")]
    latest = Window.partitionBy("id").orderBy(edit.desc(), gone.desc(), text.desc(), F.xxhash64(*names))
    one = incoming.withColumn("_r", F.row_number().over(latest)).where("_r = 1")
    s = stored.select("id", F.struct(*names).alias("_s"), F.struct(*facts, (F.col(observed) if observed else F.lit(None).cast("timestamp")).alias("seen")).alias("_sf"))
    i = one.select("id", F.struct(*names).alias("_i"), F.struct(*facts, (F.col(started) if started else F.lit(None).cast("timestamp")).alias("start")).alias("_if"))
    j = s.join(i, "id", "full_outer")
    stay = (
        F.when(F.col("_i").isNull(), True)
        .when(F.col("_s").isNull(), False)
        .when(F.col("_sf.gone"), True)
        .when(F.col("_if.edit") != F.col("_sf.edit"), F.col("_if.edit") < F.col("_sf.edit"))
        .when(F.col("_sf.seen") > F.col("_if.start"), True)
        .when((F.col("_if.text") != "") | F.col("_if.gone"), False)
        .otherwise((F.col("_sf.text") != "") & F.col("_sf.shape").eqNullSafe(F.col("_if.shape")))
    )
    return j.select(F.when(stay, F.col("_s")).otherwise(F.col("_i")).alias("_k"), F.when(stay, "stored").otherwise("incoming").alias("kept")).select("_k.*", "kept")


def mark_deleted(rows: DataFrame, gone: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Rows with deleted_at and deletion_source set for the keys in `gone` (keys, at); an earlier deletion stays.

    A key without a row gets a stub: its keys, the deletion and nulls.
    """
    g = gone.groupBy(*keys).agg(F.min("at").alias("_at"))
    j = rows.withColumn("_row", F.lit(True)).join(g, keys, "full_outer")
    already = none_if_empty("deleted_at").isNotNull()
    hit = F.col("_at").isNotNull() & ~F.coalesce(already, F.lit(False))
    out = j.withColumn("deletion_source", F.when(hit, source).otherwise(F.col("deletion_source"))).withColumn("deleted_at", F.when(hit, F.col("_at")).otherwise(F.col("deleted_at")))
    return out.select(*rows.columns)


def delete_guild(tables: dict[str, DataFrame], guilds: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the guilds (id): by guild_id, or by id in the table guilds; null guilds stay."""
    g = guilds.select(F.col("id").alias("_g")).distinct()
    return {n: df.join(g, F.col("id" if n == "guilds" else "guild_id") == F.col("_g"), "left_anti") for n, df in tables.items()}


def reconcile(stored: DataFrame, incoming: DataFrame, parents: DataFrame, parent: str, keys: list[str], kept: list[str] = []) -> DataFrame:
    """Children (attachments, mentions) of the parents that were read again: their rows with `op`.

    op is insert, update, delete or same. Children of other parents are untouched and left out. Columns in `kept` come from
    the stored row where the incoming one has none, as local media and extracted texts do.
    """
    names = [c for c in stored.columns if c not in keys]
    plain = [c for c in names if c not in kept]
    s = stored.join(parents.select(parent).distinct(), parent, "left_semi").select(*keys, F.struct(*names).alias("_s"))
    i = incoming.dropDuplicates(keys).select(*keys, F.struct(*names).alias("_i"))
    j = s.join(i, keys, "full_outer")
    same = F.struct(*[F.col(f"_s.{c}") for c in plain]).eqNullSafe(F.struct(*[F.col(f"_i.{c}") for c in plain]))
    op = F.when(F.col("_s").isNull(), "insert").when(F.col("_i").isNull(), "delete").when(same, "same").otherwise("update")
    value = lambda c: F.coalesce(F.col(f"_i.{c}"), F.col(f"_s.{c}")) if c in kept else F.when(F.col("_i").isNull(), F.col(f"_s.{c}")).otherwise(F.col(f"_i.{c}"))
    return j.select(*keys, *[value(c).alias(c) for c in names], op.alias("op"))


def advance(state: DataFrame, new: DataFrame) -> DataFrame:
    """Cursors (scope, cursor) that only move forward, as numbers; a cursor that is no number loses to one that is."""
    both = state.select("scope", "cursor", F.lit(0).alias("_new")).unionByName(new.select("scope", "cursor", F.lit(1).alias("_new")))
    number = F.col("cursor").try_cast("decimal(38,0)")
    return both.groupBy("scope").agg(F.max_by("cursor", F.struct(F.coalesce(number, F.lit(-1).cast("decimal(38,0)")), -F.col("_new"))).alias("cursor"))


def append_events(stored: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """New events whose identity isn't stored yet, each once; nulls are equal."""
    key = lambda df: df.withColumn("_key", F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256))
    return key(new).dropDuplicates(["_key"]).join(key(stored).select("_key"), "_key", "left_anti").drop("_key")


def evidence(payloads: DataFrame, payload: str, at: str) -> DataFrame:
    """(sha256, payload, first_at, last_at, observations): each different payload once; nulls are none."""
    p = payloads.where(F.col(payload).isNotNull()).groupBy(F.sha2(payload, 256).alias("sha256"))
    return p.agg(F.first(payload).alias("payload"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("observations"))


def apply_roles(guild_raw: Column, role: Column) -> Column:
    """Roles of a guild's JSON after one of them was replaced or added, as an array of (id, permissions, name)."""
    roles = F.from_json(guild_raw, "roles array<struct<id:string,permissions:string,name:string>>")["roles"]
    return F.concat(F.filter(F.coalesce(roles, F.array().cast("array<struct<id:string,permissions:string,name:string>>")), lambda r: r["id"] != role["id"]), F.array(role))
