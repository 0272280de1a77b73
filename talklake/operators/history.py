"""Full history of changing attributes, rebuilt per affected chain.

The store keeps the raw observations and, per bucket of entities, the chain of versions built from them. A batch of
observations, new, late or corrected, is appended to the raw part; then the raw observations of just the touched
entities are read back, their chains rebuilt from scratch and the touched buckets replaced by the rename of one
manifest. A reader sees the state before or after a batch, never a part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_us, none_if_empty
from ..session import hot_keys
from .store import BucketStore

#: valid_to_us of a version that still holds.
OPEN = -1


def role_set(col: str) -> Column:
    """Roles as a sorted set of ids; null, empty, [] and unreadable text are the empty set."""
    ids = F.transform(F.from_json(F.col(col), "array<string>"), lambda x: F.trim(x))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))), F.array().cast("array<string>"))


def member_observations(members: DataFrame) -> DataFrame:
    """Observations (guild_id, user_id, at, present, state) of a members table.

    state holds display_name and nick, null for empty, and the role set. Rows without guild, user or a readable
    updated_at can't be placed in any chain and are left out.
    """
    gone = none_if_empty("deleted_at").isNotNull()
    state = F.struct(none_if_empty("display_name").alias("display_name"), none_if_empty("nick").alias("nick"), role_set("role_ids_json").alias("roles"))
    obs = members.select(F.trim("guild_id").alias("guild_id"), F.trim("user_id").alias("user_id"), instant_us("updated_at").alias("at"), (~gone).alias("present"), F.when(~gone, state).alias("state"))
    return obs.where((F.col("guild_id") != "") & (F.col("user_id") != "") & F.col("at").isNotNull())


def _neighbour(df: DataFrame, keys: list[str], step: int, names: list[str], hot: list) -> DataFrame:
    """df with `_n`, the struct of `names` of the row before (-1) or after (+1) within keys by `at`.

    Long chains, listed in hot, are cut into slices of equal time; a slice's outermost row gets its neighbour from a
    table of slice ends, which has as many rows as there are slices.
    """
    ends = F.lag if step < 0 else F.lead
    value = F.struct(*[F.col(n) for n in names])
    out = df.withColumn("_n", ends(value).over(Window.partitionBy(*keys, "_slice").orderBy("at")))
    if not hot:
        return out
    outer = (F.max_by if step < 0 else F.min_by)(value, F.col("at"))
    edge = df.where("_long").groupBy(*keys, "_slice").agg(outer.alias("_edge"))
    edge = edge.withColumn("_edge", ends("_edge").over(Window.partitionBy(*keys).orderBy("_slice")))
    return out.join(F.broadcast(edge), [*keys, "_slice"], "left").withColumn("_n", F.coalesce("_n", "_edge")).drop("_edge")


def build_versions(observations: DataFrame, keys: list[str], hot: list | None = None) -> DataFrame:
    """Versions (keys, state fields, valid_from_us, valid_to_us) of whole chains of observations.

    Observations of one key and instant are copies; one is kept. A version is a longest run of neighbouring
    observations with the entity present and an equal state (nulls are equal); it lasts until the next observation
    after the run, OPEN if there is none. An entity never present has no version.
    """
    obs = observations.withColumn("_long", F.lit(False)).withColumn("_slice", F.lit(0))
    hot = hot_keys(observations, keys, "at") if hot is None else hot
    if hot:
        h = observations.sparkSession.createDataFrame([tuple(r) for r in hot], ", ".join([*[f"{k} string" for k in keys], "_c long, _lo long, _hi long, _parts int"]))
        obs = observations.join(F.broadcast(h), keys, "left").withColumn("_long", F.col("_parts").isNotNull())
        width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.col("_parts")))
        obs = obs.withColumn("_slice", F.coalesce(F.floor((F.col("at") - F.col("_lo")) / width), F.lit(0)).cast("int")).drop("_c", "_lo", "_hi", "_parts")
    # the windows that follow share this partitioning and order
    first = Window.partitionBy(*keys, "_slice").orderBy("at", F.desc("present"), F.xxhash64("state"))
    obs = obs.withColumn("_before", F.lag("at").over(first)).where("_before is null or _before <> at").drop("_before")
    runs = _neighbour(obs, keys, -1, ["present", "state"], hot)
    runs = runs.where(F.col("_n").isNull() | ~F.struct("present", "state").eqNullSafe(F.col("_n"))).drop("_n")
    runs = _neighbour(runs, keys, 1, ["at"], hot)
    return runs.where("present").select(*keys, "state.*", F.col("at").alias("valid_from_us"), F.coalesce(F.col("_n.at"), F.lit(OPEN)).alias("valid_to_us"))


class HistoryStore(BucketStore):
    """Raw observations and version chains of one entity type under a path, in buckets of entities."""

    #: A bucket's raw observations are put together when they lie in more folders than this.
    COMPACT = 8

    def apply(self, observations: DataFrame) -> None:
        """Take in one batch: late and corrected observations rebuild the chains of their entities only.

        Buckets without an entity of the batch keep their files. A crash before the end leaves the last published state,
        and the batch can be applied again; one that was published already changes nothing when it comes again.
        """
        self.plan_buckets(observations.count())
        before = {b: list(paths) for b, paths in self.files("raw").items()}
        touched = self.write(observations, "raw", replace=False)
        if touched:
            new = self.read_paths("raw", [p for b in touched for p in self.files("raw")[b] if p not in before.get(b, ())])
            raw = self.read("raw", touched)
            old = self.read("chains", touched)
            if before:
                entities = new.select(*self.keys).distinct()
                rebuilt = build_versions(raw.join(entities, self.keys, "left_semi"), self.keys)
                if old is not None:
                    rebuilt = rebuilt.unionByName(old.join(entities, self.keys, "left_anti"))
            else:
                rebuilt = build_versions(raw, self.keys)
            # a bucket whose entities were never present has no chains
            self.forget("chains", touched)
            self.write(rebuilt, "chains", replace=True)
            many = [b for b in touched if len(self.files("raw")[b]) > self.COMPACT]
            if many:
                self.write(self.read("raw", many), "raw", replace=True)
        self.publish()

    def versions(self) -> DataFrame | None:
        """All versions of the generation at hand; None before the first."""
        return self.read("chains")
