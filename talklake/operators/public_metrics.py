"""Public metrics kept apart from the archive: observations are checked, and only their ids make them the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant

#: Kinds of metrics, and the longest names of what they are about; fixed values.
KINDS, MOST_ENTITY, MOST_TARGET = ("counter", "daily"), 200, 300


def valid() -> Column:
    """Whether an observation has a type, names, readable instants and, as a metric, a kind and a value that can be."""
    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    named = text("entity") & text("target") & text("provenance") & text("kind") & (F.length("entity") <= MOST_ENTITY) & (F.length("target") <= MOST_TARGET)
    timed = instant("ts").isNotNull() & instant("observed_at").isNotNull()
    value = F.col("value").isNull() | (~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < float("inf")))
    metric = (F.col("type") == "metric") & text("metric") & F.col("kind").isin(*KINDS) & value
    return F.coalesce(named & timed & (metric | (F.col("type") == "event")), F.lit(False))


def write(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Valid observations that aren't stored yet, each id once, the first by sequence; a row without an id goes by its hash.

    Repeated and falling values under other ids stay: only ids make observations the same.
    """
    names = [c for c in rows.columns if c not in ("id", "sequence")]
    r = rows.where(valid()).withColumn("id", F.when(F.coalesce("id", F.lit("")) != "", F.col("id")).otherwise(F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)))
    r = r.groupBy("id").agg(F.min_by(F.struct(*names, "sequence"), "sequence").alias("_s")).select("id", "_s.*")
    return r if stored is None else r.join(stored.select("id"), "id", "left_anti")


def status(rows: DataFrame) -> DataFrame:
    """Per type: observations, entities, the last sequence and the latest instant."""
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.max("sequence").alias("last_sequence"), F.max(F.unix_micros(instant("ts"))).alias("latest_us"))
