"""What holds on the way up a tree of references, by pointer doubling: no limit on depth, log rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release


def up_the_tree(nodes: DataFrame, parent: str, flags: list[str]) -> DataFrame:
    """(id, flags, lost, looped): each flag is true if it is for the node or anything above it.

    nodes: id (unique), `parent` and boolean flags; null flags are false. lost: the way up ends at a parent that has no row.
    looped: it never ends. Every round doubles the stretch of the way that has been seen; a way that hasn't ended after as
    many rounds as the logarithm of the number of nodes is a circle, and has been seen whole by then.
    """
    known = nodes.select(F.col("id").alias("_up"), F.lit(True).alias("_known"))
    state = nodes.select("id", F.col(parent).alias("_up"), *[F.coalesce(f, F.lit(False)).alias(f) for f in flags]).join(known, "_up", "left")
    state = state.withColumn("lost", F.col("_up").isNotNull() & F.col("_known").isNull()).withColumn("_up", F.when(F.col("_known"), F.col("_up")))
    seen = [*flags, "lost"]
    state = materialise(state.select("id", "_up", *seen), "tree")
    left = max(1, state.count()).bit_length() + 1
    while left and not state.where("_up is not null").isEmpty():
        step = state.select(F.col("id").alias("_up"), F.col("_up").alias("_next"), *[F.col(f).alias(f"_{f}") for f in seen])
        new = state.join(step, "_up", "left").select("id", F.col("_next").alias("_up"), *[(F.col(f) | F.coalesce(f"_{f}", F.lit(False))).alias(f) for f in seen])
        new = materialise(new, "tree")
        release(state)
        state, left = new, left - 1
    return state.select("id", *seen, F.col("_up").isNotNull().alias("looped"))
