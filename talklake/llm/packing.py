"""Items in fixed-capacity containers, planned over the histogram of lengths."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices a length's items are ranked in, so that a length shared by a third of all rows isn't one task's work.
SLICES = 64


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, largest first, over counts of lengths: rows (size, rank_from, rank_to, container, stride).

    Items of `size` with rank in [rank_from, rank_to) take container + (rank - rank_from) // stride. Containers with
    the same room left are one group of consecutive numbers, so the work and the plan grow with the number of different
    lengths, at most the capacity, not with the number of items.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # rooms in which groups are open, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first container, number)
    fresh = 0

    def put(room: int, first: int, number: int) -> None:
        if room > 0 and number:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, number))

    for size in sorted((s for s, n in counts.items() if s > 0 and n > 0), reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    rows.append((size, rank, rank + full * each, fresh, each))
                    put(capacity - each * size, fresh, full)
                if rest:
                    rows.append((size, rank + full * each, rank + left, fresh + full, each))
                    put(capacity - rest * size, fresh + full, 1)
                fresh += full + bool(rest)
                break
            room = rooms[at]
            first, number = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            used = min(number, left)
            rows.append((size, rank, rank + used, first, 1))
            put(room, first + used, number - used)
            put(room - size, first, used)
            rank, left = rank + used, left - used
    return rows


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, piece_tokens, container): every item in a container whose sizes add up to at most `capacity`.

    An item above the capacity is divided into pieces: full ones, each alone in a container, and the rest, which
    is packed as any other. Items of size 0 (or null) take no room and go to container 0. An empty input gives no rows;
    repeated keys are items of their own. Only the histogram, at most `capacity` rows, comes to the driver; items take
    their planned slots by a join on length and rank within the length.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = items.sparkSession
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    it = items.select(F.col(key).alias("_key"), n.alias("_n"))
    it = it.withColumn("_pieces", F.greatest(F.lit(1), F.ceil(F.col("_n") / capacity)).cast("int"))
    it = it.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    it = it.withColumn("_size", F.least(F.lit(capacity), F.col("_n") - F.col("piece").cast("long") * capacity).cast("int"))
    it = it.withColumn("_slice", F.pmod(F.xxhash64("_key", "piece"), F.lit(SLICES)).cast("int"))
    cells = it.where("_size > 0").groupBy("_size", "_slice").agg(F.count(F.lit(1)).alias("_c")).collect()  # <= capacity * SLICES rows
    counts: dict[int, int] = {}
    starts = []
    for s, c, k in sorted((r["_size"], r["_slice"], r["_c"]) for r in cells):
        starts.append((s, c, counts.get(s, 0)))
        counts[s] = counts.get(s, 0) + k
    rows = plan(counts, capacity)
    offsets = spark.createDataFrame(starts, "_size int, _slice int, _start long")
    slots = spark.createDataFrame(rows, "_size int, _from long, _to long, _first long, _each long")
    w = Window.partitionBy("_size", "_slice").orderBy("_key", "piece")
    ranked = it.where("_size > 0").withColumn("_rank", F.row_number().over(w) - 1).join(F.broadcast(offsets), ["_size", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    placed = ranked.join(F.broadcast(slots), "_size").where("_rank >= _from and _rank < _to")
    placed = placed.select("_key", "piece", "_size", (F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each"))).alias("container"))
    empty = it.where("_size <= 0").select("_key", "piece", F.lit(0).alias("_size"), F.lit(0).cast("long").alias("container"))
    return placed.unionByName(empty).select(F.col("_key").alias(key), "piece", F.col("_size").cast("long").alias("piece_tokens"), "container")
