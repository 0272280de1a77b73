"""Current state of tables from a feed of inserts, updates and deletes, by upserts in one embedded DuckDB per bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import bare
from .store import BucketStore

STATE = "table_name string, row_key string, ms long, seq long, live boolean"
_ARROW = pa.schema([("table_name", pa.string()), ("row_key", pa.string()), ("ms", pa.int64()), ("seq", pa.int64()), ("live", pa.bool_())])
#: Keys that a DuckDB instance holds before it hands its rows on (map side only, where a key may come again).
COMBINE_KEYS = 200_000

_UPSERT = """
insert into state
select table_name, row_key, ms, seq, live from feed
qualify row_number() over (partition by table_name, row_key order by ms desc, seq desc, live) = 1
on conflict (table_name, row_key) do update set ms = excluded.ms, seq = excluded.seq, live = excluded.live
where excluded.ms > state.ms or (excluded.ms = state.ms and excluded.seq > state.seq)
"""


def read_changes(change_log: DataFrame) -> DataFrame:
    """Changes in canonical form (table_name, row_key, ms, seq, live).

    op is readable as i/insert, u/update or d/delete in any case with white space around; table_name comes out trimmed
    in lower case, row_key as a JSON array of strings without white space between its parts. Other rows, and rows
    without table or recorded_at_ms, are no changes. A null seq orders before all others.
    """
    op = F.lower(bare("op"))
    key = F.when(F.col("row_key").rlike(r"^\s*\[[\s\S]*\]\s*$"), F.from_json("row_key", "array<string>"))
    out = change_log.select(
        F.lower(bare("table_name")).alias("table_name"),
        F.to_json(key, {"ignoreNullFields": "false"}).alias("row_key"),
        F.col("recorded_at_ms").cast("long").alias("ms"),
        F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"),
        F.when(op.isin("i", "insert", "u", "update"), True).when(op.isin("d", "delete"), False).alias("live"),
    )
    return out.where("table_name is not null and row_key is not null and ms is not null and live is not null")


def _upserts(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": "false"})

        def export() -> list[pa.RecordBatch]:
            rows = con.sql("select * from state").to_arrow_table().cast(_ARROW)
            con.execute("drop table state")
            create()
            return rows.to_batches(max_chunksize=10_000)

        def create() -> None:
            con.execute("create table state (table_name varchar, row_key varchar, ms bigint, seq bigint, live boolean, primary key (table_name, row_key))")

        create()
        held = 0
        for batch in batches:
            if batch.num_rows:
                con.register("feed", pa.Table.from_batches([batch]))
                con.execute(_UPSERT)
                con.unregister("feed")
                held += batch.num_rows
            if limit and held >= limit:
                held = con.execute("select count(*) from state").fetchall()[0][0]
                if held >= limit:
                    yield from export()
                    held = 0
        yield from export()
        con.close()

    return run


class ChangeStore(BucketStore):
    """Latest change per key, tombstones included, in buckets of files; a manifest names the published generation."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        super().__init__(spark, path, ["table_name", "row_key"], buckets)

    def apply(self, changes: DataFrame, rows: int | None = None) -> None:
        """Fold one batch of canonical changes into the state and publish all its buckets at once.

        Batches may come in any order and more than once: an upsert only takes effect if its (ms, seq) is
        above the stored one, and tombstones keep theirs. Each map task first upserts what it reads into a DuckDB
        of its own, so a key with a third of all changes sends one row per task. Only the buckets of the batch's keys
        are read and replaced. A batch whose writer died can be applied again.
        """
        changes = changes.select("table_name", "row_key", "ms", "seq", "live")
        self.plan_buckets(changes.count() if rows is None else rows)
        feed = changes.mapInArrow(_upserts(COMBINE_KEYS), STATE)
        if self.files("state"):
            touched = [r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect()]  # at most self.buckets
            known = self.read("state", touched)
            feed = feed if known is None else feed.unionByName(known)
        placed = feed.repartition(self.buckets, self.bucket())
        self.write(placed.mapInArrow(_upserts(0), STATE), "state", replace=True, placed=True)
        self.publish()

    def state(self) -> DataFrame:
        """Latest change of every key, deleted keys with live = false."""
        known = self.read("state")
        return self.spark.createDataFrame([], STATE) if known is None else known

    def rows(self) -> DataFrame:
        """Keys that exist: (table_name, row_key, changed_ms)."""
        return self.state().where("live").select("table_name", "row_key", F.col("ms").alias("changed_ms"))
