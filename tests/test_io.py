"""Snapshots, the SQL door and streaming ingest."""

import pytest

from talklake.operators.changefeed import ChangeStore
from talklake.sources.snapshot import export, load, read_only_sql
from talklake.streaming.ingest import follow_changes


def test_snapshot_round_trip_and_sql_door(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "", 1.5)], "k int, s string, v double")
    m = export(spark, {"t": df}, f"file://{tmp_path}/snap")
    assert m["tables"]["t"]["rows"] == 2
    assert sorted(map(tuple, load(spark, f"file://{tmp_path}/snap", "t").collect())) == [(1, "a", None), (2, "", 1.5)]
    df.createOrReplaceTempView("door")
    assert read_only_sql(spark, "-- c\nselect count(*) n from door").first()[0] == 2
    with pytest.raises(ValueError):
        read_only_sql(spark, "drop view door")


def test_streamed_changes_equal_one_batch(spark, tmp_path):
    schema = "seq long, table_name string, op string, row_key string, recorded_at_ms long"
    parts = [[(1, "t", "i", '["1"]', 5), (2, "t", "d", '["2"]', 9)], [(3, "t", "i", '["2"]', 8), (4, "t", "u", '["3"]', 1)], [(1, "t", "i", '["1"]', 5)]]
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow_changes(spark, f"{tmp_path}/in", schema, f"file://{tmp_path}/store", f"{tmp_path}/ck").awaitTermination()
    assert sorted(map(tuple, ChangeStore(spark, f"file://{tmp_path}/store").rows().collect())) == [("t", '["1"]', 5), ("t", '["3"]', 1)]
