"""State of streams whose session names no state store."""

import datetime as dt

from conftest import rows

from tablewarden.streaming import runner, usage


def test_windows_are_held_on_disk_with_users_by_growing_sketch(spark, tmp_path):
    """Whatever store the session has, windows are in RocksDB with bounded memory, and the session keeps its own settings."""
    day = dt.datetime(2024, 1, 1)
    few = [(d, f"u{u}" if u else None, "read", day + dt.timedelta(minutes=u)) for d in range(50) for u in range(d % 4)]
    many = [(99, f"u{u}", "api_call", day) for u in range(5000)]
    events = spark.createDataFrame(few + many, "dataset_id bigint, user_name string, access_type string, ts timestamp_ntz")
    events.write.parquet(str(tmp_path / "events"))
    folder, store = str(tmp_path / "out"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    own = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(store, own)
    try:
        query = usage.keep_updates(usage.windowed(runner.file_stream(spark, str(tmp_path / "events"), "*.parquet", events.schema)), folder)
        assert spark.conf.get(store) == own
    finally:
        spark.conf.set(store, before)
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert states and all(any(m.startswith("rocksdb") for m in s["customMetrics"]) for s in states)
    found = usage.updates_result(spark, folder, usage.windowed(events).schema)
    got = {r["dataset_id"]: r for r in found.collect()}
    assert rows(found.where("dataset_id < 99"), "dataset_id", "unique_users", "read_count") == sorted(
        ((d, max(0, d % 4 - 1), d % 4) for d in range(50) if d % 4), key=repr
    )
    assert abs(got[99]["unique_users"] - 5000) < 100 and got[99]["api_calls"] == 5000
    assert "approx_count_distinct" not in usage.windowed(events)._jdf.queryExecution().toString()
