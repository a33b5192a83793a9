"""Streams over many small files, one file per batch, against the batch forms."""

import datetime
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewarden.operators import requests, usage
from tablewarden.streaming import alerts as stream_alerts
from tablewarden.streaming import runner
from tablewarden.streaming import throttle as stream_throttle
from tablewarden.streaming import usage as stream_usage

NOW = datetime.datetime(2024, 1, 1)


@pytest.fixture
def events(spark, tmp_path):
    """Ordered events cut into five files; user u0 makes half of them."""
    rnd = random.Random(3)
    secs, data = 0.0, []
    for i in range(600):
        secs += rnd.choice([1, 5, 20, 300])
        user = "u0" if rnd.random() < 0.5 else f"u{rnd.randrange(1, 9)}"
        data.append((i, rnd.randrange(4), user, rnd.choice(list(usage.COUNTERS.values())), NOW + datetime.timedelta(seconds=secs)))
    schema = "request_id bigint, dataset_id bigint, user_name string, access_type string, ts timestamp_ntz"
    for n in range(5):
        spark.createDataFrame(data[n * 120 : (n + 1) * 120], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    return batch, lambda: runner.file_stream(spark, str(tmp_path / "in"), "*.parquet", batch.schema, 1), tmp_path


def test_usage(spark, events):
    batch, stream, tmp = events
    stream_usage.exact(stream(), str(tmp / "usage"))
    got = stream_usage.exact_result(spark, str(tmp / "usage"), batch)
    want = usage.daily(batch)
    assert rows(got, *want.columns) == rows(want)


def test_runs_are_folded_and_hold_every_batch_once(spark, tmp_path):
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    folder, schema = str(tmp_path / "runs"), spark.createDataFrame([], "k bigint, n bigint").schema
    assert runner.read_runs(spark, folder, schema).count() == 0
    for batch in range(75):
        runner.add_run(spark.createDataFrame([(batch % 3, 1 << (batch % 20))], schema).coalesce(1), folder, batch, fold)
        if batch in (0, 6, 7, 8, 63, 64, 74):
            want = {}
            for b in range(batch + 1):
                want[b % 3] = want.get(b % 3, 0) + (1 << (b % 20))
            assert rows(fold(runner.read_runs(spark, folder, schema))) == sorted(want.items())
    assert len(runner.run_paths(spark, folder)) == 1 + 1 + 3  # 64, 8 and 3 batches
    runner.add_run(spark.createDataFrame([(74 % 3, 1 << 14)], schema).coalesce(1), folder, 74, fold)  # a replay
    assert rows(fold(runner.read_runs(spark, folder, schema))) == sorted(want.items())


def test_sketches_unite_over_batches(spark, events):
    batch, stream, tmp = events
    stream_usage.sketched(stream(), str(tmp / "sketched"))
    got = stream_usage.sketched_result(spark, str(tmp / "sketched"), batch).withColumn("unique_users", usage.estimated_users())
    want = usage.daily(batch)
    assert rows(got, *want.columns) == rows(want)  # so few users are counted exactly by a sketch
    whole = stream_usage.sketched_result(spark, str(tmp / "sketched"), batch, ["dataset_id"])
    users = batch.groupBy("dataset_id").agg(F.countDistinct("user_name").alias("n"))
    assert rows(whole.select("dataset_id", usage.estimated_users().alias("n"))) == rows(users)


def test_merged_latency_sketches_are_within_their_bound(spark):
    timed = spark.range(60_000).select(
        F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.xxhash64("id") % 2 == 0).cast("string").alias("path"),
        F.when(F.col("id") % 50 != 0, F.pow(F.rand(5), 4.0)).alias("latency_secs"),
    ).persist()
    stored = requests.latency_sketches(timed, ["path"])
    assert stored.count() > 1000
    for r in requests.merge_latencies(stored, ["path"]).select("path", "requests", *[requests.sketched_quantile(q).alias(f"q{int(100 * q)}") for q in (0.5, 0.95, 0.99)]).collect():
        one = timed.where((F.col("path") == r["path"]) & F.col("latency_secs").isNotNull())
        assert one.count() == r["requests"]
        for q in (0.5, 0.95, 0.99):
            assert abs(one.where(F.col("latency_secs") <= r[f"q{int(100 * q)}"]).count() / r["requests"] - q) < 0.01
    timed.unpersist()


def test_a_key_that_was_idle_for_long_keeps_its_window(spark, tmp_path):
    at = lambda s: NOW + datetime.timedelta(seconds=s)
    parts = [[("a", at(0)), ("b", at(1))], [("b", at(5000))], [("b", at(90_000)), ("a", at(30))]]
    schema = "throttle_key string, limit int, ts timestamp_ntz, request_id bigint"
    for n, part in enumerate(parts):
        spark.createDataFrame([(k, 1, t, 10 * n + i) for i, (k, t) in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = runner.file_stream(spark, str(tmp_path / "in"), "*.parquet", batch.schema, 1)
    stream_throttle.throttle(stream, str(tmp_path / "out"), 60)
    want = requests.throttle_windows(batch, 60)
    assert rows(stream_throttle.result(spark, str(tmp_path / "out")), *want.columns) == rows(want)


def test_throttle_crosses_batches(spark, events):
    batch, stream, tmp = events
    keyed = lambda df: df.select(F.col("user_name").alias("throttle_key"), F.lit(3).alias("limit"), "ts", "request_id")
    stream_throttle.throttle(keyed(stream()), str(tmp / "throttle"), 60)
    want = requests.throttle_windows(keyed(batch), 60)
    assert rows(stream_throttle.result(spark, str(tmp / "throttle")), *want.columns) == rows(want)
    refused = want.agg(F.sum("refused")).first()[0]
    assert refused > 0 and requests.throttle_refused(keyed(batch), 60).count() == refused


@pytest.mark.parametrize("files", [1, 5, 20])
def test_freshness_alerts_do_not_depend_on_the_batches(spark, tmp_path, files):
    rnd = random.Random(7)
    moments = sorted(rnd.randrange(0, 40 * 3600) for _ in range(200))
    data = [(1 if rnd.random() < 0.5 else rnd.randrange(2, 6), NOW + datetime.timedelta(seconds=s)) for s in moments]
    size = -(-len(data) // files)
    for n in range(files):
        spark.createDataFrame(data[n * size : (n + 1) * size], "dataset_id bigint, updated_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    limits = {1: (300, 300), 2: (600, 0), 3: (3600, 60), 4: (7200, 0), 6: (3600, 0)}  # 5 is not watched, 6 never updated
    config = spark.createDataFrame([(d, i, g, True) for d, (i, g) in limits.items()], "dataset_id bigint, expected_interval_secs bigint, grace_period_secs bigint, alert_on_stale boolean")
    updates = runner.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.read.parquet(str(tmp_path / "in")).schema, 1)
    start = int(NOW.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    stream_alerts.freshness_alerts(updates, config, str(tmp_path / "out"), start, cooldown_secs=900)
    got = rows(spark.read.schema(stream_alerts.ALERT_SCHEMA).parquet(str(tmp_path / "out" / "rows" / "batch=*")), "dataset_id", "alert_at_ms", "staleness_secs", "severity")
    end, want = start + moments[-1] * 1000, []
    for d, (interval, grace) in limits.items():
        ups = sorted({start, *(start + s * 1000 for s, (k, _) in zip(moments, data, strict=True) if k == d)})
        for a, z in zip(ups, [*ups[1:], end], strict=True):
            t = a + (interval + grace) * 1000 + 1
            while t < z:
                age = t - a
                want.append((d, t, age // 1000, "critical" if age >= 4000 * interval else "warning" if age >= 2000 * interval else "info"))
                t += 900_000
    assert got == sorted(want, key=repr)
