"""Streaming forms, checked against their batch forms.

The events arrive as weeks, one after the other, each taken up by the stream before the next is there. So state
and results cross batches in every query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.exprs import ntz, utc_instant
from tablewarden.operators import usage as ops
from tablewarden.plans.registry import query
from tablewarden.plans.request_queries import _OPENED, _WINDOW, close_in_rank, limited
from tablewarden.plans.usage_queries import _COUNTERS, _DAILY, close_to_exact
from tablewarden.plans.views import Views
from tablewarden.streaming import alerts, audit, requests, runner, throttle, usage


_WEEKS = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]


def by_weeks(v: Views, run) -> None:
    """Call ``run`` with the views over the stream of events, once after each week has arrived."""
    folder, ts = runner.fresh_folder(v.spark, "events"), F.col("ts")
    ends = [ntz(f"{day} 00:00:00") for day in _WEEKS]
    parts = [ts < ends[0], *[(ts >= a) & (ts < z) for a, z in zip(ends[:-1], ends[1:])], ts.isNull() | (ts >= ends[-1])]
    for part in parts:
        v.events.where(part).write.mode("append").parquet(folder)
        s = Views(v.spark, v.folder)
        s._made["events"] = runner.file_stream(v.spark, folder, "*.parquet", v.events.schema)
        run(s)


@query("stream_usage_daily", _DAILY)
def stream_usage_daily(v):
    folder = runner.fresh_folder(v.spark, "usage")
    by_weeks(v, lambda s: usage.exact(s.access_events, folder))
    return usage.exact_result(v.spark, folder, v.access_events)


@query(
    "stream_usage_windowed",
    f"SELECT dataset_id, CAST(ts AS DATE) AS stat_date, {_COUNTERS} FROM {{access_events}} GROUP BY ALL",
)
def stream_usage_windowed(v):
    folder = runner.fresh_folder(v.spark, "usage-windowed")
    by_weeks(v, lambda s: usage.keep_updates(usage.windowed(s.access_events), folder))
    return usage.updates_result(v.spark, folder, usage.windowed(v.access_events).schema).drop("unique_users")


@query("stream_usage_sketched", f"SELECT dataset_id, stat_date, {', '.join(ops.COUNTERS)}, unique_users, true AS close FROM ({_DAILY}) d")
def stream_usage_sketched(v):
    """Users by sketches that the stream united, held against the exact ones: within 2 % and half a user."""
    folder = runner.fresh_folder(v.spark, "usage-sketched")
    by_weeks(v, lambda s: usage.sketched(s.access_events, folder))
    return close_to_exact(usage.sketched_result(v.spark, folder, v.access_events), ops.daily(v.access_events), ["dataset_id", "stat_date"])


@query(
    "stream_latency_sketches",
    """SELECT path, count(*) AS requests, true AS p95_close, true AS p99_close FROM {requests} WHERE latency_secs IS NOT NULL GROUP BY ALL""",
)
def stream_latency_sketches(v):
    folder = runner.fresh_folder(v.spark, "latency-sketches")
    by_weeks(v, lambda s: requests.sketch_latencies(s.requests, folder, ["path", "method"]))
    return close_in_rank(v.requests, requests.latencies_result(v.requests, folder, ["path", "method"], ["path"]), ["path"])


@query("stream_audit", "SELECT * FROM {audit_log}")
def stream_audit(v):
    folder = runner.fresh_folder(v.spark, "audit")
    by_weeks(v, lambda s: audit.append(s.audit_log, folder))
    return v.spark.read.schema(v.audit_log.schema).parquet(f"{folder}/log").select(*v.audit_log.columns)


@query(
    "stream_throttle",
    f"""{_OPENED} SELECT throttle_key, limit_n AS "limit", epoch_us(at_ts) AS opened_us, count(*) AS requests,
      least(count(*), limit_n) AS allowed, greatest(count(*) - limit_n, 0) AS refused FROM placed GROUP BY throttle_key, limit_n, at_ts""",
)
def stream_throttle(v):
    folder = runner.fresh_folder(v.spark, "throttle")
    by_weeks(v, lambda s: throttle.throttle(limited(s), folder, _WINDOW))
    return throttle.result(v.spark, folder)


@query(
    "stream_request_metrics",
    """SELECT slot, path, method, (status // 100) || 'xx' AS status_class, count(*) AS requests FROM (
      SELECT *, unnest([time_bucket(INTERVAL 1 MINUTE, ts, $TS '1970-01-01') - INTERVAL 1 MINUTE * k FOR k IN range(5)]) AS slot FROM {requests}) r
    GROUP BY ALL""",
)
def stream_request_metrics(v):
    folder = runner.fresh_folder(v.spark, "request-metrics")
    by_weeks(v, lambda s: requests.count_rates(s.requests, folder))
    return requests.rates_result(v.spark, folder)


_START_MS = 1704067200000  # 2024-01-01 00:00:00


@query(
    "stream_alerts",
    f"""
    WITH seen AS (SELECT max(epoch_us(ts) // 1000) AS m FROM {{access_events}}),
    watched AS (SELECT dataset_id, 1000 * expected_interval_secs AS iv, 1000 * grace_period_secs AS grace FROM {{freshness_config}} WHERE alert_on_stale),
    points AS (
      SELECT w.dataset_id, epoch_us(e.ts) // 1000 AS up FROM {{access_events}} e JOIN watched w ON w.dataset_id = e.dataset_id
      UNION SELECT dataset_id, {_START_MS} FROM watched),
    gaps AS (
      SELECT p.dataset_id, up, iv, up + iv + grace + 1 AS due,
        coalesce(lead(up) OVER (PARTITION BY p.dataset_id ORDER BY up), (SELECT m FROM seen)) AS until
      FROM points p JOIN watched w ON w.dataset_id = p.dataset_id),
    sent AS (SELECT *, unnest(range(due, until, 86400000)) AS alert_at_ms FROM gaps WHERE due < until)
    SELECT dataset_id, alert_at_ms, (alert_at_ms - up) // 1000 AS staleness_secs,
      CASE WHEN alert_at_ms - up >= 4 * iv THEN 'critical' WHEN alert_at_ms - up >= 2 * iv THEN 'warning' ELSE 'info' END AS severity FROM sent""",
)
def stream_alerts(v):
    folder = runner.fresh_folder(v.spark, "alerts")
    updates = lambda s: s.access_events.select("dataset_id", utc_instant(F.col("ts")).alias("updated_at"))
    by_weeks(v, lambda s: alerts.freshness_alerts(updates(s), v.freshness_config, folder, _START_MS, cooldown_secs=86400))
    return v.spark.read.schema(alerts.ALERT_SCHEMA).parquet(f"{folder}/rows/batch=*")
