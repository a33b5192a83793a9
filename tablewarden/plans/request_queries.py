"""Request analytics queries over requests derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.fixed_values import LATENCY_BUCKETS
from tablewarden.operators import requests as ops
from tablewarden.plans.registry import query
from tablewarden.session import settle

_WINDOW = 43200
_TIERS = {"free": 1, "standard": 2, "premium": 3, "enterprise": 4}
_LIMITED = """SELECT r.*, CASE WHEN r.tenant_id IS NOT NULL AND api_key_id IS NOT NULL THEN 'tenant:' || r.tenant_id || ':auth:' || api_key_id
      WHEN r.tenant_id IS NOT NULL AND client_ip IS NOT NULL THEN 'tenant:' || r.tenant_id || ':ip:' || client_ip
      WHEN r.tenant_id IS NOT NULL THEN 'tenant:' || r.tenant_id || ':unknown'
      WHEN api_key_id IS NOT NULL THEN 'auth:' || api_key_id WHEN client_ip IS NOT NULL THEN 'anon:' || client_ip
      ELSE 'anon:unknown' END AS throttle_key,
    CASE WHEN r.tenant_id IS NOT NULL THEN CASE tier WHEN 'standard' THEN 2 WHEN 'premium' THEN 3 WHEN 'enterprise' THEN 4 ELSE 1 END
      WHEN api_key_id IS NOT NULL THEN 2 ELSE 1 END AS limit_n
    FROM {requests} r LEFT JOIN {tenants} t ON t.tenant_id = r.tenant_id"""
_OPENED = f"""
    WITH RECURSIVE lim AS ({_LIMITED}),
    opened AS (
      SELECT throttle_key, limit_n, min(ts) AS at_ts FROM lim GROUP BY ALL
      UNION ALL
      SELECT o.throttle_key, o.limit_n, (SELECT min(l.ts) FROM lim l WHERE l.throttle_key = o.throttle_key AND l.limit_n = o.limit_n
        AND l.ts >= o.at_ts + INTERVAL {_WINDOW} SECOND) FROM opened o WHERE o.at_ts IS NOT NULL),
    placed AS (
      SELECT l.*, o.at_ts, row_number() OVER (PARTITION BY l.throttle_key, l.limit_n, o.at_ts ORDER BY l.ts, l.request_id) AS place
      FROM lim l ASOF JOIN (SELECT * FROM opened WHERE at_ts IS NOT NULL) o
        ON o.throttle_key = l.throttle_key AND o.limit_n = l.limit_n AND o.at_ts <= l.ts)"""


def limited(v):
    return ops.with_limits(v.requests, v.tenants, tiers=_TIERS, authenticated=2, anonymous=1)


@query(
    "throttle_fixed_window",
    f"""{_OPENED} SELECT throttle_key, limit_n AS "limit", epoch_us(at_ts) AS opened_us, count(*) AS requests,
      least(count(*), limit_n) AS allowed, greatest(count(*) - limit_n, 0) AS refused FROM placed GROUP BY throttle_key, limit_n, at_ts""",
)
def throttle_fixed_window(v):
    return ops.throttle_windows(limited(v), _WINDOW)


@query("throttle_refused", f"{_OPENED} SELECT request_id, throttle_key, ts FROM placed WHERE place > limit_n")
def throttle_refused(v):
    return ops.throttle_refused(limited(v), _WINDOW)


@query(
    "throttle_aligned",
    f"""SELECT request_id, throttle_key, slot, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY throttle_key, limit_n, slot ORDER BY ts, request_id) AS place
      FROM (SELECT *, time_bucket(INTERVAL {_WINDOW} SECOND, ts, $TS '1970-01-01') AS slot FROM ({_LIMITED}) l) s) p WHERE place > limit_n""",
)
def throttle_aligned(v):
    return ops.throttle_aligned(limited(v), _WINDOW)


_SLOT = "time_bucket(INTERVAL 300 SECOND, ts, $TS '1970-01-01') AS slot"
_RATE = "CAST(round(count(*) / 300.0, 9) AS DOUBLE) AS per_second"


@query(
    "request_rate",
    f"""SELECT {_SLOT}, path, method, (status // 100) || 'xx' AS status_class, count(*) AS requests, {_RATE} FROM {{requests}} GROUP BY ALL""",
)
def request_rate(v):
    return ops.rates(v.requests).withColumn("per_second", F.round("per_second", 9))


@query("request_error_rate", f"SELECT {_SLOT}, path, status, count(*) AS requests, {_RATE} FROM {{requests}} WHERE status >= 400 GROUP BY ALL")
def request_error_rate(v):
    return ops.error_rates(v.requests).withColumn("per_second", F.round("per_second", 9))


_BOUNDS = ", ".join(f"({b})" for b in LATENCY_BUCKETS) + ", ('inf'::DOUBLE)"
_HISTOGRAM = f"""SELECT {{k}}, le, count(*) FILTER (latency_secs <= le) AS requests
    FROM {{{{requests}}}} CROSS JOIN (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {_BOUNDS}) t(b)) b GROUP BY ALL"""


@query(
    "request_latency_histogram",
    f"SELECT method, path, CAST(le AS VARCHAR) AS le, requests FROM ({_HISTOGRAM.format(k='method, path')}) h",
)
def request_latency_histogram(v):
    return ops.latency_histogram(v.requests, ["method", "path"]).withColumn(
        "le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    )


def _quantile_sql(q: float) -> str:
    return f"""
    WITH h AS ({_HISTOGRAM.format(k='path')}),
    ranked AS (SELECT path, le, requests, coalesce(lag(requests) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0.0) AS lower,
      {q} * max(requests) OVER (PARTITION BY path) AS r FROM h WINDOW w AS (PARTITION BY path ORDER BY le))
    SELECT path, {q} AS q, CAST(round(CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * (r - below) / (requests - below) END, 6) AS DOUBLE)
      AS latency_secs FROM ranked WHERE requests >= r AND below < r"""


@query("request_latency_quantile", f"SELECT path, CAST(q AS DOUBLE) AS q, latency_secs FROM ({_quantile_sql(0.95)}) UNION ALL SELECT path, CAST(q AS DOUBLE), latency_secs FROM ({_quantile_sql(0.99)})")
def request_latency_quantile(v):
    histogram = ops.latency_histogram(v.requests, ["path"])
    read = lambda q: ops.histogram_quantile(histogram, ["path"], q).select("path", F.lit(q).alias("q"), F.round("latency_secs", 6).alias("latency_secs"))
    return read(0.95).unionByName(read(0.99))


@query("request_latency_percentiles")
def request_latency_percentiles(v):
    return ops.latency_percentiles(v.requests, ["path"])


RANK_BOUND = 0.01


def close_in_rank(timed, merged, keys):
    """(keys, requests, p95_close, p99_close): whether so many of the requests really lie at or below the sketch's quantiles."""
    read = merged.select(*keys, ops.sketched_quantile(0.95).alias("p95"), ops.sketched_quantile(0.99).alias("p99"))
    held, latency = timed.where("latency_secs IS NOT NULL").join(read, keys), F.col("latency_secs")
    all_of = F.count(F.lit(1))

    def close(q, name):
        return ((F.count_if(latency < F.col(name)) <= (q + RANK_BOUND) * all_of) & (F.count_if(latency <= F.col(name)) >= (q - RANK_BOUND) * all_of)).alias(f"{name}_close")

    return held.groupBy(*keys).agg(all_of.alias("requests"), close(0.95, "p95"), close(0.99, "p99"))


@query(
    "request_latency_merged",
    """SELECT method, path, count(*) AS requests, true AS p95_close, true AS p99_close FROM {requests} WHERE latency_secs IS NOT NULL GROUP BY ALL""",
)
def request_latency_merged(v):
    """Quantiles of whole months from the stored sketches of their hours, held against the ranks in the requests themselves."""
    stored = settle(ops.latency_sketches(v.requests, ["method", "path"]), "latency-sketches")
    return close_in_rank(v.requests, ops.merge_latencies(stored, ["method", "path"]), ["method", "path"])


@query(
    "request_success_ratio",
    f"SELECT {_SLOT}, CAST(round(count(*) FILTER (status BETWEEN 200 AND 299) / count(*), 6) AS DOUBLE) AS success_ratio FROM {{requests}} GROUP BY ALL",
)
def request_success_ratio(v):
    return ops.success_ratio(v.requests).withColumn("success_ratio", F.round("success_ratio", 6))


@query("operation_rate", f"SELECT {_SLOT}, operation, count(*) AS operations, {_RATE} FROM {{requests}} GROUP BY ALL")
def operation_rate(v):
    return ops.operation_rates(v.requests).withColumn("per_second", F.round("per_second", 9))
