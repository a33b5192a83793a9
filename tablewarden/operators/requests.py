"""Request analytics: throttling, rates, latency distribution and success."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.exprs import epoch_us
from tablewarden.functions.fixed_values import (
    ANONYMOUS_LIMIT,
    AUTHENTICATED_LIMIT,
    LATENCY_BUCKETS,
    THROTTLE_WINDOW_SECS,
    TIER_LIMITS,
)
from tablewarden.operators.greedy import restarting_points, window_counts
from tablewarden.operators.skew import bucketed_row_number, join_null_safe
from tablewarden.session import settle


def throttle_key() -> Column:
    """Whom a request counts against: tenant with key or address, else key, else address."""
    tenant, key, ip = F.col("tenant_id"), F.col("api_key_id"), F.col("client_ip")
    scoped = lambda tail: F.concat(F.lit("tenant:"), tenant, tail)
    return (
        F.when(tenant.isNotNull() & key.isNotNull(), scoped(F.concat(F.lit(":auth:"), key)))
        .when(tenant.isNotNull() & ip.isNotNull(), scoped(F.concat(F.lit(":ip:"), ip)))
        .when(tenant.isNotNull(), scoped(F.lit(":unknown")))
        .when(key.isNotNull(), F.concat(F.lit("auth:"), key))
        .when(ip.isNotNull(), F.concat(F.lit("anon:"), ip))
        .otherwise("anon:unknown")
    )


def throttle_limit(tiers: dict[str, int] | None = None, authenticated: int = AUTHENTICATED_LIMIT, anonymous: int = ANONYMOUS_LIMIT) -> Column:
    tiers = tiers or TIER_LIMITS
    chosen = None
    for tier, limit in tiers.items():
        cond = F.col("tier") == tier
        chosen = F.when(cond, limit) if chosen is None else chosen.when(cond, limit)
    by_tier = F.when(F.col("tenant_id").isNotNull(), F.coalesce(chosen, F.lit(tiers["free"])))
    return by_tier.when(F.col("api_key_id").isNotNull(), authenticated).otherwise(anonymous)


def with_limits(requests: DataFrame, tenants: DataFrame, **limits) -> DataFrame:
    """Requests with their throttle key and limit."""
    tiers = tenants.select("tenant_id", "tier")
    return requests.join(tiers, "tenant_id", "left").select(
        *requests.columns, throttle_key().alias("throttle_key"), throttle_limit(**limits).alias("limit")
    )


def throttle_windows(limited: DataFrame, window_secs: int = THROTTLE_WINDOW_SECS) -> DataFrame:
    """Per key and restarting window: requests, how many were allowed and how many refused."""
    keys = ["throttle_key", "limit"]
    counts = window_counts(restarting_points(limited, keys, "ts", window_secs), keys)
    return counts.select(
        "throttle_key", "limit", F.col("_opened").alias("opened_us"), "requests",
        F.least("requests", "limit").alias("allowed"), F.greatest(F.col("requests") - F.col("limit"), F.lit(0)).alias("refused"),
    )


def throttle_refused(limited: DataFrame, window_secs: int = THROTTLE_WINDOW_SECS) -> DataFrame:
    """The refused requests themselves: of each crowded window those whose place is above the limit, counted by seconds."""
    keys = ["throttle_key", "limit"]
    points = settle(restarting_points(limited, keys, "ts", window_secs), "throttle-points")
    over = window_counts(points, keys).where(F.col("requests") > F.col("limit")).select(*keys, "_opened")
    crowded = join_null_safe(points, over, [*keys, "_opened"], "left_semi").drop("_n")
    events = join_null_safe(limited.withColumn("_us", epoch_us("ts")), crowded, [*keys, "_us"])
    ranked = bucketed_row_number(events, [*keys, "_opened"], ["_us", "request_id"], F.floor(F.col("_us") / 1_000_000), "place")
    return ranked.where(F.col("place") > F.col("limit")).select("request_id", "throttle_key", "ts")


def throttle_aligned(limited: DataFrame, window_secs: int = THROTTLE_WINDOW_SECS) -> DataFrame:
    """Refused requests with clock-aligned windows."""
    slotted = limited.withColumn("slot", F.window("ts", f"{window_secs} seconds")["start"])
    keys = ["throttle_key", "limit", "slot"]
    over = slotted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.col("limit")).select(*keys)
    crowded = slotted.join(over, keys, "left_semi")
    ranked = bucketed_row_number(crowded, keys, ["ts", "request_id"], F.date_trunc("second", "ts"), "place")
    return ranked.where(F.col("place") > F.col("limit")).select("request_id", "throttle_key", "slot", F.col("place").cast("int").alias("place"))


def status_class() -> Column:
    return F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx"))


def rates(requests: DataFrame, bucket_secs: int = 300) -> DataFrame:
    """Requests per second by path, method and status class in each time bucket."""
    slot = F.window("ts", f"{bucket_secs} seconds")["start"].alias("slot")
    counted = requests.groupBy(slot, "path", "method", status_class().alias("status_class")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.withColumn("per_second", F.col("requests") / bucket_secs)


def error_rates(requests: DataFrame, bucket_secs: int = 300) -> DataFrame:
    """Client and server errors per second by path and status."""
    slot = F.window("ts", f"{bucket_secs} seconds")["start"].alias("slot")
    failed = requests.where(F.col("status") >= 400)
    counted = failed.groupBy(slot, "path", "status").agg(F.count(F.lit(1)).alias("requests"))
    return counted.withColumn("per_second", F.col("requests") / bucket_secs)


def latency_histogram(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative latency buckets per key: (keys, le, requests); the last bucket is unbounded."""
    bounds = [*LATENCY_BUCKETS, float("inf")]
    aggs = [F.count_if(F.col("latency_secs") <= b).alias(f"_b{i}") for i, b in enumerate(LATENCY_BUCKETS)]
    aggs.append(F.count(F.lit(1)).alias(f"_b{len(LATENCY_BUCKETS)}"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("requests")) for i, b in enumerate(bounds)])
    return requests.groupBy(*keys).agg(*aggs).select(*keys, F.inline(rows))


def histogram_quantile(histogram: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile read off cumulative buckets by linear interpolation; in the unbounded bucket its lower bound.

    A key has one row per bucket, so its histogram is small whatever the number of requests.
    """
    order = Window.partitionBy(*keys).orderBy("le")
    lined = (
        histogram.withColumn("below", F.coalesce(F.lag("requests").over(order), F.lit(0)))
        .withColumn("lower", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
        .withColumn("total", F.max("requests").over(Window.partitionBy(*keys)))
    )
    rank = F.col("total") * q
    hit = lined.where((F.col("requests") >= rank) & ((F.col("below") < rank) | (F.col("lower") == 0.0)) & (F.col("requests") > F.col("below")))
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * (rank - F.col("below")) / (F.col("requests") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(inside)
    return hit.select(*keys, value.alias("latency_secs"))


def latency_percentiles(requests: DataFrame, keys: list[str], accuracy: int = 10_000) -> DataFrame:
    """Median, p95 and p99 from a mergeable sketch of the latencies themselves."""
    sketch = F.percentile_approx("latency_secs", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(accuracy))
    return requests.groupBy(*keys).agg(sketch.alias("p")).select(
        *keys, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99")
    )


#: Size of a latency sketch: ranks are within half a percent of all requests of a row (99 % of the time).
SKETCH_K = 800


def latency_sketches(requests: DataFrame, keys: list[str], width: str = "1 hour") -> DataFrame:
    """(slot, keys, requests, latencies): a stored quantile sketch for each slot of time; requests without a latency are not counted."""
    slot = F.window("ts", width)["start"].alias("slot")
    timed = requests.where("latency_secs IS NOT NULL").groupBy(slot, *keys)
    return timed.agg(F.count(F.lit(1)).alias("requests"), F.kll_sketch_agg_double("latency_secs", F.lit(SKETCH_K)).alias("latencies"))


def merge_latencies(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of any slots merged for ``keys``; the requests themselves are not read again."""
    return sketches.groupBy(*keys).agg(F.sum("requests").alias("requests"), F.kll_merge_agg_double("latencies").alias("latencies"))


def sketched_quantile(q: float) -> Column:
    """The latency below which a share ``q`` of a sketched row's requests lies."""
    return F.kll_sketch_get_quantile_double("latencies", F.lit(q))


def success_ratio(requests: DataFrame, bucket_secs: int = 300) -> DataFrame:
    slot = F.window("ts", f"{bucket_secs} seconds")["start"].alias("slot")
    good = F.count_if(F.col("status").between(200, 299))
    return requests.groupBy(slot).agg((good / F.count(F.lit(1))).alias("success_ratio"))


def operation_rates(requests: DataFrame, bucket_secs: int = 300) -> DataFrame:
    slot = F.window("ts", f"{bucket_secs} seconds")["start"].alias("slot")
    counted = requests.groupBy(slot, "operation").agg(F.count(F.lit(1)).alias("operations"))
    return counted.withColumn("per_second", F.col("operations") / bucket_secs)
