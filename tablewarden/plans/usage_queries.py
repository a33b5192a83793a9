"""Usage queries over access events derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.exprs import ntz
from tablewarden.operators import usage as ops
from tablewarden.plans.registry import query
from tablewarden.plans.views import AS_OF
from tablewarden.session import settle

_COUNTERS = ", ".join(f"count(*) FILTER (access_type = '{k}') AS {n}" for n, k in ops.COUNTERS.items())
_DAILY = f"SELECT dataset_id, CAST(ts AS DATE) AS stat_date, {_COUNTERS}, count(DISTINCT user_name) AS unique_users FROM {{access_events}} GROUP BY ALL"
_FROM = "stat_date >= DATE '2024-01-31' - {n}"
# The same events on a tenth of the datasets, so that days have many users.
_BUSY = """SELECT event_id, event_id % 20 AS dataset_id, 'user_' || CAST(user_id AS STRING) AS user_name, 'read' AS access_type, ts FROM {events}"""


@query("usage_daily", _DAILY)
def usage_daily(v):
    return ops.daily(v.access_events)


@query("usage_unique_cap", f"SELECT dataset_id, CAST(ts AS DATE) AS stat_date, count(DISTINCT user_name) AS unique_users FROM ({_BUSY}) b GROUP BY ALL")
def usage_unique_cap(v):
    """Distinct users of busy days: all of them, however many."""
    return ops.daily(v.sql(_BUSY)).select("dataset_id", "stat_date", "unique_users")


@query("usage_daily_approximate")
def usage_daily_approximate(v):
    return ops.daily_approximate(v.sql(_BUSY))


def close_to_exact(sketched, exact, keys):
    """Exact rows, with whether the sketch's users are within 2 % and half a user of them."""
    estimates = sketched.select(*keys, ops.estimated_users().alias("estimate"))
    near = F.abs(F.col("estimate") - F.col("unique_users")) <= 0.02 * F.col("unique_users") + 0.5
    return exact.join(estimates, keys, "left").withColumn("close", F.coalesce(near, F.lit(False))).drop("estimate")


@query(
    "usage_merge_sketches",
    f"""SELECT dataset_id, {_COUNTERS}, count(DISTINCT user_name) AS unique_users, true AS close FROM {{access_events}}
      WHERE {_FROM.format(n=30).replace('stat_date', 'CAST(ts AS DATE)')} GROUP BY ALL""",
)
def usage_merge_sketches(v):
    """Users of each dataset in 30 days from the stored sketches of its days, held against the exact ones."""
    stored = settle(ops.daily_sketched(v.access_events), "daily-sketches")
    merged = ops.merge_sketched(ops.in_period(stored, ntz(AS_OF), "30d"), ["dataset_id"])
    users = ops.distinct_users(v.access_events, ntz(AS_OF), "30d").withColumnRenamed("distinct_users", "unique_users")
    return close_to_exact(merged, merged.drop("users_sketch").join(users, "dataset_id"), ["dataset_id"])


@query(
    "usage_day_sketches",
    f"SELECT CAST(ts AS DATE) AS stat_date, {_COUNTERS}, count(DISTINCT user_name) AS unique_users, true AS close FROM {{access_events}} GROUP BY ALL",
)
def usage_day_sketches(v):
    """Users of the whole catalog on each day, united over its datasets."""
    stored = settle(ops.daily_sketched(v.access_events), "daily-sketches")
    merged = ops.merge_sketched(stored, ["stat_date"])
    users = v.access_events.groupBy(F.col("ts").cast("date").alias("stat_date")).agg(F.countDistinct("user_name").alias("unique_users"))
    return close_to_exact(merged, merged.drop("users_sketch").join(users, "stat_date"), ["stat_date"])


_RESULTS = """SELECT event_id, 'user_' || CAST(user_id AS STRING) AS user_name, ts FROM {events} WHERE event_type = 'click'"""


@query(
    "usage_search_appearances",
    f"""SELECT dataset_id, CAST(ts AS DATE) AS stat_date, CAST(0 AS BIGINT) AS read_count, count(*) AS search_appearances,
      CAST(0 AS BIGINT) AS lineage_queries, CAST(0 AS BIGINT) AS api_calls, count(DISTINCT user_name) AS unique_users
    FROM (SELECT unnest([event_id % 10, event_id % 7, 99]) AS dataset_id, user_name, ts FROM ({_RESULTS}) r) a GROUP BY ALL""",
)
def usage_search_appearances(v):
    lists = v.sql(_RESULTS).select(
        F.array(F.col("event_id") % 10, F.col("event_id") % 7, F.lit(99).cast("bigint")).alias("dataset_ids"), "user_name", "ts"
    )
    return ops.daily(ops.search_appearances(lists))


@query(
    "usage_merge",
    f"""SELECT dataset_id, stat_date, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ops.COUNTERS)}, max(unique_users) AS unique_users
    FROM (SELECT dataset_id, CAST(ts AS DATE) AS stat_date, {_COUNTERS}, count(DISTINCT user_name) AS unique_users, event_id % 2 AS half
      FROM {{access_events}} GROUP BY ALL) d GROUP BY dataset_id, stat_date""",
)
def usage_merge(v):
    half = lambda n: ops.daily(v.access_events.where(F.col("event_id") % 2 == n))
    return ops.merge(half(0), half(1))


@query(
    "usage_dataset",
    f"""SELECT dataset_id, CAST(sum(read_count) AS BIGINT) AS total_reads, max(unique_users) AS total_unique_users,
      CAST(sum(api_calls) AS BIGINT) AS total_api_calls, count(*) AS active_days FROM ({_DAILY}) d WHERE {_FROM.format(n=7)} GROUP BY dataset_id""",
)
def usage_dataset(v):
    return ops.dataset_totals(ops.daily(v.access_events), ntz(AS_OF), "7d")


@query("usage_dataset_days", f"SELECT * FROM ({_DAILY}) d WHERE {_FROM.format(n=30)}")
def usage_dataset_days(v):
    return ops.in_period(ops.daily(v.access_events), ntz(AS_OF), "30d").orderBy("dataset_id", F.desc("stat_date"))


@query(
    "usage_distinct_users",
    """SELECT dataset_id, count(DISTINCT user_name) AS distinct_users FROM {access_events}
    WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 7 GROUP BY ALL""",
)
def usage_distinct_users(v):
    return ops.distinct_users(v.access_events, ntz(AS_OF), "7d")


@query(
    "usage_popular",
    f"""SELECT u.dataset_id, d.name AS dataset_name, CAST(sum(read_count) AS BIGINT) AS total_reads, max(unique_users) AS unique_users,
      CAST(sum(api_calls) AS BIGINT) AS api_calls FROM ({_DAILY}) u JOIN {{datasets}} d ON d.id = u.dataset_id
    WHERE {_FROM.format(n=30)} GROUP BY ALL ORDER BY total_reads DESC, dataset_id LIMIT 10""",
)
def usage_popular(v):
    return ops.popular(ops.daily(v.access_events), v.datasets, ntz(AS_OF), "30d", 10)


@query(
    "usage_stale",
    """SELECT d.id AS dataset_id, d.name AS dataset_name, max(CAST(e.ts AS DATE)) AS last_accessed,
      CAST(DATE '2024-01-31' - max(CAST(e.ts AS DATE)) AS INT) AS days_since_access
    FROM {datasets} d LEFT JOIN {access_events} e ON e.dataset_id = d.id GROUP BY ALL
    HAVING last_accessed IS NULL OR last_accessed < DATE '2024-01-31' - 5""",
)
def usage_stale(v):
    return ops.unused(ops.daily(v.access_events), v.datasets, ntz(AS_OF), 5)
