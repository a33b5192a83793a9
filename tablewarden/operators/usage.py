"""Usage analytics over access events (dataset_id, user_name, access_type, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.fixed_values import PERIOD_DAYS

COUNTERS = {
    "read_count": "read", "search_appearances": "search_appearance", "lineage_queries": "lineage_query", "api_calls": "api_call",
}


def counter_aggs() -> list[Column]:
    return [F.count_if(F.col("access_type") == kind).alias(name) for name, kind in COUNTERS.items()]


def daily(events: DataFrame) -> DataFrame:
    """Counters and distinct users per dataset and day; events without a user count but add no user.

    The distinct count is planned in two steps over (dataset, day, user), so a hot dataset is spread by user.
    """
    keyed = events.withColumn("stat_date", F.col("ts").cast("date"))
    return keyed.groupBy("dataset_id", "stat_date").agg(*counter_aggs(), F.countDistinct("user_name").alias("unique_users"))


def daily_approximate(events: DataFrame) -> DataFrame:
    """As ``daily`` with a sketch of the users: one pass, fixed state per dataset and day."""
    keyed = events.withColumn("stat_date", F.col("ts").cast("date"))
    return keyed.groupBy("dataset_id", "stat_date").agg(*counter_aggs(), F.approx_count_distinct("user_name", 0.02).alias("unique_users"))


#: Logarithm of the registers of a users' sketch: 16,384, for a standard error of 0.8 %.
SKETCH_LOG = 14


def daily_sketched(events: DataFrame) -> DataFrame:
    """As ``daily`` with a stored sketch of the users (``users_sketch``), which can be united with those of other rows."""
    keyed = events.withColumn("stat_date", F.col("ts").cast("date"))
    sketch = F.hll_sketch_agg("user_name", F.lit(SKETCH_LOG)).alias("users_sketch")
    return keyed.groupBy("dataset_id", "stat_date").agg(*counter_aggs(), sketch)


def merge_sketched(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Sketched rows added up for ``keys``: (dataset, day) for flushes, fewer for periods or whole catalogs. No event is read again."""
    return stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.hll_union_agg("users_sketch").alias("users_sketch"))


def estimated_users() -> Column:
    """Distinct users of a sketched row."""
    return F.hll_sketch_estimate("users_sketch")


def search_appearances(results: DataFrame) -> DataFrame:
    """One appearance event per dataset in each result list (dataset_ids, user_name, ts)."""
    return results.select(
        F.explode("dataset_ids").alias("dataset_id"), "user_name", F.lit("search_appearance").alias("access_type"), "ts"
    )


def merge(stored: DataFrame, flushed: DataFrame) -> DataFrame:
    """Stored daily rows plus a flush: counters add up, distinct users take the larger; empty flush rows are skipped."""
    numbers = [*COUNTERS, "unique_users"]
    active = " OR ".join(f"{c} <> 0" for c in numbers)
    columns = ["dataset_id", "stat_date", *numbers]
    both = stored.select(*columns).unionByName(flushed.where(active).select(*columns))
    return both.groupBy("dataset_id", "stat_date").agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.max("unique_users").alias("unique_users")
    )


def period_days(period: str) -> int:
    """Days of a named period; any other name is refused."""
    if period not in PERIOD_DAYS:
        raise ValueError(f"period {period!r} is none of {', '.join(PERIOD_DAYS)}")
    return PERIOD_DAYS[period]


def in_period(stats: DataFrame, as_of: Column, period: str) -> DataFrame:
    return stats.where(F.col("stat_date") >= F.date_sub(as_of.cast("date"), period_days(period)))


def dataset_totals(stats: DataFrame, as_of: Column, period: str) -> DataFrame:
    """Totals of every dataset in a period; its users are the best day's, not the distinct ones of the period."""
    return in_period(stats, as_of, period).groupBy("dataset_id").agg(
        F.sum("read_count").alias("total_reads"), F.max("unique_users").alias("total_unique_users"),
        F.sum("api_calls").alias("total_api_calls"), F.count(F.lit(1)).alias("active_days"),
    )


def distinct_users(events: DataFrame, as_of: Column, period: str) -> DataFrame:
    """True distinct users per dataset in a period."""
    keyed = events.withColumn("stat_date", F.col("ts").cast("date"))
    return in_period(keyed, as_of, period).groupBy("dataset_id").agg(F.countDistinct("user_name").alias("distinct_users"))


def popular(stats: DataFrame, datasets: DataFrame, as_of: Column, period: str, k: int) -> DataFrame:
    """Top ``k`` datasets by reads in a period."""
    named = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    sums = in_period(stats, as_of, period).groupBy("dataset_id").agg(
        F.sum("read_count").alias("total_reads"), F.max("unique_users").alias("unique_users"), F.sum("api_calls").alias("api_calls")
    )
    return sums.join(named, "dataset_id").orderBy(F.desc("total_reads"), "dataset_id").limit(k)


def unused(stats: DataFrame, datasets: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Datasets never used, or last used more than ``days`` ago; never used first."""
    today = as_of.cast("date")
    last = stats.groupBy("dataset_id").agg(F.max("stat_date").alias("last_accessed"))
    named = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    joined = named.join(last, "dataset_id", "left")
    old = F.col("last_accessed").isNull() | (F.col("last_accessed") < F.date_sub(today, days))
    return joined.where(old).withColumn("days_since_access", F.date_diff(today, "last_accessed")).orderBy(
        F.asc_nulls_first("last_accessed"), "dataset_id"
    )
