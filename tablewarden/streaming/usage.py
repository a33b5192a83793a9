"""Usage counters kept up to date by a stream of access events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.exprs import utc_instant, utc_wall_clock
from tablewarden.operators import usage
from tablewarden.streaming.runner import add_run, latest_updates, read_batches, read_runs, run_batches, write_batch

FLUSH_EVERY = "60 seconds"
_KEYS = ["dataset_id", "stat_date"]


def _add_up(counters: DataFrame) -> DataFrame:
    return counters.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in usage.COUNTERS])


def exact(events: DataFrame, folder: str, every: str | None = None):
    """Each batch adds its counters and its distinct (dataset, day, user) rows; late events count like others.

    Runs of batches are folded by and by, so the result does not read every batch again.
    """

    def flush(batch: DataFrame, number: int) -> None:
        counters = usage.daily(batch).drop("unique_users")
        users = batch.where("user_name IS NOT NULL").select("dataset_id", F.col("ts").cast("date").alias("stat_date"), "user_name").distinct()
        add_run(counters, f"{folder}/counters", number, _add_up)
        add_run(users, f"{folder}/users", number, DataFrame.distinct)

    return run_batches(events, flush, folder, every=every)


def exact_result(spark, folder: str, events_schema_of: DataFrame) -> DataFrame:
    """Daily rows after all batches so far, equal to the batch form over the same events."""
    counters = usage.daily(events_schema_of).drop("unique_users").schema
    users = events_schema_of.select("dataset_id", F.col("ts").cast("date").alias("stat_date"), "user_name").schema
    sums = _add_up(read_runs(spark, f"{folder}/counters", counters))
    people = read_runs(spark, f"{folder}/users", users).groupBy(*_KEYS).agg(F.countDistinct("user_name").alias("u"))
    return sums.join(people, _KEYS, "left").select(*_KEYS, *usage.COUNTERS, F.coalesce("u", F.lit(0)).alias("unique_users"))


def sketched(events: DataFrame, folder: str, every: str | None = None):
    """As ``exact`` with a sketch of the users in each row instead of rows of users: the state is one row a dataset and day."""

    def flush(batch: DataFrame, number: int) -> None:
        add_run(usage.daily_sketched(batch), f"{folder}/sketched", number, lambda rows: usage.merge_sketched(rows, _KEYS))

    return run_batches(events, flush, folder, every=every)


def sketched_result(spark, folder: str, events_schema_of: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows with their sketch after all batches so far, for each dataset and day or any coarser ``keys``."""
    schema = usage.daily_sketched(events_schema_of).schema
    return usage.merge_sketched(read_runs(spark, f"{folder}/sketched", schema), keys or _KEYS)


def windowed(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Event-time form: day windows held as state until the watermark passes, users by sketch.

    The sketch starts as a list of few users, so the state of a day that has few takes some tens of bytes, not thousands.
    """
    day, users = F.window("ts", "1 day"), F.hll_sketch_agg("user_name", F.lit(usage.SKETCH_LOG)).alias("users_sketch")
    counted = events.withColumn("ts", utc_instant(F.col("ts"))).withWatermark("ts", lateness).groupBy("dataset_id", day).agg(*usage.counter_aggs(), users)
    stat_date = utc_wall_clock(F.col("window.start")).cast("date").alias("stat_date")
    return counted.select("dataset_id", stat_date, *usage.COUNTERS, usage.estimated_users().alias("unique_users"))


def keep_updates(updates: DataFrame, folder: str, every: str | None = None):
    return run_batches(updates, lambda batch, number: write_batch(batch, f"{folder}/rows", number), folder, "update", every)


def updates_result(spark, folder: str, schema, keys: list[str] | None = None) -> DataFrame:
    return latest_updates(read_batches(spark, f"{folder}/rows", schema), keys or _KEYS)
