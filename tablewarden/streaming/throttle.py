"""Throttling of a request stream with restarting windows that cross batches.

Batches reuse the batch operator with each key's open window carried in a small state table, so a
hot key is spread over time stretches here too. The state is one row a key; with ``ttl_secs`` keys idle for longer (and
longer than a window) leave it, and then a request that comes late opens a window of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.fixed_values import THROTTLE_WINDOW_SECS
from tablewarden.operators.greedy import restarting_points, window_counts
from tablewarden.streaming.runner import read_batches, run_batches, write_batch

_KEYS = ["throttle_key", "limit"]
_STATE = "throttle_key string, limit int, _carried bigint, last_us bigint"


def throttle(
    limited: DataFrame, folder: str, window_secs: int = THROTTLE_WINDOW_SECS, ttl_secs: int | None = None, every: str | None = None
):
    """Write per batch the requests of each (key, window) it saw, and the windows left open."""
    ttl = None if ttl_secs is None else max(ttl_secs, window_secs) * 1_000_000

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(_STATE).parquet(f"{folder}/state/batch={number - 1}") if number else None
        carried = None if state is None else state.drop("last_us")
        placed = restarting_points(batch, _KEYS, "ts", window_secs, carried=carried).persist()
        write_batch(window_counts(placed, _KEYS), f"{folder}/windows", number)
        opened = placed.groupBy(*_KEYS).agg(F.max("_opened").alias("_carried"), F.max("_us").alias("last_us"))
        if state is not None:
            both = state.unionByName(opened).groupBy(*_KEYS).agg(F.max("_carried").alias("_carried"), F.max("last_us").alias("last_us"))
            opened = both if ttl is None else both.where(F.col("last_us") >= both.agg(F.max("last_us")).scalar() - ttl)
        write_batch(opened, f"{folder}/state", number)
        placed.unpersist()

    return run_batches(limited, handle, folder, every=every)


def result(spark, folder: str) -> DataFrame:
    """Per key and window over all batches: requests, allowed, refused."""
    schema = spark.createDataFrame([], "throttle_key string, limit int, _opened bigint, requests bigint").schema
    counts = read_batches(spark, f"{folder}/windows", schema).groupBy(*_KEYS, "_opened").agg(F.sum("requests").alias("requests"))
    return counts.select(
        *_KEYS, F.col("_opened").alias("opened_us"), "requests", F.least("requests", "limit").alias("allowed"),
        F.greatest(F.col("requests") - F.col("limit"), F.lit(0)).alias("refused"),
    )
