"""Request rates over sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.exprs import utc_instant, utc_wall_clock
from tablewarden.operators.requests import latency_sketches, merge_latencies, status_class
from tablewarden.streaming.runner import add_run, read_runs, run_batches

_KEYS = ["slot", "path", "method", "status_class"]
_COUNTS = "slot timestamp_ntz, path string, method string, status_class string, requests bigint"


def _windowed(requests: DataFrame, width: str, slide: str) -> DataFrame:
    counted = requests.groupBy(F.window("ts", width, slide), "path", "method", status_class().alias("status_class")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(utc_wall_clock(F.col("window.start")).alias("slot"), "path", "method", "status_class", "requests")


def _add_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*_KEYS).agg(F.sum("requests").alias("requests"))


def count_rates(requests: DataFrame, folder: str, width: str = "5 minutes", slide: str = "1 minute", every: str | None = None):
    """Each batch adds its own counts per window, path, method and status class; however late a request is, it counts."""

    def add(batch: DataFrame, number: int) -> None:
        timed = batch.withColumn("ts", utc_instant(F.col("ts")))
        add_run(_windowed(timed, width, slide), f"{folder}/rates", number, _add_up)

    return run_batches(requests, add, folder, every=every)


def rates_result(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over all batches so far."""
    schema = spark.createDataFrame([], _COUNTS).schema
    return _add_up(read_runs(spark, f"{folder}/rates", schema))


def sketch_latencies(requests: DataFrame, folder: str, keys: list[str], width: str = "1 hour", every: str | None = None):
    """Each batch adds sketches of its latencies for each slot and key, which later answer for any set of slots."""

    def add(batch: DataFrame, number: int) -> None:
        add_run(latency_sketches(batch, keys, width), f"{folder}/latencies", number, lambda rows: merge_latencies(rows, ["slot", *keys]))

    return run_batches(requests, add, folder, every=every)


def latencies_result(requests_schema_of: DataFrame, folder: str, keys: list[str], over: list[str]) -> DataFrame:
    """Merged sketches for the columns ``over`` after all batches so far."""
    schema = latency_sketches(requests_schema_of, keys).schema
    return merge_latencies(read_runs(requests_schema_of.sparkSession, f"{folder}/latencies", schema), over)


def sliding_rates(requests: DataFrame, width: str = "5 minutes", slide: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """As a stream of updates with state that ends: requests later than ``lateness`` are left out, which ``count_rates`` never does."""
    return _windowed(requests.withColumn("ts", utc_instant(F.col("ts"))).withWatermark("ts", lateness), width, slide)
