"""Freshness alerts from a stream of dataset updates: one for each gap that grows too long, repeated until the next update.

Each batch closes gaps (between two updates of a dataset, the carried last one included) and looks at the open ones up to
the newest time seen. An alert is due ``interval + grace`` and a millisecond after an update and again after each
cooldown, as long as that is before the next update and before the newest time seen. So the alerts are the same however
the updates, in order of time, are cut into batches. The state is one row per watched dataset; datasets that never send
an update are watched from ``start_ms``. Updates that come after a later one of their dataset cannot recall alerts;
they are kept in ``late``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.fixed_values import ALERT_COOLDOWN_SECS
from tablewarden.operators.skew import bucketed_lag
from tablewarden.session import settle
from tablewarden.streaming.runner import run_batches, write_batch

ALERT_SCHEMA = "dataset_id bigint, alert_at_ms bigint, staleness_secs bigint, severity string"
_STATE = "dataset_id bigint, last_ms bigint, seen_ms bigint"
_DAY_MS = 86_400_000


def gap_alerts(gaps: DataFrame, cooldown_secs: int) -> DataFrame:
    """Alerts of gaps (dataset_id, from_ms, to_ms, sent_ms, interval_ms, grace_ms) that are due from ``sent_ms`` until before ``to_ms``."""
    step = cooldown_secs * 1000
    due = F.col("from_ms") + F.col("interval_ms") + F.col("grace_ms") + 1
    first = F.greatest(F.lit(0), F.ceil((F.col("sent_ms") - due) / step)).cast("bigint")
    last = F.floor((F.col("to_ms") - 1 - due) / step).cast("bigint")
    turns = F.when((due < F.col("to_ms")) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    sent = gaps.select("dataset_id", "from_ms", "interval_ms", due.alias("due"), F.explode(turns).alias("turn"))
    at = F.col("due") + F.col("turn") * step
    age = at - F.col("from_ms")
    severity = F.when(age >= 4 * F.col("interval_ms"), "critical").when(age >= 2 * F.col("interval_ms"), "warning").otherwise("info")
    return sent.select("dataset_id", at.alias("alert_at_ms"), F.floor(age / 1000).alias("staleness_secs"), severity.alias("severity"))


def freshness_alerts(updates: DataFrame, config: DataFrame, folder: str, start_ms: int, cooldown_secs: int = ALERT_COOLDOWN_SECS, every: str | None = None):
    """Run the stream of updates (dataset_id, updated_at as an instant); alerts go to ``folder/rows``."""
    watched = config.where("alert_on_stale").select(
        "dataset_id", (F.col("expected_interval_secs") * 1000).alias("interval_ms"), (F.col("grace_period_secs") * 1000).alias("grace_ms")
    )

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        timed = batch.select("dataset_id", F.unix_millis("updated_at").alias("at_ms")).where("at_ms IS NOT NULL")
        if number:
            state = spark.read.schema(_STATE).parquet(f"{folder}/state/batch={number - 1}")
        else:
            state = watched.select("dataset_id", F.lit(start_ms).alias("last_ms"), F.lit(start_ms).alias("seen_ms"))
        newest = timed.agg(F.max("at_ms")).first()[0]
        before = state.agg(F.max("seen_ms")).first()[0]
        seen = max(x for x in (newest, before, start_ms) if x is not None)
        known = timed.join(state.select("dataset_id", "last_ms"), "dataset_id").dropDuplicates(["dataset_id", "at_ms"])
        known = settle(known, "updates")
        points = known.where("at_ms > last_ms").select("dataset_id", "at_ms").unionByName(state.select("dataset_id", F.col("last_ms").alias("at_ms")))
        points = settle(bucketed_lag(points, ["dataset_id"], ["at_ms"], "at_ms", F.floor(F.col("at_ms") / _DAY_MS), "from_ms"), "update-gaps")
        last = points.groupBy("dataset_id").agg(F.max("at_ms").alias("last_ms"))
        closed = points.where("from_ms IS NOT NULL").select("dataset_id", "from_ms", F.least("at_ms", F.lit(seen)).alias("to_ms"))
        opened = last.select("dataset_id", F.col("last_ms").alias("from_ms"), F.lit(seen).alias("to_ms"))
        gaps = closed.unionByName(opened).withColumn("sent_ms", F.lit(before if before is not None else start_ms)).join(watched, "dataset_id")
        write_batch(gap_alerts(gaps, cooldown_secs), f"{folder}/rows", number)
        write_batch(known.where("at_ms < last_ms").select("dataset_id", "at_ms"), f"{folder}/late", number)
        write_batch(last.withColumn("seen_ms", F.lit(seen)), f"{folder}/state", number)

    return run_batches(updates, handle, folder, every=every)
