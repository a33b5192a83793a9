"""Audit events: derived from catalog snapshots, queried, appended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.exprs import page
from tablewarden.session import settle

BUCKETS = 4096


def snapshot_events(before: DataFrame, after: DataFrame, key: str, entity_type: str) -> DataFrame:
    """Create, update and delete events that turn one snapshot into the other, with old and new values as JSON."""
    values = [c for c in after.columns if c != key]
    side = lambda df, name: df.select(F.col(key).cast("string").alias("entity_id"), F.struct(*values).alias(name))
    both = side(before, "old").join(side(after, "new"), "entity_id", "full_outer")
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").otherwise("update")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(
        action.alias("action"), F.lit(entity_type).alias("entity_type"), "entity_id",
        F.to_json("old").alias("old_values"), F.to_json("new").alias("new_values"),
    )


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return known.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)))


def _digests(rows: DataFrame, values: list[str], side: str) -> DataFrame:
    """(bucket, digest) of a snapshot: the number of rows and two hashes over all their values, whatever their order."""
    # a hash passes over nulls, so which values are null is hashed too
    parts = [F.col(f"`{c}`") for c in values] + [F.col(f"`{c}`").isNull() for c in values]
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), *parts)) for seed in ("one", "two")]
    return rows.groupBy("__bucket").agg(F.struct(F.count(F.lit(1)), *hashes).alias(side))


def changed_events(before: DataFrame, after: DataFrame, keys: list[str], entity_type: str, buckets: int = BUCKETS) -> DataFrame:
    """The events of ``snapshot_events`` for snapshots that are mostly equal, with all columns of ``after`` as values, nulls included.

    Rows are dealt to ``buckets`` by their keys, digests of the buckets are compared, and only rows of buckets that differ
    are shuffled and compared one by one. Keys are unique; rows without one take no part. ``entity_id`` joins the keys by ``/``.
    """
    values = after.columns
    old, new = _bucketed(before.select(*values), keys, buckets), _bucketed(after, keys, buckets)
    both = _digests(old, values, "old").join(_digests(new, values, "new"), "__bucket", "full_outer")
    differing = settle(both.where(~F.col("old").eqNullSafe(F.col("new"))).select("__bucket"), "differing-buckets")
    side = lambda rows, name: rows.join(F.broadcast(differing), "__bucket", "left_semi").select(  # at most ``buckets`` numbers
        F.concat_ws("/", *[F.col(f"`{k}`").cast("string") for k in keys]).alias("entity_id"), F.struct(*[F.col(f"`{c}`") for c in values]).alias(name)
    )
    rows = side(old, "old").join(side(new, "new"), "entity_id", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").otherwise("update")
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(f"{c}_values")
    return rows.select(action.alias("action"), F.lit(entity_type).alias("entity_type"), "entity_id", json("old"), json("new"))


def catalog_events(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, list[str]], buckets: int = BUCKETS) -> DataFrame:
    """The events of several kinds of entities, by the kind's name."""
    return reduce(DataFrame.unionByName, [changed_events(before[kind], after[kind], keys[kind], kind, buckets) for kind in keys])


def log_filter(
    log: DataFrame, entity_type: str | None = None, entity_id: str | None = None, action: str | None = None,
    actor: str | None = None, request_id: str | None = None, tenant_id: str | None = None,
) -> DataFrame:
    wanted = {
        "entity_type": entity_type, "entity_id": entity_id, "action": action, "actor": actor, "request_id": request_id,
        "tenant_id": tenant_id,
    }
    for column, value in wanted.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    return log


def log_page(log: DataFrame, limit: int | None = None, offset: int | None = None, **filters) -> DataFrame:
    """One page of the log, newest first, with the number of all matching events."""
    found = log_filter(log, **filters)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    shown = page(found.orderBy(F.desc("timestamp"), F.desc("id")), limit, offset)
    return shown.withColumn("total", total)


def append(log_folder: str, events: DataFrame) -> None:
    """Append a batch of events to the stored log, partitioned by day: few files for a day, several for a crowded one."""
    dated = events.withColumn("log_date", F.col("timestamp").cast("date")).hint("rebalance", F.col("log_date"))
    dated.write.mode("append").partitionBy("log_date").parquet(log_folder)
