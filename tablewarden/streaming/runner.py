"""Running a streaming query over files to its end, with results in batch-numbered folders.

A batch writes only folders named after its number and overwrites them when it is replayed, so the
folder holds every batch exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.session import is_written, scratch_path

#: So many runs of one level are folded into one of the next.
FAN = 8
#: State that grows with the keys of a window is held on local disks, in a bounded part of each executor's memory.
_STORE = "spark.sql.streaming.stateStore"
STATE_ON_DISK = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
}


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str, mode: str = "append", every: str | None = None
):
    """Hand each micro-batch to ``handle``; to the end of the input, or every ``every`` (a duration) for ever."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint")
    query = _start(writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every), stream.sparkSession)
    if every is None:
        query.awaitTermination()
    return query


def _start(writer, spark: SparkSession):
    """Start a stream with its state on disk; it takes the settings as they are now, and one that goes on keeps those it began with."""
    before = {k: spark.conf.get(k, None) for k in STATE_ON_DISK}
    try:
        for k, v in STATE_ON_DISK.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_batch(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def read_batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All batches' rows with their ``batch`` number."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, batch bigint").option("basePath", folder).parquet(f"{folder}/batch=*")


def _run(folder: str, level: int, number: int) -> str:
    return f"{folder}/level={level}/run={number}"


def add_run(df: DataFrame, folder: str, batch: int, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Write a batch as a run of level 0; each ``FAN``-th run of a level folds the last ``FAN`` of them into one of the next.

    So a result reads a few runs for each level, not every batch, and each row is rewritten once a level. ``fold`` adds up
    rows of equal keys and keeps the columns. Runs are named by the batch alone, so a replayed batch writes the same ones.
    """
    spark, schema = df.sparkSession, df.schema
    df.write.mode("overwrite").parquet(_run(folder, 0, batch))
    level, number = 0, batch
    while (number + 1) % FAN == 0:
        parts = spark.read.schema(schema).parquet(*[_run(folder, level, number - k) for k in range(FAN)])
        level, number = level + 1, number // FAN
        fold(parts).write.mode("overwrite").parquet(_run(folder, level, number))


def run_paths(spark: SparkSession, folder: str) -> list[str]:
    """The fewest runs that hold every batch once, largest first; a run that is just being written is not waited for."""
    top = 0
    while is_written(spark, _run(folder, top + 1, 0)):
        top += 1
    paths, done = [], 0
    for level in range(top, -1, -1):
        while is_written(spark, _run(folder, level, done // FAN**level)):
            paths.append(_run(folder, level, done // FAN**level))
            done += FAN**level
    return paths


def read_runs(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of all batches so far, to be folded once more; none where nothing has been written."""
    paths = run_paths(spark, folder)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest_updates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Result table of an update-mode query: the last row written for each key."""
    rest = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def fresh_folder(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)
