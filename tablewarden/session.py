"""Session defaults and the shared scratch folder used to cut lineage in iterative jobs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tablewarden", cpus: int | None = None) -> SparkSession:
    """A session for local runs; on a cluster pass the session the cluster gives you instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("TABLEWARDEN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the session names, else (local mode only) a temporary one."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fresh = tempfile.mkdtemp(prefix="tablewarden-")
    sc.setCheckpointDir(fresh)
    return sc.getCheckpointDir() or fresh


_owned: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's own part of the shared folder, which is removed when the driver's Python ends."""
    sc = spark.sparkContext
    own = f"{shared_dir(spark)}/tablewarden/{sc.applicationId}"
    if own not in _owned:
        _owned.add(own)
        atexit.register(remove_folder, sc._jvm, sc._jsc.hadoopConfiguration(), own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has been committed."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def remove_folder(jvm, conf, path: str) -> None:
    """Delete a folder on whatever file system it is; a JVM that is gone already leaves it to the folder's owner."""
    try:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    except Exception:  # the gateway may be closed by now
        pass


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the plan like ``checkpoint()``, survives lost executors, and unlike it gives the
    planner the true size on disk, so small results are broadcast by Catalyst's own rule.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``settle``, with the number of rows, which the write itself counts."""
    seen = Observation()
    kept = settle(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return kept, seen.get["n"]


def release(spark: SparkSession) -> None:
    """Have the exchanges of finished plans removed from the executors' disks, which Spark does when the driver's JVM collects garbage."""
    spark.sparkContext._jvm.System.gc()
