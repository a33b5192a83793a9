"""What the operators share: reading tables, keeping results in the shared folder, and passing Arrow batches on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that every executor reaches."""
    return scratch_path(spark, label)


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_PER_BATCH = 1000


def short_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session from now on hands rows to Python ``TEXTS_PER_BATCH`` at a time, if it handed over more (Spark: 10,000).

    A batch of whole texts lies outside the heap of the JVM, and again in the worker, for each task.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= TEXTS_PER_BATCH:
        conf.set(ARROW_ROWS, str(TEXTS_PER_BATCH))
    return docs


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column."""
    return int(docs.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0)


def fresh_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or that with underscores before it until no column has the name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
