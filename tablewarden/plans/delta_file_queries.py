"""Delta log queries over real log files, which are written to the shared folder from lineitem first.

Sixteen tables, each of the parts with one remainder. Version 0 declares the schema, version n (1..7) adds a file for each supplier of
line number n, version 8 removes those of every fifth supplier. A table's remainder by 4 says what clean-up has left of its log:
0 all commits; 1 a checkpoint of version 4 in two parts, commits after it, and one part of a lost checkpoint of version 6; 2 a
checkpoint of version 4 that names two sidecar files; 3 a compacted file for versions 2 to 6 instead of those commits.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.plans.delta_queries import _FIRST, _schema_text
from tablewarden.plans.registry import query
from tablewarden.session import scratch_path, settle
from tablewarden.sources import delta_files, delta_log

_TABLES = 16
_ACTIONS = f"""
    SELECT DISTINCT l_partkey % {_TABLES} AS t, 0 AS version, to_json(named_struct('metaData', named_struct('id', CAST(l_partkey % {_TABLES} AS STRING),
      'schemaString', '{_schema_text(_FIRST, "v1")}', 'partitionColumns', array('day'), 'createdTime', 1700000000000))) AS value FROM {{lineitem}}
    UNION ALL
    SELECT l_partkey % {_TABLES}, l_linenumber, to_json(named_struct('add', named_struct('path', 'f' || l_linenumber || '_' || l_suppkey, 'size', 1000 * count(*),
      'modificationTime', 1700000000000, 'stats', to_json(named_struct('numRecords', count(*))))))
    FROM {{lineitem}} GROUP BY l_partkey % {_TABLES}, l_linenumber, l_suppkey
    UNION ALL
    SELECT DISTINCT l_partkey % {_TABLES}, 8, to_json(named_struct('remove', named_struct('path', 'f' || l_linenumber || '_' || l_suppkey))) FROM {{lineitem}} WHERE l_suppkey % 5 = 0
    UNION ALL
    SELECT DISTINCT l_partkey % {_TABLES}, l_linenumber, to_json(named_struct('commitInfo', named_struct('timestamp', 1700000000000 + 60000 * l_linenumber, 'operation', 'WRITE',
      'userName', 'user_' || l_linenumber % 2))) FROM {{lineitem}}"""


def write_named(df: DataFrame, folder: str, form: str) -> None:
    """Rows written under the file name (relative to ``folder``) in their column ``file``, one file for each."""
    spark = df.sparkSession
    staged = scratch_path(spark, "staged")
    df.repartition("file").write.partitionBy("file").format(form).option("compression", "none").save(staged)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    system = path(staged).getFileSystem(conf)
    for entry in system.listStatus(path(staged)):
        name = entry.getPath().getName()
        if name.startswith("file="):
            part = next(p.getPath() for p in system.listStatus(entry.getPath()) if p.getPath().getName().startswith("part-"))
            target = path(f"{folder}/{unquote(name[5:])}")
            system.mkdirs(target.getParent())
            system.rename(part, target)


def _name(version, tail: str):
    return F.concat(F.col("t"), F.lit("/_delta_log/"), F.lpad(version.cast("string"), 20, "0"), F.lit(tail))


_locations: dict[tuple, list[str]] = {}


def log_folders(v) -> list[str]:
    """The tables' folders, with the log files that clean-up has left; written once for a session and its input."""
    spark = v.spark
    key = (spark.sparkContext.applicationId, *sorted(v.lineitem.inputFiles()))
    if key in _locations:
        return _locations[key]
    folder = scratch_path(spark, "delta-tables")
    lines = settle(v.sql(_ACTIONS), "log-actions")
    kind, version = F.col("t") % 4, F.col("version")
    left = lines.where((kind == 0) | (kind.isin(1, 2) & (version > 4)) | ((kind == 3) & ~version.between(2, 6)))
    compacted = lines.where((kind == 3) & version.between(2, 6)).withColumn("file", _name(F.lit(2), f".{6:020d}.compacted.json"))
    write_named(left.withColumn("file", _name(version, ".json")).unionByName(compacted).select("file", "value"), folder, "text")
    state = lines.where(version <= 4).select("t", "version", F.from_json("value", delta_files.FILE_SCHEMA).alias("a")).where("a.add is not null or a.metaData is not null")
    half = F.pmod(F.xxhash64("a.add.path"), F.lit(2))
    parts = state.where(kind == 1).withColumn("file", F.concat(_name(F.lit(4), ".checkpoint."), F.lpad((half + 1).cast("string"), 10, "0"), F.lit(".0000000002.parquet")))
    lost = state.where(kind == 1).where(half == 0).withColumn("file", _name(F.lit(6), ".checkpoint.0000000001.0000000002.parquet"))
    sidecar = F.concat(F.lit("part-"), half.cast("string"), F.lit(".parquet"))
    sides = state.where(kind == 2).where("a.add is not null").withColumn("file", F.concat("t", F.lit("/_delta_log/_sidecars/"), sidecar))
    write_named(parts.unionByName(lost).unionByName(sides).select("file", "a.*").drop("sidecar"), folder, "parquet")
    named = sides.select("t", sidecar.alias("name")).distinct().select("t", F.to_json(F.struct(F.struct(F.col("name").alias("path")).alias("sidecar"))).alias("value"))
    head = lines.where((kind == 2) & (version == 0)).select("t", "value").unionByName(named)
    write_named(head.select(_name(F.lit(4), ".checkpoint.0f2e4c1a-0000-4000-8000-000000000001.json").alias("file"), "value"), folder, "text")
    _locations[key] = [f"{folder}/{r['t']}" for r in lines.select("t").distinct().orderBy("t").collect()]
    return _locations[key]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("location", F.regexp_extract("location", "[^/]+$", 0))


def _state_sql(version: int) -> str:
    removed = "AND l_suppkey % 5 <> 0" if version >= 8 else ""
    return f"""SELECT CAST(t AS VARCHAR) AS location, CAST({version} AS BIGINT) AS version, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count, CAST(coalesce(sum(1000 * n), 0) AS BIGINT) AS size_bytes,
      count(n) AS num_files, 0::BIGINT AS malformed_stats, 4 AS num_columns, ['day'] AS partition_columns
    FROM (SELECT DISTINCT l_partkey % {_TABLES} AS t FROM {{lineitem}}) LEFT JOIN
      (SELECT l_partkey % {_TABLES} AS t, l_linenumber, l_suppkey, count(*) AS n FROM {{lineitem}} WHERE l_linenumber <= {version} {removed} GROUP BY ALL) USING (t) GROUP BY t"""


@query("delta_log_files_snapshot", _state_sql(8))
def delta_log_files_snapshot(v):
    return _named(delta_log.snapshot(delta_files.read_state(v.spark, log_folders(v)))).drop("last_modified_ms")


@query("delta_log_files_at_version", _state_sql(6))
def delta_log_files_at_version(v):
    return _named(delta_log.snapshot(delta_files.read_state(v.spark, log_folders(v), 6), 6)).drop("last_modified_ms")


@query(
    "delta_log_files_live",
    f"""SELECT DISTINCT CAST(l_partkey % {_TABLES} AS VARCHAR) AS location, 'f' || l_linenumber || '_' || l_suppkey AS path, 1000 * count(*) AS size
    FROM {{lineitem}} WHERE l_suppkey % 5 <> 0 GROUP BY l_partkey % {_TABLES}, l_linenumber, l_suppkey""",
)
def delta_log_files_live(v):
    return _named(delta_log.live_files(delta_files.read_state(v.spark, log_folders(v)))).select("location", "path", "size")


@query(
    "delta_log_files_history",
    f"""SELECT DISTINCT CAST(l_partkey % {_TABLES} AS VARCHAR) AS location, CAST(l_linenumber AS BIGINT) AS version, 1700000000000 + 60000 * l_linenumber AS timestamp_ms, 'WRITE' AS operation,
      'user_' || (l_linenumber % 2) AS user_name
    FROM {{lineitem}} WHERE CASE l_partkey % {_TABLES} % 4 WHEN 0 THEN true WHEN 3 THEN l_linenumber NOT BETWEEN 2 AND 6 ELSE l_linenumber > 4 END""",
)
def delta_log_files_history(v):
    """The commits that are still there: clean-up and compaction take the others out of the history."""
    return _named(delta_log.commit_history(delta_files.read_commits(v.spark, log_folders(v)))).drop("parameters")
