"""Delta transaction logs: live files, history, schemas and their changes, from commits and checkpoints.

Everything works on many tables at once, from one scan of their commit files and one of their checkpoints. A checkpoint
holds the whole state of a table at its version, so the commits up to it may be gone; what it holds counts as
actions of its version. A table's state at a version starts from the newest checkpoint not after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.skew import bucketed_lag, bucketed_row_number
from tablewarden.session import settle

_TEXT_MAP = "map<string,string>"
_VECTOR = "deletionVector:struct<storageType:string, pathOrInlineDv:string, offset:int>"
ACTION_SCHEMA = f"""add struct<path:string, partitionValues:{_TEXT_MAP}, size:bigint, modificationTime:bigint, dataChange:boolean, stats:string, {_VECTOR}>,
    remove struct<path:string, deletionTimestamp:bigint, dataChange:boolean, {_VECTOR}>,
    metaData struct<id:string, name:string, description:string, schemaString:string, partitionColumns:array<string>, createdTime:bigint>,
    commitInfo struct<timestamp:bigint, operation:string, userName:string, operationParameters:{_TEXT_MAP}>,
    protocol struct<minReaderVersion:int, minWriterVersion:int>"""
SCHEMA_STRING = "type string, fields array<struct<name:string, type:string, nullable:boolean, metadata:map<string,string>>>"


def read_log_lines(spark: SparkSession, locations: list[str]) -> DataFrame:
    """(location, version, value): one row per action line of the tables' commit files."""
    lines = spark.read.text([f"{loc.rstrip('/')}/_delta_log/*.json" for loc in locations])
    file = F.col("_metadata.file_path")
    return lines.select(
        F.regexp_extract(file, r"^(.*)/_delta_log/", 1).alias("location"),
        F.expr(r"try_cast(regexp_extract(_metadata.file_path, r'/(\d+)\.json$', 1) AS BIGINT)").alias("version"),
        "value",
    ).where("version IS NOT NULL")  # compacted commits and named checkpoints are files of other kinds


def parse_actions(lines: DataFrame) -> DataFrame:
    parsed = lines.select("location", "version", F.lit(False).alias("checkpoint"), F.from_json("value", ACTION_SCHEMA).alias("a"))
    return parsed.select("location", "version", "checkpoint", "a.*")


def read_checkpoints(spark: SparkSession, locations: list[str]) -> DataFrame:
    """The actions in the tables' checkpoints, of one or several Parquet files each."""
    from tablewarden.sources import delta_files as files

    whole = files.complete_checkpoints(files.list_files(spark, locations))
    segment = whole.select("location", "path", F.lit("checkpoint").alias("kind"), "version", F.col("version").alias("until"))
    return files.read_files(spark, segment)


def load_actions(lines: DataFrame) -> DataFrame:
    """Parsed actions written once as columns: every analysis then reads only the parts it needs, and no JSON twice."""
    return settle(parse_actions(lines), "delta-actions")


def read_actions(spark: SparkSession, locations: list[str]) -> DataFrame:
    """All actions of the tables at ``locations``, those of their checkpoints too, written once as columns."""
    commits = parse_actions(read_log_lines(spark, locations))
    return settle(commits.unionByName(read_checkpoints(spark, locations)), "delta-actions")


def _until(actions: DataFrame, version: int | None) -> DataFrame:
    return actions if version is None else actions.where(F.col("version") <= version)


def since_checkpoint(actions: DataFrame, version: int | None = None) -> DataFrame:
    """The actions that make up each table's state: its newest checkpoint up to ``version`` and the commits after that."""
    seen = _until(actions, version)
    newest = seen.where("checkpoint").groupBy("location").agg(F.max("version").alias("_base"))
    placed = seen.join(newest, "location", "left")
    after = F.col("_base").isNull() | (F.col("version") > F.col("_base"))
    return placed.where(F.when(F.col("checkpoint"), F.col("version") == F.col("_base")).otherwise(after)).drop("_base")


def live_files(actions: DataFrame, version: int | None = None) -> DataFrame:
    """Files that make up each table at ``version`` (newest by default): the last action of a path and deletion vector decides.

    A commit that removes and adds the same leaves it added.
    """
    vector = F.coalesce("add.deletionVector", "remove.deletionVector")
    touched = since_checkpoint(actions, version).where("add IS NOT NULL OR remove IS NOT NULL").select(
        "location", F.coalesce("add.path", "remove.path").alias("path"), F.to_json(vector).alias("vector"), "add",
        F.struct("version", F.col("add").isNotNull().alias("is_add")).alias("order"),
    )
    last = touched.groupBy("location", "path", "vector").agg(F.max_by("add", "order").alias("add"))
    return last.where("add IS NOT NULL").select(
        "location", "path", F.col("add.size").alias("size"), F.col("add.modificationTime").alias("modification_time"),
        F.col("add.stats").alias("stats"),
    )


def table_metadata(actions: DataFrame, version: int | None = None) -> DataFrame:
    """Schema text, partition columns, version and last commit time of each table."""
    seen = _until(actions, version)
    return seen.groupBy("location").agg(
        F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("m"),
        F.max("version").alias("version"),
        F.max("commitInfo.timestamp").alias("last_modified_ms"),
    ).select(
        "location", "version", F.col("m.schemaString").alias("schema_string"),
        F.col("m.partitionColumns").alias("partition_columns"), "last_modified_ms",
    )


def snapshot(actions: DataFrame, version: int | None = None) -> DataFrame:
    """One row per table: version, rows, bytes, files, columns and partition columns."""
    from tablewarden.operators.quality import table_stats

    stats = table_stats(live_files(actions, version), "location").drop("small_files")
    meta = table_metadata(actions, version)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("row_count", "size_bytes", "num_files", "malformed_stats")]
    return meta.join(stats, "location", "left").select(
        "location", "version", *zero, F.size(F.from_json("schema_string", SCHEMA_STRING)["fields"]).alias("num_columns"),
        "partition_columns", "last_modified_ms",
    )


def commit_history(actions: DataFrame, limit: int | None = None) -> DataFrame:
    """The commits of every table, newest first; the newest ``limit`` of each if that is given."""
    commits = actions.where("commitInfo IS NOT NULL").select(
        "location", "version", F.col("commitInfo.timestamp").alias("timestamp_ms"),
        F.coalesce("commitInfo.operation", F.lit("")).alias("operation"), F.col("commitInfo.userName").alias("user_name"),
        F.coalesce("commitInfo.operationParameters", F.create_map().cast(_TEXT_MAP)).alias("parameters"),
    )
    if limit is None:
        return commits.orderBy("location", F.desc("version"))
    commits = commits.withColumn("_order", -F.col("version"))
    ranked = bucketed_row_number(commits, ["location"], ["_order"], F.floor(F.col("_order") / 1000), "_newest")
    return ranked.where(F.col("_newest") <= limit).drop("_order", "_newest").orderBy("location", F.desc("version"))


def extract_schema(schemas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, column_name, data_type, nullable, comment, is_partition) from a schema text column."""
    fields = F.from_json("schema_string", SCHEMA_STRING)["fields"]
    partitions = F.coalesce("partition_columns", F.array().cast("array<string>"))
    return schemas.select(*keys, F.posexplode(fields).alias("position", "f"), partitions.alias("_parts")).select(
        *keys, "position", F.col("f.name").alias("column_name"), F.col("f.type").alias("data_type"),
        F.coalesce("f.nullable", F.lit(True)).alias("nullable"), F.col("f.metadata")["comment"].alias("comment"),
        F.array_contains("_parts", F.col("f.name")).alias("is_partition"),
    )


def schema_versions(actions: DataFrame) -> DataFrame:
    """Every schema a table declared, as far back as its log goes: (location, version, schema_string, partition_columns).

    What checkpoints hold stands in for the commits that are gone; a repeated schema changes nothing.
    """
    commits = actions.where("metaData IS NOT NULL AND NOT checkpoint")
    oldest = commits.groupBy("location").agg(F.min("version").alias("_first"))
    kept = actions.where("metaData IS NOT NULL AND checkpoint").join(oldest, "location", "left").where("_first IS NULL OR version < _first")
    declared = commits.unionByName(kept.drop("_first"))
    return declared.select(
        "location", "version", F.col("metaData.schemaString").alias("schema_string"),
        F.col("metaData.partitionColumns").alias("partition_columns"),
    )


def _differs(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new)


def diff_columns(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Columns added, removed or modified (type or nullability) between two extracted schemas."""
    side = lambda df, p: df.select(*keys, "column_name", F.col("data_type").alias(f"{p}_type"), F.col("nullable").alias(f"{p}_nullable"))
    both = side(old, "old").join(side(new, "new"), [*keys, "column_name"], "full_outer")
    kind = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(_differs(F.col("old_type"), F.col("new_type")) | _differs(F.col("old_nullable"), F.col("new_nullable")), "modified")
    )
    return both.withColumn("change_kind", kind).where("change_kind IS NOT NULL")


def schema_diff(actions: DataFrame, from_version: int, to_version: int) -> DataFrame:
    """Schema change of every table between two of its versions."""
    if not 0 <= from_version < to_version:
        raise ValueError("from_version must be below to_version")
    at = lambda v: extract_schema(table_metadata(actions, v), ["location"])
    return diff_columns(at(from_version), at(to_version), ["location"])


def schema_changes(actions: DataFrame) -> DataFrame:
    """Schema change of every table at each version that declares a schema, against the one declared before."""
    declared = schema_versions(actions)
    paired = bucketed_lag(declared, ["location"], ["version"], "schema_string", F.floor(F.col("version") / 1000), "_before")
    paired = paired.where("_before IS NOT NULL")
    keys = ["location", "version"]
    old = extract_schema(paired.drop("schema_string").withColumnRenamed("_before", "schema_string"), keys)
    return diff_columns(old, extract_schema(paired, keys), keys)
