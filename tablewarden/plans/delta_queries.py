"""Delta log queries: the transaction logs of one table per part, derived from lineitem.

Version 0 declares the schema. Version n (1..7) adds one file per supplier of line number n and
removes nothing. Version 5 also declares a changed schema. Version 8 removes the files of every
fifth supplier.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.plans.registry import query
from tablewarden.session import settle
from tablewarden.sources import delta_log as log

_FIRST = [("user_id", "long", False), ("amount", "double", True), ("status", "string", True), ("day", "date", True)]
_SECOND = [("user_id", "long", False), ("amount", "decimal(12,2)", True), ("day", "date", False), ("note", "string", True)]


def _schema_text(fields, comment="") -> str:
    cols = ",".join(
        f'{{"name":"{n}","type":"{t}","nullable":{str(b).lower()},"metadata":{{"comment":"{n} {comment}"}}}}' for n, t, b in fields
    )
    text = f'{{"type":"struct","fields":[{cols}]}}'
    return text.replace("{", "{{").replace("}", "}}")  # the views' SQL is a format string


_LINES = f"""
    SELECT DISTINCT 'lake/part_' || l_partkey AS location, CAST(0 AS BIGINT) AS version, to_json(named_struct('metaData',
      named_struct('id', CAST(l_partkey AS STRING), 'schemaString', '{_schema_text(_FIRST, "v1")}',
        'partitionColumns', array('day'), 'createdTime', 1700000000000))) AS value FROM {{lineitem}}
    UNION ALL
    SELECT DISTINCT 'lake/part_' || l_partkey, CAST(5 AS BIGINT), to_json(named_struct('metaData',
      named_struct('id', CAST(l_partkey AS STRING), 'schemaString', '{_schema_text(_SECOND, "v2")}',
        'partitionColumns', array('day'), 'createdTime', 1700000000000))) FROM {{lineitem}} WHERE l_linenumber = 5
    UNION ALL
    SELECT 'lake/part_' || l_partkey, CAST(l_linenumber AS BIGINT), to_json(named_struct('add',
      named_struct('path', 'f' || l_linenumber || '_' || l_suppkey, 'size', 1000 * count(*), 'modificationTime', 1700000000000,
        'stats', CASE WHEN l_suppkey % 13 = 1 THEN 'broken' ELSE to_json(named_struct('numRecords', count(*))) END)))
    FROM {{lineitem}} GROUP BY l_partkey, l_linenumber, l_suppkey
    UNION ALL
    SELECT DISTINCT 'lake/part_' || l_partkey, CAST(8 AS BIGINT),
      to_json(named_struct('remove', named_struct('path', 'f' || l_linenumber || '_' || l_suppkey)))
    FROM {{lineitem}} WHERE l_suppkey % 5 = 0
    UNION ALL
    SELECT DISTINCT 'lake/part_' || l_partkey, CAST(l_linenumber AS BIGINT), to_json(named_struct('commitInfo',
      named_struct('timestamp', 1700000000000 + 60000 * l_linenumber, 'operation', 'WRITE',
        'userName', 'user_' || l_linenumber % 2, 'operationParameters', map('mode', 'Append')))) FROM {{lineitem}}"""


def actions(v):
    return log.load_actions(v.sql(_LINES))


def _snapshot_sql(version: int) -> str:
    removed = "WHERE l_suppkey % 5 <> 0" if version >= 8 else ""
    return f"""
    WITH files AS (
      SELECT l_partkey, l_linenumber, l_suppkey, count(*) AS n FROM {{lineitem}} WHERE l_linenumber <= {version} GROUP BY ALL),
    live AS (SELECT * FROM files {removed}),
    parts AS (SELECT l_partkey, max(l_linenumber) FILTER (l_linenumber <= {version}) AS last_write,
      bool_or(l_suppkey % 5 = 0) AND {version} >= 8 AS removes FROM {{lineitem}} GROUP BY ALL)
    SELECT 'lake/part_' || l_partkey AS location,
      CAST(CASE WHEN removes THEN 8 ELSE coalesce(last_write, 0) END AS BIGINT) AS version,
      CAST(coalesce(sum(CASE WHEN l_suppkey % 13 <> 1 THEN n END), 0) AS BIGINT) AS row_count,
      CAST(coalesce(sum(1000 * n), 0) AS BIGINT) AS size_bytes, count(n) AS num_files,
      count(*) FILTER (n IS NOT NULL AND l_suppkey % 13 = 1) AS malformed_stats, 4 AS num_columns
    FROM parts LEFT JOIN live USING (l_partkey) GROUP BY l_partkey, last_write, removes"""


@query("delta_log_snapshot", _snapshot_sql(8))
def delta_log_snapshot(v):
    return log.snapshot(actions(v)).drop("partition_columns", "last_modified_ms")


_CHECKPOINT = 4


def checkpointed(v):
    """The same logs after clean-up: the state at version 4 is in checkpoints, and the commits up to it are gone."""
    whole = log.parse_actions(v.sql(_LINES))
    old = whole.where(F.col("version") <= _CHECKPOINT)
    state = old.where("add IS NOT NULL OR metaData IS NOT NULL").withColumns({"version": F.lit(_CHECKPOINT).cast("bigint"), "checkpoint": F.lit(True)})
    return settle(whole.where(F.col("version") > _CHECKPOINT).unionByName(state), "delta-actions")


@query("delta_log_snapshot_checkpoint", _snapshot_sql(8).replace("coalesce(last_write, 0)", f"greatest(coalesce(last_write, 0), {_CHECKPOINT})"))
def delta_log_snapshot_checkpoint(v):
    return log.snapshot(checkpointed(v)).drop("partition_columns", "last_modified_ms")


@query("delta_log_snapshot_at_version", _snapshot_sql(4))
def delta_log_snapshot_at_version(v):
    return log.snapshot(actions(v), 4).drop("partition_columns", "last_modified_ms")


@query(
    "delta_history",
    """SELECT DISTINCT 'lake/part_' || l_partkey AS location, CAST(l_linenumber AS BIGINT) AS version,
      1700000000000 + 60000 * l_linenumber AS timestamp_ms, 'WRITE' AS operation, 'user_' || (l_linenumber % 2) AS user_name,
      'Append' AS mode FROM {lineitem}
    QUALIFY dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC) <= 3""",
)
def delta_history(v):
    return log.commit_history(actions(v), 3).withColumn("mode", F.col("parameters")["mode"]).drop("parameters")


def _schema_values(fields, comment):
    return ", ".join(f"({i}, '{n}', '{t}', {b}, '{n} {comment}', {n == 'day'})" for i, (n, t, b) in enumerate(fields))


_HAS_SECOND = "SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_linenumber = 5"


@query(
    "schema_extract",
    f"""
    WITH cols AS (
      SELECT 1 AS gen, * FROM (VALUES {_schema_values(_FIRST, "v1")}) t(position, column_name, data_type, nullable, comment, is_partition)
      UNION ALL SELECT 2, * FROM (VALUES {_schema_values(_SECOND, "v2")}) t),
    tables AS (SELECT DISTINCT l_partkey, CASE WHEN l_partkey IN ({_HAS_SECOND}) THEN 2 ELSE 1 END AS gen FROM {{lineitem}})
    SELECT 'lake/part_' || l_partkey AS location, position, column_name, data_type, nullable, comment, is_partition
    FROM tables JOIN cols USING (gen)""",
)
def schema_extract(v):
    return log.extract_schema(log.table_metadata(actions(v)), ["location"])


_CHANGES = """(VALUES ('amount', 'double', 'decimal(12,2)', true, true, 'modified'), ('day', 'date', 'date', true, false, 'modified'),
    ('note', NULL, 'string', NULL, true, 'added'), ('status', 'string', NULL, true, NULL, 'removed'))
    c(column_name, old_type, new_type, old_nullable, new_nullable, change_kind)"""


@query("schema_diff", f"SELECT 'lake/part_' || l_partkey AS location, c.* FROM ({_HAS_SECOND}) CROSS JOIN {_CHANGES}")
def schema_diff(v):
    return log.schema_diff(actions(v), 0, 8)


@query(
    "schema_diff_all_versions",
    f"SELECT 'lake/part_' || l_partkey AS location, CAST(5 AS BIGINT) AS version, c.* FROM ({_HAS_SECOND}) CROSS JOIN {_CHANGES}",
)
def schema_diff_all_versions(v):
    return log.schema_changes(actions(v))
