"""Lineage queries over the derived column graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.fixed_values import ANONYMISING_WORDS
from tablewarden.operators import lineage as ops
from tablewarden.plans.registry import query

ROOT = (10, "user_email")
LAST = (190, "user_email")
ROOT_FIELD = 101
DEPTH = 10


def _closure_sql(root: tuple[int, str], downstream: bool, extra: str, final: str) -> str:
    near, far = ("source", "target") if downstream else ("target", "source")
    cols = ", ".join(f"c.{x}" for x in extra.split()) if extra else ""
    cols = f", {cols}" if cols else ""
    return f"""
    WITH RECURSIVE walk AS (
      SELECT c.{far}_dataset_id AS dataset_id, c.{far}_field_name AS column_name{cols}, 1 AS depth
      FROM {{column_lineage}} c WHERE c.{near}_dataset_id = {root[0]} AND c.{near}_field_name = '{root[1]}'
      UNION
      SELECT c.{far}_dataset_id, c.{far}_field_name{cols}, w.depth + 1
      FROM {{column_lineage}} c JOIN (SELECT DISTINCT dataset_id, column_name, depth FROM walk) w
        ON c.{near}_dataset_id = w.dataset_id AND c.{near}_field_name = w.column_name WHERE w.depth < {DEPTH})
    {final}"""


_LIST = """SELECT DISTINCT w.dataset_id, d.name AS dataset_name, w.column_name, w.transformation_type, w.expression, w.depth
    FROM walk w JOIN {datasets} d ON d.id = w.dataset_id"""


@query("lineage_downstream", _closure_sql(ROOT, True, "transformation_type expression", _LIST))
def lineage_downstream(v):
    return ops.column_closure(v.column_lineage, v.datasets, *ROOT, downstream=True, max_depth=DEPTH)


@query("lineage_upstream", _closure_sql(LAST, False, "transformation_type expression", _LIST))
def lineage_upstream(v):
    return ops.column_closure(v.column_lineage, v.datasets, *LAST, downstream=False, max_depth=DEPTH)


_WORDS = " OR ".join(f"w.expression ILIKE '%{x}%'" for x in ANONYMISING_WORDS)


@query(
    "lineage_pii_propagation",
    _closure_sql(
        ROOT,
        True,
        "transformation_type expression",
        f"""SELECT DISTINCT w.dataset_id, d.name AS dataset_name, w.column_name,
            coalesce(w.transformation_type, 'direct') AS transformation_type, w.expression,
            coalesce(w.transformation_type IN ('aggregate', 'window'), false) OR coalesce({_WORDS}, false) AS may_anonymize
            FROM walk w JOIN {{datasets}} d ON d.id = w.dataset_id""",
    ),
)
def lineage_pii_propagation(v):
    return ops.pii_propagation(v.column_lineage, v.datasets, *ROOT, max_depth=DEPTH)


_IMPACT = """SELECT dataset_id, dataset_name, column_name, coalesce(transformation_type, 'direct') AS transformation_type,
      depth, CASE WHEN depth = 1 AND coalesce(transformation_type, 'direct') = 'direct' THEN 'high'
                  WHEN depth = 1 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT DISTINCT w.dataset_id, d.name AS dataset_name, w.column_name, w.transformation_type, w.depth
          FROM walk w JOIN {datasets} d ON d.id = w.dataset_id) u"""


@query("lineage_impact", _closure_sql(ROOT, True, "transformation_type", _IMPACT))
def lineage_impact(v):
    return ops.impact(v.column_lineage, v.datasets, v.fields, ROOT_FIELD, DEPTH)


@query(
    "lineage_impact_summary",
    _closure_sql(
        ROOT,
        True,
        "transformation_type",
        f"""SELECT count(*) AS total_affected_columns, count(DISTINCT dataset_id) AS affected_datasets,
            count(*) FILTER (transformation_type = 'direct') AS direct_dependencies,
            count(*) FILTER (transformation_type <> 'direct') AS derived_dependencies,
            coalesce(max(depth), 0) AS max_depth FROM ({_IMPACT}) i""",
    ),
)
def lineage_impact_summary(v):
    return ops.impact_summary(ops.impact(v.column_lineage, v.datasets, v.fields, ROOT_FIELD, DEPTH))


_REACH = """
    WITH RECURSIVE walk AS (
      SELECT DISTINCT {label} f.dataset_id, f.name AS column_name, 0 AS depth
      FROM {{classifications}} c JOIN {{fields}} f ON f.id = c.field_id WHERE c.classification = 'pii'
      UNION
      SELECT {label} e.target_dataset_id, e.target_field_name, c.depth + 1
      FROM {{column_lineage}} e JOIN walk c ON e.source_dataset_id = c.dataset_id AND e.source_field_name = c.column_name
      WHERE c.depth < 12)
    SELECT {label} dataset_id, column_name, min(depth) AS depth FROM walk c GROUP BY ALL HAVING min(depth) > 0"""


@query("pii_reach_all", _REACH.format(label=""))
def pii_reach_all(v):
    """Every column that is not personal data itself and that some reaches, with the steps from the nearest."""
    return ops.first_reach(v.column_lineage, ops.pii_roots(v.fields, v.classifications).drop("category", "field_id"))


@query("pii_reach_category", _REACH.format(label="c.category,"))
def pii_reach_category(v):
    return ops.first_reach(v.column_lineage, ops.pii_roots(v.fields, v.classifications).drop("field_id"))


@query(
    "lineage_neighbors",
    """
    SELECT l.downstream_dataset_id AS dataset_id, 'upstream' AS direction, d.name AS neighbor_name
    FROM {lineage} l JOIN {datasets} d ON d.id = l.upstream_dataset_id
    UNION ALL
    SELECT l.upstream_dataset_id, 'downstream', d.name FROM {lineage} l JOIN {datasets} d ON d.id = l.downstream_dataset_id""",
)
def lineage_neighbors(v):
    return ops.neighbors(v.lineage, v.datasets)


_NEW_EDGES = """SELECT o_custkey AS upstream_dataset_id, o_custkey + 1 + o_orderkey % 3 AS downstream_dataset_id FROM {orders}"""


@query("lineage_edge_upsert", f"SELECT * FROM {{lineage}} UNION {_NEW_EDGES}")
def lineage_edge_upsert(v):
    return ops.upsert_edges(v.lineage, v.sql(_NEW_EDGES))


@query(
    "lineage_delete",
    """SELECT * FROM {column_lineage} WHERE target_dataset_id NOT IN (SELECT id FROM {datasets} WHERE domain IS NULL)""",
)
def lineage_delete(v):
    gone = v.datasets.where("domain IS NULL").select(F.col("id").alias("dataset_id"))
    return ops.delete_edges(v.column_lineage, gone)


_RAW_EDGES = """
    SELECT l_partkey - 3 AS source_dataset_id,
      CASE WHEN l_orderkey % 50 = 7 THEN '' WHEN l_orderkey % 50 = 8 THEN repeat('ü', 130) ELSE 'c' || l_linenumber END
        AS source_field_name,
      l_suppkey + 1 AS target_dataset_id, CASE WHEN l_orderkey % 50 = 9 THEN NULL ELSE 't' || l_linenumber END
        AS target_field_name,
      CASE l_linenumber % 3 WHEN 0 THEN 'Direct' WHEN 1 THEN 'AGGREGATE' ELSE 'window' END AS transformation_type,
      CAST(NULL AS STRING) AS expression
    FROM {lineitem}"""


@query(
    "lineage_record",
    f"""SELECT source_dataset_id, source_field_name, target_dataset_id, target_field_name, lower(transformation_type) AS transformation_type,
      expression, CASE WHEN NOT coalesce(source_dataset_id > 0 AND target_dataset_id > 0, false) THEN 'dataset id not positive'
        WHEN coalesce(source_field_name, '') = '' OR coalesce(target_field_name, '') = '' THEN 'empty column name'
        WHEN strlen(source_field_name) > 256 OR strlen(target_field_name) > 256 THEN 'column name too long' END AS reason
      FROM ({_RAW_EDGES}) e""",
)
def lineage_record(v):
    return ops.check_edges(v.sql(_RAW_EDGES))
