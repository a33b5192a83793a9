"""Audit queries over a log derived from events, and events derived from two catalog snapshots."""

from __future__ import annotations

from tablewarden.operators import audit as ops
from tablewarden.plans.registry import query
from tablewarden.session import scratch_path

_NEXT = """SELECT id + CASE WHEN id % 10 = 0 THEN 1000000 ELSE 0 END AS id, name, CASE WHEN id % 7 = 1 THEN 'moved' ELSE domain END AS domain,
    row_count FROM {datasets}"""
_OLD = "SELECT id, name, domain, row_count FROM {datasets}"
_JSON = """CASE WHEN {x}.id IS NULL THEN NULL ELSE '{{{{"name":"' || {x}.name || '"' || CASE WHEN {x}.domain IS NULL THEN '' ELSE ',"domain":"' || {x}.domain || '"' END
    || ',"row_count":' || {x}.row_count || '}}}}' END"""


@query(
    "audit_events",
    f"""SELECT CASE WHEN o.id IS NULL THEN 'create' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS action, 'dataset' AS entity_type,
      CAST(coalesce(o.id, n.id) AS VARCHAR) AS entity_id, {_JSON.format(x='o')} AS old_values, {_JSON.format(x='n')} AS new_values
    FROM ({_OLD}) o FULL JOIN ({_NEXT}) n ON n.id = o.id
    WHERE o.id IS NULL OR n.id IS NULL OR o.domain IS DISTINCT FROM n.domain""",
)
def audit_events(v):
    return ops.snapshot_events(v.sql(_OLD), v.sql(_NEXT), "id", "dataset")


_DATASET_COLUMNS = "id name path format description tenant domain owner created_at last_updated row_count size_bytes partition_keys".split()
_FIELD_COLUMNS = "id dataset_id name data_type nullable".split()
_TAG_COLUMNS = ["dataset_id", "tag"]
_KEYS = {"dataset": ["id"], "field": ["id"], "tag": ["dataset_id", "tag"]}


def _select(columns: list[str], table: str, **changed: str) -> str:
    """A snapshot, with some columns changed and timestamps as text."""
    changed = {c: f"CAST({c} AS STRING)" for c in ("created_at", "last_updated")} | changed
    return "SELECT " + ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in columns) + f" FROM {{{table}}}"


_BEFORE = {"dataset": _select(_DATASET_COLUMNS, "datasets"), "field": _select(_FIELD_COLUMNS, "fields"), "tag": _select(_TAG_COLUMNS, "tags")}
_AFTER = {
    "dataset": _select(
        _DATASET_COLUMNS, "datasets", id="id + CASE WHEN id % 10 = 0 THEN 1000000 ELSE 0 END", domain="CASE WHEN id % 7 = 1 THEN NULL ELSE domain END",
        owner="CASE WHEN id % 13 = 2 THEN 'nobody' ELSE owner END", size_bytes="size_bytes + CASE WHEN id % 4 = 3 THEN 1 ELSE 0 END",
    ),
    "field": _select(
        _FIELD_COLUMNS, "fields", id="id + CASE WHEN dataset_id % 19 = 5 THEN 1000000000 ELSE 0 END",
        data_type="CASE WHEN dataset_id % 9 = 4 THEN NULL ELSE data_type END", nullable="CASE WHEN id % 23 = 6 THEN NOT nullable ELSE nullable END",
    ),
    "tag": _select(_TAG_COLUMNS, "tags", tag="CASE WHEN dataset_id % 5 = 1 THEN tag || ':old' ELSE tag END"),
}


def _events_sql(kind: str, columns: list[str]) -> str:
    pack = ", ".join(f"{c} := {c}" for c in columns)
    ids = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in _KEYS[kind])
    side = lambda sql: f"SELECT {ids} AS entity_id, CAST(to_json(struct_pack({pack})) AS VARCHAR) AS doc FROM ({sql}) s"
    return f"""SELECT CASE WHEN o.doc IS NULL THEN 'create' WHEN n.doc IS NULL THEN 'delete' ELSE 'update' END AS action, '{kind}' AS entity_type,
      coalesce(o.entity_id, n.entity_id) AS entity_id, o.doc AS old_values, n.doc AS new_values
    FROM ({side(_BEFORE[kind])}) o FULL JOIN ({side(_AFTER[kind])}) n ON n.entity_id = o.entity_id WHERE o.doc IS DISTINCT FROM n.doc"""


@query(
    "audit_events_catalog",
    " UNION ALL ".join(_events_sql(k, c) for k, c in (("dataset", _DATASET_COLUMNS), ("field", _FIELD_COLUMNS), ("tag", _TAG_COLUMNS))),
)
def audit_events_catalog(v):
    return ops.catalog_events({k: v.sql(s) for k, s in _BEFORE.items()}, {k: v.sql(s) for k, s in _AFTER.items()}, _KEYS)


_FILTER = "entity_type = 'dataset' AND action = 'read'"


@query(
    "audit_query",
    f"""SELECT *, (SELECT count(*) FROM {{audit_log}} WHERE {_FILTER}) AS total FROM {{audit_log}} WHERE {_FILTER}
    ORDER BY timestamp DESC, id DESC OFFSET 20""",
)
def audit_query(v):
    return ops.log_page(v.audit_log, offset=20, entity_type="dataset", action="read")


@query(
    "audit_query_all",
    "SELECT * FROM {audit_log} WHERE actor = 'user_7' AND entity_type = 'field'",
)
def audit_query_all(v):
    return ops.log_filter(v.audit_log, actor="user_7", entity_type="field")


@query(
    "audit_tenant_query",
    """SELECT *, (SELECT count(*) FROM {audit_log} WHERE tenant_id = 'tenant_4') AS total FROM {audit_log} WHERE tenant_id = 'tenant_4'
    ORDER BY timestamp DESC, id DESC LIMIT 50""",
)
def audit_tenant_query(v):
    return ops.log_page(v.audit_log, limit=50, tenant_id="tenant_4")


@query("audit_write", "SELECT *, CAST(timestamp AS DATE) AS log_date FROM {audit_log}")
def audit_write(v):
    folder = scratch_path(v.spark, "audit-log")
    ops.append(folder, v.audit_log.where("actor_type = 'user'"))
    ops.append(folder, v.audit_log.where("actor_type <> 'user'"))
    return v.spark.read.parquet(folder)
