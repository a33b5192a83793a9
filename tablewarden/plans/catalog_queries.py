"""Catalog, domain, glossary, tag, owner and quota queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import catalog as ops
from tablewarden.operators import lineage, quality, tenancy
from tablewarden.plans.registry import query


@query("catalog_list", "SELECT * FROM {datasets}")
def catalog_list(v):
    return ops.listing(v.datasets)


@query("catalog_list_tenant", "SELECT * FROM {datasets} WHERE tenant = 'tenant_3'")
def catalog_list_tenant(v):
    return ops.listing(v.datasets, tenant="tenant_3")


_ATTRIBUTES = ["name", "path", "format", "description", "tenant", "domain", "owner", "created_at", "last_updated", "row_count", "size_bytes"]
_LATEST = "(SELECT * FROM {quality_metrics} QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY computed_at DESC, id DESC) = 1)"


@query(
    "catalog_detail",
    " UNION ALL ".join(
        [f"SELECT id AS dataset_id, 'dataset' AS section, '{a}' AS item, CAST({a} AS VARCHAR) AS value FROM {{datasets}} WHERE {a} IS NOT NULL" for a in _ATTRIBUTES]
        + [
            "SELECT dataset_id, 'field', name, data_type || CASE WHEN nullable THEN ' null' ELSE ' not null' END FROM {fields}",
            "SELECT dataset_id, 'tag', tag, '' FROM {tags}",
            "SELECT l.downstream_dataset_id, 'upstream', d.name, '' FROM {lineage} l JOIN {datasets} d ON d.id = l.upstream_dataset_id",
            "SELECT l.upstream_dataset_id, 'downstream', d.name, '' FROM {lineage} l JOIN {datasets} d ON d.id = l.downstream_dataset_id",
            "SELECT target_dataset_id, 'column_lineage', target_field_name, source_dataset_id || '.' || source_field_name FROM {column_lineage}",
        ]
        + [
            f"SELECT dataset_id, 'quality', '{s}', CAST(CAST({s} AS DECIMAL(9, 4)) AS VARCHAR) FROM {_LATEST} q WHERE {s} IS NOT NULL"
            for s in ("completeness_score", "freshness_score", "file_health_score", "overall_score")
        ]
    ),
)
def catalog_detail(v):
    near = lineage.neighbors(v.lineage, v.datasets)
    latest = quality.latest(v.quality_metrics)
    for c in latest.columns:
        if c.endswith("_score"):
            latest = latest.withColumn(c, F.col(c).cast("decimal(9,4)"))
    return ops.details(v.datasets, v.fields, v.tags, near, latest, v.column_lineage)


@query(
    "catalog_stats",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {{{t}}}" for t in ("datasets", "fields", "lineage", "tags")),
)
def catalog_stats(v):
    return ops.stats(datasets=v.datasets, fields=v.fields, lineage=v.lineage, tags=v.tags)


def _top(column):
    return f"SELECT {column}, count(*) AS datasets FROM {{datasets}} WHERE {column} IS NOT NULL GROUP BY ALL ORDER BY datasets DESC, {column} LIMIT 5"


@query("catalog_top_formats", _top("format"))
def catalog_top_formats(v):
    return ops.top_values(v.datasets, "format")


@query("catalog_top_domains", _top("domain"))
def catalog_top_domains(v):
    return ops.top_values(v.datasets, "domain")


@query(
    "domain_counts",
    """SELECT m.name, count(d.id) AS dataset_count FROM {domains} m LEFT JOIN {datasets} d ON d.domain = m.name
    WHERE m.is_active GROUP BY m.name""",
)
def domain_counts(v):
    return ops.domain_counts(v.domains, v.datasets)


@query("domain_datasets", "SELECT domain, id, name FROM {datasets} WHERE domain IN (SELECT name FROM {domains} WHERE is_active)")
def domain_datasets(v):
    return ops.domain_datasets(v.domains, v.datasets)


@query(
    "glossary_link_counts",
    """SELECT g.id, g.term, g.domain, coalesce(g.status, 'draft') AS status, count(l.id) AS link_count
    FROM {glossary_terms} g LEFT JOIN {term_links} l ON l.term_id = g.id GROUP BY ALL""",
)
def glossary_link_counts(v):
    return ops.glossary_link_counts(v.glossary_terms, v.term_links)


@query(
    "glossary_links",
    """SELECT l.id, l.term_id, d.name AS dataset_name, f.name AS field_name FROM {term_links} l
    LEFT JOIN {datasets} d ON d.id = l.dataset_id LEFT JOIN {fields} f ON f.id = l.field_id""",
)
def glossary_links(v):
    return ops.glossary_links(v.term_links, v.datasets, v.fields)


@query("glossary_link_check", "SELECT id, term_id FROM {term_links} WHERE (dataset_id IS NULL) = (field_id IS NULL)")
def glossary_link_check(v):
    return ops.glossary_link_check(v.term_links).select("id", "term_id")


_TAGS = """SELECT id AS dataset_id, CASE WHEN id % 2 = 0 THEN 'new:open' ELSE 'gold' END AS tag FROM {datasets}"""


@query("tag_apply", f"SELECT * FROM {{tags}} UNION {_TAGS}")
def tag_apply(v):
    return ops.add_tags(v.tags, v.sql(_TAGS))


@query("tag_remove", f"SELECT * FROM {{tags}} EXCEPT {_TAGS}")
def tag_remove(v):
    return ops.remove_tags(v.tags, v.sql(_TAGS))


@query("owner_list", "SELECT * FROM {owners} ORDER BY name, owner_id LIMIT 40 OFFSET 3")
def owner_list(v):
    return ops.owner_list(v.owners, 40, 3)


_USAGE = """SELECT t.tenant_id, t.quota_max_datasets AS quota, count(d.id) AS n,
    CASE WHEN t.quota_max_datasets > 0 THEN count(d.id) / t.quota_max_datasets ELSE 0.0 END AS r
    FROM {tenants} t LEFT JOIN {datasets} d ON d.tenant = t.tenant_id GROUP BY t.tenant_id, t.quota_max_datasets"""


@query(
    "quota_usage",
    f"""SELECT tenant_id, n AS dataset_count, quota AS quota_max_datasets, CAST(round(r, 6) AS DOUBLE) AS usage_ratio,
      CASE WHEN quota <= 0 THEN 'unlimited' WHEN r >= 1 THEN 'exceeded' WHEN r >= 0.8 THEN 'warning' ELSE 'ok' END AS status,
      CASE WHEN quota <= 0 THEN NULL WHEN r >= 1 THEN 'over quota: ' || n || ' of ' || quota
        WHEN r >= 0.8 THEN 'near quota: ' || n || ' of ' || quota || ' (' || printf('%.0f', r * 100) || '%)' END AS warning
    FROM ({_USAGE}) u""",
)
def quota_usage(v):
    return tenancy.usage(v.tenants, v.datasets).withColumn("usage_ratio", F.round("usage_ratio", 6))


_ASKED = "SELECT event_id AS id, 'tenant_' || CAST(user_id % 25 AS STRING) AS tenant_id, ts AS requested_at FROM {events}"


def _admission_sql(over: str) -> str:
    return f"""SELECT a.id, a.tenant_id, a.place, CASE WHEN u.tenant_id IS NULL THEN 'unknown_tenant' WHEN u.quota > 0 AND u.n + a.place - 1 >= u.quota THEN '{over}' ELSE 'admitted' END AS decision
    FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY requested_at, id) AS place FROM ({_ASKED}) q) a
    LEFT JOIN ({_USAGE}) u ON u.tenant_id = a.tenant_id"""


@query("quota_admission", _admission_sql("admitted_with_warning"))
def quota_admission(v):
    return tenancy.admission(v.sql(_ASKED), v.tenants, v.datasets, F.date_trunc("hour", F.col("requested_at")))


@query("quota_admission_enforced", _admission_sql("blocked"))
def quota_admission_enforced(v):
    return tenancy.admission(v.sql(_ASKED), v.tenants, v.datasets, F.date_trunc("hour", F.col("requested_at")), dry_run=False)
