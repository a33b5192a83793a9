"""Classification queries over the derived fields and the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.fixed_values import DEFAULT_PII_RULES
from tablewarden.operators import classify as ops
from tablewarden.plans.registry import query

_NAMED = """SELECT l_partkey * 1000000 + l_orderkey * 10 + l_linenumber AS id, l_partkey AS dataset_id,
    CASE l_linenumber WHEN 1 THEN 'Billing_EMAIL' WHEN 2 THEN 'zip' WHEN 3 THEN 'description' WHEN 4 THEN 'ssn_phone'
      WHEN 5 THEN 'cellar_' || CAST(l_suppkey AS STRING) WHEN 6 THEN 'mobile_email_' || CAST(l_suppkey % 5 AS STRING)
      ELSE lower(l_returnflag) || '_total' END AS name FROM {lineitem}"""

_HINTS = ", ".join(f"({i}, '{n.removesuffix('_detection')}', {p}, '{h}')" for i, n, p, _, hs in DEFAULT_PII_RULES for h in hs)


@query(
    "classify_by_name",
    f"""
    WITH hints AS (SELECT * FROM (VALUES {_HINTS}) t(rule_id, category, priority, hint)),
    best AS (SELECT name, arg_min(category, priority * 100 + rule_id) AS category, arg_min(rule_id, priority * 100 + rule_id) AS rule_id
      FROM (SELECT DISTINCT name FROM ({_NAMED}) a) n JOIN hints ON contains(lower(name), hint) GROUP BY name)
    SELECT n.dataset_id, n.name AS column_name, CASE WHEN rule_id IS NULL THEN 'unknown' ELSE 'pii' END AS classification,
      coalesce(category, '-') AS category, CAST(CASE WHEN rule_id IS NULL THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence,
      CASE WHEN rule_id IS NULL THEN 'auto' ELSE 'rule' END AS source, coalesce(CAST(rule_id AS BIGINT), 0) AS rule_id
    FROM ({_NAMED}) n LEFT JOIN best b ON b.name = n.name""",
)
def classify_by_name(v):
    out = ops.classify_by_name(v.sql(_NAMED), ops.default_rules(v.spark)).drop("field_id")
    return out.withColumn("category", F.coalesce("category", F.lit("-"))).withColumn("rule_id", F.coalesce("rule_id", F.lit(0)))


def _content_sql(table: str, column: str, whole: bool) -> str:
    rows = []
    for _, name, _, patterns, _ in DEFAULT_PII_RULES:
        test = " OR ".join(
            f"regexp_matches({column}, '{p if whole else p.removeprefix('^').removesuffix('$')}')" for p in patterns
        ).replace("{", "{{").replace("}", "}}")
        rows.append(
            f"SELECT '{column}' AS column_name, '{name}' AS rule, count(*) FILTER ({test}) AS matching_values, "
            f"count({column}) AS checked_values FROM {{{table}}}"
        )
    return " UNION ALL ".join(rows)


@query("classify_by_content", _content_sql("documents", "text", False))
def classify_by_content(v):
    return ops.classify_by_content(v.documents, ["text"], whole_values=False)


@query("classify_by_content_chats", _content_sql("conversations", "text", False))
def classify_by_content_chats(v):
    return ops.classify_by_content(v.conversations, ["text"], whole_values=False)


@query("classify_by_content_whole_values", _content_sql("requests", "client_ip", True))
def classify_by_content_whole_values(v):
    return ops.classify_by_content(v.requests, ["client_ip"])


# Every string column of every given table; embeddings and labels have none.
_TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"],
    "conversations": ["role", "text"],
}


@query(
    "classify_by_content_scan",
    " UNION ALL ".join(f"SELECT '{t}' AS dataset, * FROM ({_content_sql(t, c, False)})" for t, columns in _TEXT_COLUMNS.items() for c in columns),
)
def classify_by_content_scan(v):
    return ops.scan_tables({t: v.table(t) for t in _TEXT_COLUMNS}, ops.default_rules(v.spark))


_SCAN = """SELECT id AS field_id, 'sensitive' AS classification, 'scan' AS category, CAST(0.7 AS DOUBLE) AS confidence,
    'auto' AS source FROM {fields} WHERE id % 2 = 0"""


@query(
    "classification_upsert",
    f"""SELECT coalesce(o.field_id, n.field_id) AS field_id,
      CASE WHEN n.field_id IS NULL OR o.verified THEN o.classification ELSE n.classification END AS classification,
      CASE WHEN n.field_id IS NULL OR o.verified THEN o.category ELSE n.category END AS category,
      CASE WHEN n.field_id IS NULL OR o.verified THEN o.confidence ELSE n.confidence END AS confidence,
      CASE WHEN n.field_id IS NULL OR o.verified THEN o.source ELSE n.source END AS source, coalesce(o.verified, false) AS verified
    FROM {{classifications}} o FULL JOIN ({_SCAN}) n ON n.field_id = o.field_id""",
)
def classification_upsert(v):
    return ops.upsert_classifications(v.classifications, v.sql(_SCAN))


_DECIDED = "SELECT id AS field_id, 'confidential' AS classification, 'hr' AS category FROM {fields} WHERE name = 'amount'"


@query(
    "classification_manual",
    f"""SELECT field_id, classification, category, confidence, source, verified FROM {{classifications}}
      WHERE field_id NOT IN (SELECT field_id FROM ({_DECIDED}) d)
    UNION ALL SELECT field_id, classification, category, CAST(1.0 AS DOUBLE), 'manual', true FROM ({_DECIDED}) d""",
)
def classification_manual(v):
    return ops.set_manual(v.classifications, v.sql(_DECIDED))


_REPORT = """SELECT f.dataset_id, f.id AS field_id, f.name AS field_name, coalesce(c.classification, 'unknown') AS classification,
    c.category, c.confidence, c.source, coalesce(c.verified, false) AS verified
    FROM {fields} f LEFT JOIN {classifications} c ON c.field_id = f.id"""


@query("classification_report", _REPORT)
def classification_report(v):
    return ops.report(v.fields, v.classifications)


@query(
    "classification_report_counts",
    f"""SELECT dataset_id, count(*) FILTER (classification = 'pii') AS pii_count,
      count(*) FILTER (classification = 'unknown') AS unclassified_count FROM ({_REPORT}) r GROUP BY dataset_id""",
)
def classification_report_counts(v):
    return ops.report_counts(ops.report(v.fields, v.classifications))


_PII = """SELECT d.name AS dataset_name, f.name AS field_name, c.category, c.confidence, c.verified
    FROM {classifications} c JOIN {fields} f ON f.id = c.field_id JOIN {datasets} d ON d.id = f.dataset_id
    WHERE c.classification = 'pii'"""


@query("pii_inventory", _PII)
def pii_inventory(v):
    return ops.pii_inventory(v.classifications, v.fields, v.datasets)


@query("pii_inventory_totals", f"SELECT count(*) AS total_pii_columns, count(*) FILTER (verified) AS verified_count FROM ({_PII}) p")
def pii_inventory_totals(v):
    return ops.pii_totals(ops.pii_inventory(v.classifications, v.fields, v.datasets))


_RULES = """SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'pii_detection' WHEN 1 THEN 'retention'
    ELSE 'access_control' END AS rule_type, CAST(10 * (s_nationkey % 4) AS INT) AS priority, s_suppkey % 5 <> 0 AS is_active
    FROM {supplier}"""


@query("governance_rule_list", f"SELECT * FROM ({_RULES}) r ORDER BY priority, name LIMIT 20 OFFSET 5")
def governance_rule_list(v):
    return ops.list_rules(v.sql(_RULES), 20, 5)
