"""Catalog tables derived from the driver tables.

Each view is one SQL text in the dialect Spark and DuckDB share, so the operators and their
oracles start from the same catalog. ``$TS`` is the zone-less timestamp literal of the engine.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

AS_OF = "2024-01-31 00:00:00"

FIELD_NAMES = ["user_email", "customer_ssn", "phone_number", "amount", "client_ip", "card_number", "status"]
FIELD_TYPES = ["Utf8", "varchar", "STRING", "decimal(12, 2)", "text", "bigint", "timestamp[ms, tz=UTC]"]


def _pick(index: str, values: list[str | None], first: int = 1) -> str:
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values, first)
    )
    return f"CASE {index} {arms} END"


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_N_PART = "(SELECT count(*) FROM {part})"
_SOURCE_FIELD = _pick("l_linenumber", FIELD_NAMES)

VIEWS: dict[str, str] = {
    "datasets": f"""
        SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || {_text('p_partkey')} AS name,
          's3://lake/' || p_type || '/' || {_text('p_partkey')} AS path, p_type AS format, p_name AS description,
          'tenant_' || {_text('p_partkey % 25')} AS tenant,
          CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS domain,
          'owner_' || {_text('p_partkey % 50')} AS owner,
          $TS '2023-06-01 00:00:00' + INTERVAL '1' HOUR * (p_partkey % 700) AS created_at,
          $TS '{AS_OF}' - INTERVAL '1' HOUR * (p_partkey % 90) AS last_updated,
          CAST(p_size AS BIGINT) * 1000 AS row_count, CAST(floor(p_retailprice * 1024) AS BIGINT) AS size_bytes,
          {_pick('p_partkey % 4', ['["ship_date"]', '["region","day"]', None, 'not json'], 0)} AS partition_keys
        FROM {{part}}""",
    "fields": f"""
        SELECT DISTINCT l_partkey * 10 + l_linenumber AS id, l_partkey AS dataset_id, {_SOURCE_FIELD} AS name,
          {_pick('l_linenumber', FIELD_TYPES)} AS data_type, l_linenumber % 2 = 0 AS nullable
        FROM {{lineitem}}""",
    "tags": f"""
        SELECT DISTINCT l_partkey AS dataset_id,
          CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'new' END || ':' ||
          CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'filled' END AS tag
        FROM {{lineitem}}""",
    "column_lineage": f"""
        SELECT DISTINCT l_partkey AS source_dataset_id, {_SOURCE_FIELD} AS source_field_name,
          l_partkey + 1 + l_suppkey AS target_dataset_id,
          {_pick('1 + (l_linenumber + l_partkey) % 7', FIELD_NAMES)} AS target_field_name,
          {_pick('l_linenumber % 6', ['direct', 'aggregate', 'expression', 'window', 'case', None], 0)}
            AS transformation_type,
          {_pick('l_linenumber % 6', [None, 'SUM(x)', 'md5(x)', 'ROW_NUMBER() OVER (ORDER BY x)',
                                      'CASE WHEN x > 0 THEN x END', 'Round(x, 2)'], 0)} AS expression
        FROM {{lineitem}} WHERE l_partkey + 1 + l_suppkey < {_N_PART}""",
    "lineage": """
        SELECT DISTINCT source_dataset_id AS upstream_dataset_id, target_dataset_id AS downstream_dataset_id
        FROM {column_lineage}""",
    "domains": """
        SELECT DISTINCT p_brand AS name, CAST(replace(p_brand, 'Brand#', '') AS INT) % 6 <> 0 AS is_active FROM {part}
        UNION ALL SELECT r_name AS name, true AS is_active FROM {region}""",
    "owners": f"""
        SELECT 'owner_' || {_text('s_suppkey')} AS owner_id, s_name AS name,
          {_pick('s_suppkey % 3', ['user', 'team', 'service'], 0)} AS owner_type FROM {{supplier}}""",
    "glossary_terms": f"""
        SELECT c_custkey AS id, c_name AS term, 'Brand#' || {_text('1 + c_nationkey')} AS domain,
          {_pick('c_nationkey % 3', [None, 'approved', 'deprecated'], 0)} AS status FROM {{customer}}""",
    "term_links": f"""
        SELECT o_orderkey AS id, o_custkey AS term_id,
          CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 6 = 2 THEN o_orderkey % {_N_PART} END AS dataset_id,
          CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 6 = 2
               THEN (o_orderkey % {_N_PART}) * 10 + 1 + o_orderkey % 7 END AS field_id
        FROM {{orders}}""",
    "freshness_config": f"""
        SELECT p_partkey AS dataset_id, CAST(3600 * (1 + p_size % 24) AS BIGINT) AS expected_interval_secs,
          CAST(600 * (p_size % 5) AS BIGINT) AS grace_period_secs, p_size % 7 <> 0 AS alert_on_stale,
          CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '[]'
            ELSE '["https://hooks.example.com/ds/' || {_text('p_partkey')} || '"]' END AS alert_channels
        FROM {{part}} WHERE p_partkey % 3 <> 0""",
    "quality_metrics": """
        SELECT l_partkey * 100000000 + year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS id,
          l_partkey AS dataset_id, l_shipdate AS computed_at,
          round(1 - 2 * avg(l_discount), 6) AS completeness_score,
          CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE round(10 * avg(l_tax), 6) END AS freshness_score,
          round(0.5 + avg(l_quantity) / 100, 6) AS file_health_score,
          round(0.4 * avg(1 - 2 * l_discount) + 0.4 * avg(10 * l_tax), 6) AS overall_score
        FROM {lineitem} GROUP BY l_partkey, l_shipdate""",
    "data_files": """
        SELECT l_partkey AS dataset_id, l_suppkey AS file_no, count(*) AS num_records,
          count(*) - count(nullif(l_quantity, 1.0)) AS null_quantity,
          count(*) - count(nullif(l_returnflag, 'N')) AS null_flag,
          min(nullif(l_quantity, 1.0)) AS min_quantity, max(nullif(l_quantity, 1.0)) AS max_quantity,
          min(nullif(l_returnflag, 'N')) AS min_flag, max(nullif(l_returnflag, 'N')) AS max_flag,
          min(9007199254740993 + l_orderkey) AS min_key, max(9007199254740993 + l_orderkey) AS max_key,
          min(CAST(l_extendedprice AS DECIMAL(18, 3))) AS min_price, max(CAST(l_extendedprice AS DECIMAL(18, 3))) AS max_price,
          min(CAST(l_shipdate AS DATE)) AS min_date, max(CAST(l_shipdate AS DATE)) AS max_date,
          count(*) * 20000000 * (1 + l_suppkey % 10) AS size,
          CASE WHEN l_suppkey % 17 = 3 THEN 'malformed' WHEN l_suppkey % 19 = 5 THEN 'missing' ELSE 'ok' END AS stats_kind
        FROM {lineitem} GROUP BY l_partkey, l_suppkey""",
    "access_events": f"""
        SELECT event_id, event_id % {_N_PART} AS dataset_id,
          CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'user_' || {_text('user_id')} END AS user_name,
          CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'lineage_query'
            WHEN 'signup' THEN 'search_appearance' ELSE 'api_call' END AS access_type, ts
        FROM {{events}}""",
    "audit_log": f"""
        SELECT event_id AS id, ts AS timestamp,
          CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update' WHEN 'view' THEN 'read'
            WHEN 'click' THEN 'search' ELSE 'delete' END AS action,
          {_pick('event_id % 3', ['dataset', 'field', 'tag'], 0)} AS entity_type,
          {_text('event_id % 40')} AS entity_id, 'user_' || {_text('user_id')} AS actor,
          {_pick('user_id % 4', ['user', 'service', 'system', 'anonymous'], 0)} AS actor_type,
          'req_' || {_text('CAST(floor(event_id / 4) AS BIGINT)')} AS request_id,
          'tenant_' || {_text('user_id % 25')} AS tenant_id, props AS new_values
        FROM {{events}}""",
    "requests": f"""
        SELECT event_id AS request_id, ts,
          CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' ELSE 'GET' END AS method,
          '/api/v1/' || CASE event_type WHEN 'signup' THEN 'datasets' WHEN 'purchase' THEN 'lineage'
            WHEN 'click' THEN 'search' ELSE 'datasets/:name' END AS path,
          CASE event_type WHEN 'error' THEN 500 + CAST(user_id % 4 AS INT)
            WHEN 'click' THEN CASE WHEN user_id % 10 = 0 THEN 404 WHEN user_id % 10 = 1 THEN 429 ELSE 200 END
            WHEN 'signup' THEN 201 ELSE 200 END AS status,
          value / 40 AS latency_secs,
          CASE event_type WHEN 'view' THEN 'get_dataset' WHEN 'click' THEN 'search_datasets' ELSE 'list_datasets' END
            AS operation,
          CASE WHEN user_id % 5 <> 0 THEN 'tenant_' || {_text('user_id % 25')} END AS tenant_id,
          CASE WHEN user_id % 4 <> 0 THEN 'key_' || {_text('user_id')} END AS api_key_id,
          CASE WHEN user_id % 7 <> 0 THEN '10.0.0.' || {_text('user_id')} END AS client_ip
        FROM {{events}}""",
    "tenants": f"""
        SELECT 'tenant_' || {_text('n_nationkey')} AS tenant_id, n_name AS display_name,
          {_pick('n_nationkey % 4', list(('free', 'standard', 'premium', 'enterprise')), 0)} AS tier,
          CASE WHEN n_nationkey % 7 = 0 THEN CAST(0 AS BIGINT)
            ELSE CAST(25 * (1 + n_nationkey % 5) AS BIGINT) END AS quota_max_datasets
        FROM {{nation}}""",
    "alert_history": f"""
        SELECT event_id AS id,
          CASE event_type WHEN 'view' THEN 'freshness' WHEN 'click' THEN 'quality' WHEN 'error' THEN 'contract'
            ELSE 'schema' END AS alert_type,
          event_id % {_N_PART} AS dataset_id,
          CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'tenant_' || {_text(f'(event_id % {_N_PART}) % 25')} END AS tenant_id,
          CASE WHEN value > 100 THEN 'critical' WHEN value > 40 THEN 'warning' ELSE 'info' END AS severity,
          'alert ' || {_text('event_id')} AS message,
          {_pick('user_id % 3', ['delivered', 'failed', 'pending'], 0)} AS delivery_status,
          CAST(user_id % 3 AS INT) AS delivery_attempts, ts AS created_at,
          CASE WHEN user_id % 4 = 0 THEN ts + INTERVAL '2' HOUR END AS resolved_at
        FROM {{events}}""",
    "alert_candidates": """
        SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'freshness' ELSE 'quality' END AS alert_type,
          user_id AS dataset_id, ts AS created_at, user_id % 11 <> 0 AS has_channel FROM {events}""",
    "contracts": f"""
        SELECT s_suppkey AS id, CASE WHEN s_suppkey % 23 = 4 THEN '9bad name' ELSE 'contract_' || {_text('s_suppkey')} END AS name,
          CASE s_suppkey % 7
            WHEN 0 THEN replace(p_name, ' ', '_') || '_' || {_text('p_partkey')}
            WHEN 1 THEN replace(p_name, ' ', '_') || '*'
            WHEN 2 THEN '*_' || {_text('p_partkey')}
            WHEN 3 THEN '*' || substr(p_name, 1, 2) || '*'
            WHEN 4 THEN substr(p_name, 1, 3) || '*' || {_text('s_suppkey % 10')}
            WHEN 5 THEN CASE WHEN s_suppkey % 15 = 5 THEN '*' ELSE 'x*y*z' END
            ELSE '*' || {_text('s_suppkey % 10')} END AS dataset_pattern,
          CASE WHEN s_suppkey % 29 = 0 THEN 0 ELSE 1 END AS version, s_suppkey % 9 <> 8 AS enabled,
          {_pick('s_suppkey % 3', ['alert', 'warn', 'block'], 0)} AS on_violation,
          CASE WHEN s_suppkey % 4 <> 0 THEN
            '{{{{"required_columns":[{{{{"name":"user_email","data_type":"Utf8","nullable":false}}}},'
            || '{{{{"name":"amount","data_type":"Float64"}}}},{{{{"name":"region","data_type":"Utf8"}}}}],'
            || '"allow_additional_columns":' || CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END || '}}}}' END
            AS schema_contract,
          CASE WHEN s_suppkey % 3 <> 0 THEN '{{{{"min_completeness":0.9,"min_overall":' ||
            CASE WHEN s_suppkey % 31 = 1 THEN '1.5' ELSE '0.5' END || '}}}}' END AS quality_contract,
          CASE WHEN s_suppkey % 41 = 7 THEN '{{{{"expected_interval_secs":60}}}}'
            WHEN s_suppkey % 5 <> 0 THEN '{{{{"max_staleness_secs":' ||
            {_text('CASE WHEN s_suppkey % 37 = 1 THEN -1 ELSE 3600 * (s_suppkey % 60) + 1 END')} || '}}}}' END
            AS freshness_contract,
          CASE s_suppkey % 6 WHEN 0 THEN '["ftp://x"]' WHEN 1 THEN '["webhook:https://h.example.com/a","https://"]'
            ELSE '["https://hooks.example.com/t/' || {_text('s_suppkey')} || '?k=1"]' END AS alert_channels
        FROM {{supplier}} JOIN {{part}} ON p_partkey = s_suppkey""",
    "classifications": f"""
        SELECT id AS field_id,
          CASE WHEN dataset_id % 5 = 4 AND name = 'status' THEN 'sensitive'
               WHEN name IN ('amount', 'status') THEN 'unknown' ELSE 'pii' END AS classification,
          CASE WHEN name IN ('amount', 'status') THEN NULL ELSE name END AS category,
          CASE WHEN dataset_id % 5 = 4 THEN CAST(1.0 AS DOUBLE)
            WHEN name IN ('amount', 'status') THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence,
          CASE WHEN dataset_id % 5 = 4 THEN 'manual' ELSE 'rule' END AS source,
          dataset_id % 5 = 4 AS verified
        FROM {{fields}} WHERE dataset_id % 7 <> 6""",
}
# str.format is applied once for Spark; doubled braces inside literals become single ones.
VIEWS = {k: v.replace("{{{{", "{{").replace("}}}}", "}}") for k, v in VIEWS.items()}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(sql) if f))


class Views:
    """The derived catalog of one data folder, as lazy DataFrames: ``Views(spark, folder).datasets``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = text.replace("$TS", "TIMESTAMP_NTZ")
        return self.spark.sql(text, **{n: getattr(self, n) for n in _needs(text)})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.table(name) if name in BASE_TABLES else self.sql(VIEWS[name])
        return self._made[name]


def _closure(names: list[str], done: dict[str, str]) -> dict[str, str]:
    for n in names:
        if n not in BASE_TABLES and n not in done:
            _closure(_needs(VIEWS[n]), done)
            done[n] = VIEWS[n]
    return done


def oracle(sql: str, recursive: bool = False) -> str:
    """DuckDB text for a query over the derived views, named in braces; the needed views become CTEs."""
    ctes = _closure(_needs(sql), {})
    plain = lambda s: s.format(**{n: n for n in _needs(s)}).replace("$TS", "TIMESTAMP")
    body = plain(sql).strip()
    head = ", ".join(f"{n} AS ({plain(s)})" for n, s in ctes.items())
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[len('WITH '):]}"
    return f"WITH {head} {body}"
