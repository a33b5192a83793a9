"""Scans, type strings, descriptor rules and emission."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.exprs import json_string_list
from tablewarden.functions.types import canonical_type
from tablewarden.operators import ingest as ops
from tablewarden.plans.registry import alias, query
from tablewarden.plans.views import BASE_TABLES
from tablewarden.sources.catalog_store import scan_dataset as scan


@query(
    "scan_dataset",
    """SELECT l_orderkey, l_extendedprice, l_discount FROM {lineitem} WHERE l_quantity >= 30 AND l_returnflag = 'R'""",
)
def scan_dataset(v):
    rows = [(t, "sales", f"{v.folder}/{t}.parquet", "parquet") for t in BASE_TABLES]
    catalog = v.spark.createDataFrame(rows, "name string, domain string, path string, format string")
    return scan(catalog, "sales", "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"], "l_quantity >= 30 AND l_returnflag = 'R'")


_TYPES = """SELECT l_orderkey AS id, CASE l_linenumber
    WHEN 1 THEN CASE l_orderkey % 6 WHEN 0 THEN 'INT' WHEN 1 THEN ' bigint ' WHEN 2 THEN 'uint64' WHEN 3 THEN 'byte' WHEN 4 THEN 'Half' ELSE 'list<int>' END
    WHEN 2 THEN 'decimal(' || CAST(l_orderkey % 45 AS STRING) || ', ' || CAST(l_suppkey % 50 - 5 AS STRING) || ')'
    WHEN 3 THEN CASE l_orderkey % 4 WHEN 0 THEN 'decimal' WHEN 1 THEN 'decimal(x,2)' WHEN 2 THEN 'decimal(300,2)' ELSE 'decimal(5)' END
    WHEN 4 THEN CASE l_orderkey % 6 WHEN 0 THEN 'timestamp[ms]' WHEN 1 THEN 'Timestamp[ns, tz=Europe/Paris]' WHEN 2 THEN 'timestamp[s,tz=]'
      WHEN 3 THEN 'timestamptz' WHEN 4 THEN 'timestamp without time zone' ELSE 'timestamp(3) with time zone' END
    WHEN 5 THEN CASE l_orderkey % 3 WHEN 0 THEN 'time64[us]' WHEN 1 THEN 'null' ELSE 'struct<a:int>' END
    WHEN 6 THEN CASE l_orderkey % 3 WHEN 0 THEN 'LargeString' WHEN 1 THEN 'varbinary' ELSE 'date64' END
    ELSE 'boolean' END AS type_text FROM {lineitem}"""


@query(
    "type_normalize",
    f"""
    WITH src AS (SELECT type_text, count(*) AS n FROM ({_TYPES}) GROUP BY ALL),
    fixed AS (SELECT * FROM (VALUES
      ('INT', 'Int32', 'int', true), (' bigint ', 'Int64', 'bigint', true), ('uint64', 'UInt64', 'decimal(20,0)', true),
      ('byte', 'Int8', 'tinyint', true), ('Half', 'Float16', 'float', true), ('list<int>', 'Utf8', 'string', false),
      ('decimal', 'Decimal128(38, 10)', 'decimal(38,10)', true), ('decimal(x,2)', 'Decimal128(38, 10)', 'decimal(38,10)', true),
      ('decimal(300,2)', 'Decimal128(38, 10)', 'decimal(38,10)', true), ('decimal(5)', 'Decimal128(38, 10)', 'decimal(38,10)', true),
      ('timestamp[ms]', 'Timestamp(Millisecond)', 'timestamp_ntz', true),
      ('Timestamp[ns, tz=Europe/Paris]', 'Timestamp(Nanosecond, europe/paris)', 'timestamp', true),
      ('timestamp[s,tz=]', 'Timestamp(Second, UTC)', 'timestamp', true), ('timestamptz', 'Timestamp(Microsecond, UTC)', 'timestamp', true),
      ('timestamp without time zone', 'Timestamp(Microsecond)', 'timestamp_ntz', true),
      ('timestamp(3) with time zone', 'Timestamp(Microsecond, UTC)', 'timestamp', true),
      ('time64[us]', 'Time64(Microsecond)', 'string', true), ('null', 'Null', 'void', true), ('struct<a:int>', 'Utf8', 'string', false),
      ('LargeString', 'LargeUtf8', 'string', true), ('varbinary', 'Binary', 'binary', true), ('date64', 'Date64', 'date', true),
      ('boolean', 'Boolean', 'boolean', true)) t(type_text, canonical, spark_type, recognised)),
    nums AS (SELECT type_text, n, greatest(1, least(38, CAST(regexp_extract(type_text, '\\((\\d+), ', 1) AS INT))) AS p,
        CAST(regexp_extract(type_text, ', (-?\\d+)\\)', 1) AS INT) AS s
      FROM src WHERE regexp_matches(type_text, '^decimal\\(\\d+, -?\\d+\\)$'))
    SELECT src.type_text, canonical, spark_type, recognised, n FROM src JOIN fixed USING (type_text)
    UNION ALL SELECT type_text, 'Decimal128(' || p || ', ' || least(s, p) || ')', 'decimal(' || p || ',' || greatest(least(s, p), 0) || ')', true, n
    FROM nums""".replace("{2}", "{{2}}"),
)
def type_normalize(v):
    kinds = v.sql(_TYPES).groupBy("type_text").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("type_text", "n", canonical_type(F.col("type_text")).alias("t")).select("type_text", "t.*", "n")


@query(
    "partition_keys_parse",
    """SELECT id, CASE id % 4 WHEN 0 THEN 'ship_date' WHEN 1 THEN 'region,day' ELSE '' END AS keys,
      CAST(CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INT) AS n FROM {datasets}""",
)
def partition_keys_parse(v):
    keys = json_string_list(F.col("partition_keys"))
    return v.datasets.select("id", F.array_join(keys, ",").alias("keys"), F.size(keys).alias("n"))


_DESCRIPTORS = """SELECT p_partkey,
    CASE p_partkey % 9 WHEN 0 THEN '-' || p_name WHEN 1 THEN p_brand WHEN 2 THEN '' WHEN 3 THEN repeat(p_type, 60)
      WHEN 4 THEN replace(p_name, ' ', '-') || '-' WHEN 5 THEN repeat('é', 128) ELSE replace(p_name, ' ', '.') END AS name,
    CASE p_partkey % 4 WHEN 0 THEN 'file:///data/../etc' WHEN 1 THEN 's3://b/../x' ELSE 'file:///data/' || p_type END AS path,
    CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ten ant' ELSE 'tenant_1' END AS tenant,
    CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE 'größe-1' END AS domain FROM {part}"""


@query(
    "emit_validate",
    f"""
    WITH items AS (
      SELECT p_partkey, name, 'dataset' AS kind, name AS value FROM ({_DESCRIPTORS}) UNION ALL
      SELECT p_partkey, name, 'path', path FROM ({_DESCRIPTORS}) UNION ALL
      SELECT p_partkey, name, 'tenant', tenant FROM ({_DESCRIPTORS}) UNION ALL
      SELECT p_partkey, name, 'domain', domain FROM ({_DESCRIPTORS}) UNION ALL
      SELECT p_partkey, name, 'field', unnest(['id', path, 'naïve_1']) FROM ({_DESCRIPTORS}) UNION ALL
      SELECT p_partkey, name, 'tag', unnest(['a:b', tenant]) FROM ({_DESCRIPTORS})),
    judged AS (SELECT name, kind, value, CASE
        WHEN kind = 'path' THEN CASE WHEN starts_with(value, 'file://') AND contains(value, '..') THEN 'path traversal' END
        WHEN value = '' THEN 'empty'
        WHEN strlen(value) > CASE WHEN kind IN ('dataset', 'field') THEN 255 ELSE 100 END THEN 'too long'
        WHEN NOT regexp_full_match(value, CASE kind WHEN 'dataset' THEN '[\\pL\\pN_.-]*' WHEN 'field' THEN '[\\pL\\pN_]*'
          WHEN 'tag' THEN '[\\pL\\pN_:-]*' ELSE '[\\pL\\pN_-]*' END) THEN 'invalid characters'
        WHEN kind = 'dataset' AND (starts_with(value, '-') OR ends_with(value, '-')) THEN 'hyphen at the edge' END AS reason
      FROM items)
    SELECT * FROM judged WHERE reason IS NOT NULL""",
)
def emit_validate(v):
    batch = v.sql(_DESCRIPTORS).select(
        "name", "path", "tenant", "domain",
        F.array(*[F.struct(c.alias("name")) for c in (F.lit("id"), F.col("path"), F.lit("naïve_1"))]).alias("fields"),
        F.array(F.lit("a:b"), F.col("tenant")).alias("tags"),
    )
    return ops.violations(ops.descriptor_items(batch))


_EMITTED = """SELECT CASE WHEN id % 3 = 0 THEN name ELSE name || '_new' END AS name, id, format, description, tenant, domain
    FROM {datasets} WHERE id % 3 <> 1"""


def emitted(v):
    batch = v.sql(_EMITTED).select(
        "name", F.concat(F.lit("s3://new/"), "name").alias("path"), "format", "description", "tenant", "domain",
        F.lit("emitter").alias("owner"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("emitted_at"),
        (F.col("id") + 1).alias("row_count"), F.lit(7).cast("bigint").alias("size_bytes"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("day"))).otherwise(F.array().cast("array<string>")).alias("partition_keys"),
        F.array(
            F.struct(F.lit("id").alias("name"), F.lit("bigint").alias("data_type"), F.lit(False).alias("nullable")),
            F.struct(F.lit("value").alias("name"), F.lit("double").alias("data_type"), F.lit(True).alias("nullable")),
        ).alias("fields"),
        F.array(F.lit("nowhere"), F.concat(F.lit("hot_gear_"), F.col("id")), F.col("name")).alias("upstream"),
        F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("tags"),
    )
    before = ops.Catalog(v.datasets, v.fields.drop("id"), v.lineage, v.tags)
    return ops.emit(before, batch)


_AFTER = f"""
    WITH batch AS ({_EMITTED}),
    ds AS (
      SELECT name, path, owner, created_at, last_updated, row_count, size_bytes, partition_keys, id AS old_id FROM {{datasets}}
      WHERE name NOT IN (SELECT name FROM batch)
      UNION ALL
      SELECT b.name, 's3://new/' || b.name, 'emitter', coalesce(d.created_at, $TS '2024-02-01 00:00:00'), $TS '2024-02-01 00:00:00',
        b.id + 1, 7, CASE WHEN b.id % 2 = 0 THEN '["day"]' END, d.id
      FROM batch b LEFT JOIN {{datasets}} d ON d.name = b.name)"""


@query("emit_upsert", f"{_AFTER} SELECT name, path, owner, created_at, last_updated, row_count, size_bytes, partition_keys FROM ds")
def emit_upsert(v):
    return emitted(v).datasets.select(
        "name", "path", "owner", "created_at", "last_updated", "row_count", "size_bytes", "partition_keys"
    )


@query(
    "emit_upsert_children",
    f"""{_AFTER}, ids AS (SELECT name, old_id, name IN (SELECT name FROM batch) AS fresh FROM ds),
    kids AS (
      SELECT name, 'field' AS kind, unnest(['id', 'value']) AS item FROM ids WHERE fresh UNION ALL
      SELECT i.name, 'field', f.name FROM ids i JOIN {{fields}} f ON f.dataset_id = i.old_id WHERE NOT fresh UNION ALL
      SELECT name, 'tag', unnest(['a', 'b']) FROM ids WHERE fresh UNION ALL
      SELECT i.name, 'tag', t.tag FROM ids i JOIN {{tags}} t ON t.dataset_id = i.old_id WHERE NOT fresh UNION ALL
      SELECT DISTINCT i.name, 'upstream', u.name FROM ids i JOIN batch b ON b.name = i.name
        JOIN ids u ON u.name = i.name OR u.name = 'hot_gear_' || b.id WHERE i.fresh UNION ALL
      SELECT i.name, 'upstream', u.name FROM ids i JOIN {{lineage}} l ON l.downstream_dataset_id = i.old_id
        JOIN ids u ON u.old_id = l.upstream_dataset_id WHERE NOT i.fresh)
    SELECT name, kind, item, count(*) AS n FROM kids GROUP BY ALL""",
)
def emit_upsert_children(v):
    after = emitted(v)
    name = after.datasets.select(F.col("id").alias("dataset_id"), "name")
    up = after.datasets.select(F.col("id").alias("upstream_dataset_id"), F.col("name").alias("item"))
    kids = (
        after.fields.select("dataset_id", F.lit("field").alias("kind"), F.col("name").alias("item"))
        .unionByName(after.tags.select("dataset_id", F.lit("tag").alias("kind"), F.col("tag").alias("item")))
        .unionByName(
            after.lineage.join(up, "upstream_dataset_id").select(
                F.col("downstream_dataset_id").alias("dataset_id"), F.lit("upstream").alias("kind"), "item"
            )
        )
    )
    return kids.join(name, "dataset_id").groupBy("name", "kind", "item").agg(F.count(F.lit(1)).alias("n"))


@query("operational_meta", "SELECT CAST(count(*) AS BIGINT) AS row_count FROM {lineitem}")
def operational_meta(v):
    return ops.operational_meta(v.lineitem).select("row_count")


_TRANSACTIONS = """SELECT o_orderkey AS transaction_id, nullif(o_custkey, 1) AS customer_id,
    CASE WHEN o_orderkey % 10 = 3 THEN -o_totalprice ELSE o_totalprice END AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status FROM {orders}"""
_CLEAN = f"SELECT * FROM ({_TRANSACTIONS}) t WHERE status = 'completed' AND customer_id IS NOT NULL AND amount > 0"


@query("etl_clean", _CLEAN)
def etl_clean(v):
    return ops.clean_transactions(v.sql(_TRANSACTIONS))


@query(
    "etl_summary",
    f"""SELECT customer_id, count(*) AS transaction_count, round(sum(amount), 4) AS total_amount, round(avg(amount), 4) AS avg_amount
    FROM ({_CLEAN}) c GROUP BY customer_id""",
)
def etl_summary(v):
    out = ops.customer_summary(ops.clean_transactions(v.sql(_TRANSACTIONS)))
    return out.withColumn("total_amount", F.round("total_amount", 4)).withColumn("avg_amount", F.round("avg_amount", 4))


alias("pipeline_clean", "etl_clean")
alias("pipeline_summary", "etl_summary")
