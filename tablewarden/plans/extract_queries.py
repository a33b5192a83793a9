"""Lineage extraction over a query log derived from lineitem: every line is one SELECT item."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import lineage_extract as ops
from tablewarden.plans.registry import query

# (item text, name, kind, expression or None for the item, [(qualifier or None, column), ...])
ITEMS = [
    ("o.customer_id", "customer_id", "direct", None, [("o", "customer_id")]),
    ("amount", "amount", "direct", None, [(None, "amount")]),
    ("SUM(o.amount)", "SUM", "aggregate", "SUM(o.amount)", [("o", "amount")]),
    ("COUNT(*)", "COUNT", "aggregate", "COUNT(*)", []),
    ("price * quantity", "?column?", "expression", "price * quantity", [(None, "price"), (None, "quantity")]),
    ("((price * qty) - c.discount)", "?column?", "expression", "(price * qty) - c.discount",
     [(None, "price"), (None, "qty"), ("c", "discount")]),
    ("CASE WHEN status = 'in (x)' THEN SUM(a) ELSE 0 END", "?column?", "case", "CASE WHEN status = 'in (x)' THEN SUM(a) ELSE 0 END",
     [(None, "status"), (None, "a")]),
    ("CAST(amount AS DECIMAL(10, 2))", "?column?", "cast", "CAST(amount AS DECIMAL(10, 2))", [(None, "amount")]),
    ("o.amount::bigint", "?column?", "cast", "o.amount::bigint", [("o", "amount")]),
    ("ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY c.day DESC)", "ROW_NUMBER", "window",
     "ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY c.day DESC)", [(None, "customer_id"), ("c", "day")]),
    ("UPPER(TRIM(c.name))", "UPPER", "expression", "UPPER(TRIM(c.name))", [("c", "name")]),
    ("SUM(a) / COUNT(b)", "?column?", "expression", "SUM(a) / COUNT(b)", [(None, "a"), (None, "b")]),
    ("region IN ('a', 'b', other)", "?column?", "expression", "region", [(None, "region"), (None, "other")]),
    ("o.total NOT BETWEEN low AND c.high", "?column?", "expression", "o.total", [("o", "total"), (None, "low"), ("c", "high")]),
    ("x.note IS NOT NULL", "?column?", "expression", "x.note IS NOT NULL", [("x", "note")]),
    ("EXTRACT(YEAR FROM o.day)", "?column?", "expression", "EXTRACT(YEAR FROM o.day)", [("o", "day")]),
    ("COALESCE(MAX(a), 'none (yet)')", "COALESCE", "expression", "COALESCE(MAX(a), 'none (yet)')", [(None, "a")]),
    ("'it''s' || c.name", "?column?", "expression", "'it''s' || c.name", [("c", "name")]),
    ("42", "?column?", "expression", "42", []),
    ("db.sales.amount", "amount", "direct", None, [("sales", "amount")]),
    ("CASE a WHEN 1 THEN CASE WHEN b > 0 THEN c.d END END + 1", "?column?", "expression",
     "CASE a WHEN 1 THEN CASE WHEN b > 0 THEN c.d END END + 1", [(None, "a"), (None, "b"), ("c", "d")]),
    ("-amount", "?column?", "expression", "-amount", [(None, "amount")]),
    ("AVG(amount) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "AVG", "window",
     "AVG(amount) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", [(None, "amount"), (None, "day")]),
    ("name LIKE '%(x' AND NOT active", "?column?", "expression", "name LIKE '%(x' AND NOT active", [(None, "name"), (None, "active")]),
]
_N = len(ITEMS)


def _sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_PICK = "(l_orderkey + l_linenumber * 5 + l_suppkey) % " + str(_N)


def items(v):
    """Items of the log: query and branch from the order, one in three unnamed, one in fifty a wildcard."""
    texts = F.array(*[F.lit(i[0]) for i in ITEMS])
    number = F.expr(_PICK).cast("int")
    wild = F.col("l_orderkey") % 50 == 49
    star = F.when(F.col("l_linenumber") % 2 == 0, "*").otherwise("o.*")
    return v.lineitem.select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") % 2).alias("branch"),
        F.concat(F.lit("part_"), F.col("l_partkey")).alias("target_table"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("col_"), F.col("l_linenumber"))).alias("target_column"),
        F.when(wild, star).otherwise(texts[number]).alias("expr"), wild.alias("is_wildcard"),
    )


_TABLES = """
    SELECT o_orderkey AS query_id, b AS branch, CASE WHEN o_orderkey % 20 = 3 THEN 3 ELSE 1 END AS ordinal, 'o' AS alias,
      CASE WHEN b = 0 THEN 'hot_gear_' || CAST(o_custkey AS STRING) ELSE 'orders' END AS table_name FROM {orders} CROSS JOIN (SELECT 0 AS b UNION ALL SELECT 1) t
    UNION ALL SELECT o_orderkey, 0, 2, 'c', CAST(NULL AS STRING) FROM {orders}
    UNION ALL SELECT o_orderkey, 1, 2, CAST(NULL AS STRING), 'small_ring_' || CAST(o_custkey AS STRING) FROM {orders}"""


def tables(v):
    return v.sql(_TABLES).withColumnRenamed("table_name", "table")


_EDGE_ROWS = ", ".join(
    f"({n}, {_sql_text(kind)}, {_sql_text(text)}, {_sql_text(name)}, {_sql_text(q)}, {_sql_text(c)})"
    for n, (_, name, kind, text, refs) in enumerate(ITEMS)
    for q, c in refs
)
_SELECTED = f"""SELECT l_orderkey AS query_id, l_linenumber % 2 AS branch, 'part_' || l_partkey AS target_table, {_PICK} AS n,
    CASE WHEN l_partkey % 3 <> 0 THEN 'col_' || l_linenumber END AS target_column FROM {{lineitem}} WHERE l_orderkey % 50 <> 49"""
_FIRST = """CASE WHEN query_id % 20 <> 3 THEN 'o' WHEN branch = 0 THEN 'c' ELSE 'small_ring_' || o_custkey END"""


@query(
    "lineage_extract",
    f"""SELECT query_id, branch, coalesce(qualifier, {_FIRST}) AS source_table, source_column, target_table,
      coalesce(target_column, dflt) AS target_column, transformation, expression
    FROM ({_SELECTED}) s JOIN (VALUES {_EDGE_ROWS}) e(n, transformation, expression, dflt, qualifier, source_column) USING (n)
    JOIN {{orders}} ON o_orderkey = query_id""",
)
def lineage_extract(v):
    return ops.extract(items(v), tables(v))


@query(
    "lineage_extract_resolved",
    f"""SELECT query_id, branch, source_table, source_column, target_table, transformation, CASE source_table WHEN 'o' THEN CASE WHEN branch = 0 THEN 'hot_gear_' || o_custkey ELSE 'orders' END
        WHEN 'c' THEN CASE branch WHEN 0 THEN '<subquery:c>' ELSE 'c' END ELSE source_table END AS source_name
      FROM (SELECT query_id, branch, transformation, o_custkey, source_column, target_table, coalesce(qualifier, {_FIRST}) AS source_table
        FROM ({_SELECTED}) s JOIN (VALUES {_EDGE_ROWS}) e(n, transformation, expression, dflt, qualifier, source_column) USING (n)
        JOIN {{orders}} ON o_orderkey = query_id) x""",
)
def lineage_extract_resolved(v):
    edges = ops.resolve_tables(ops.extract(items(v), tables(v)), tables(v))
    return edges.select("query_id", "branch", "source_table", "source_column", "target_table", "transformation", "source_name")


_NAME_ROWS = ", ".join(f"({n}, {_sql_text(i[0])}, {_sql_text(i[1])})" for n, i in enumerate(ITEMS))


@query(
    "lineage_default_name",
    f"""SELECT query_id, branch, target_table, expr, name FROM ({_SELECTED}) s JOIN (VALUES {_NAME_ROWS}) t(n, expr, name) USING (n)
    WHERE target_column IS NULL""",
)
def lineage_default_name(v):
    unnamed = ops.default_names(items(v).where("NOT is_wildcard AND target_column IS NULL"))
    return unnamed.select("query_id", "branch", "target_table", "expr", "name")


@query(
    "lineage_source_tables",
    """SELECT o_orderkey AS query_id, 0 AS branch, CASE WHEN o_orderkey % 20 = 3 THEN 3 ELSE 1 END AS ordinal, 'o' AS source_table,
      'hot_gear_' || o_custkey AS table_name FROM {orders}
    UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderkey % 20 = 3 THEN 3 ELSE 1 END, 'o', 'orders' FROM {orders}
    UNION ALL SELECT o_orderkey, 0, 2, 'c', '<subquery:c>' FROM {orders}
    UNION ALL SELECT o_orderkey, 1, 2, 'small_ring_' || o_custkey, 'small_ring_' || o_custkey FROM {orders}""",
)
def lineage_source_tables(v):
    return ops.source_tables(tables(v))


@query(
    "lineage_set_op",
    f"""SELECT query_id, branch, count(*) AS edges, count(DISTINCT source_column) AS columns_read FROM ({_SELECTED}) s
    JOIN (VALUES {_EDGE_ROWS}) e(n, transformation, expression, dflt, qualifier, source_column) USING (n) GROUP BY ALL""",
)
def lineage_set_op(v):
    edges = ops.extract(items(v), tables(v))
    return edges.groupBy("query_id", "branch").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source_column").alias("columns_read"))


_WILD = """SELECT l_orderkey AS query_id, l_linenumber % 2 AS branch, 'part_' || l_partkey AS target_table, l_linenumber % 2 = 0 AS every
    FROM {lineitem} WHERE l_orderkey % 50 = 49"""
_USES = f"""SELECT w.*, 'o' AS source_table, CASE WHEN branch = 0 THEN 'hot_gear_' || o_custkey ELSE 'orders' END AS table_name
      FROM ({_WILD}) w JOIN {{orders}} ON o_orderkey = query_id
    UNION ALL SELECT w.*, CASE branch WHEN 0 THEN 'c' ELSE 'small_ring_' || o_custkey END,
      CASE branch WHEN 0 THEN '<subquery:c>' ELSE 'small_ring_' || o_custkey END
      FROM ({_WILD}) w JOIN {{orders}} ON o_orderkey = query_id WHERE every"""


@query(
    "lineage_wildcard_expand",
    f"""SELECT u.query_id, u.branch, u.source_table, f.name AS source_column, u.target_table, f.name AS target_column,
      'direct' AS transformation, CAST(NULL AS VARCHAR) AS expression FROM ({_USES}) u JOIN {{datasets}} d ON d.name = u.table_name JOIN {{fields}} f ON f.dataset_id = d.id""",
)
def lineage_wildcard_expand(v):
    return ops.expand_wildcards(items(v), tables(v), v.datasets, v.fields)[0]


@query(
    "lineage_wildcard_unknown",
    f"""SELECT query_id, branch, target_table, table_name AS unknown_table FROM ({_USES}) u
    WHERE table_name NOT IN (SELECT name FROM {{datasets}})""",
)
def lineage_wildcard_unknown(v):
    return ops.expand_wildcards(items(v), tables(v), v.datasets, v.fields)[1]


@query(
    "lineage_extract_warnings",
    f"""SELECT query_id, branch, target_table, 'columns unknown: ' || CASE WHEN every THEN '*' ELSE 'o.*' END AS warning
    FROM ({_WILD}) w""",
)
def lineage_extract_warnings(v):
    return ops.warnings(items(v))
