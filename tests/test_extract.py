"""SELECT items read as text."""

from conftest import rows

from tablewarden.operators import lineage_extract as ops

ITEM = "query_id bigint, branch int, target_table string, target_column string, expr string, is_wildcard boolean"
TABLE = "query_id bigint, branch int, ordinal int, alias string, `table` string"

# item, kind, columns, default name
CASES = [
    ("customer_id", "direct", ["customer_id"], "customer_id"),
    ("o.customer_id", "direct", ["customer_id"], "customer_id"),
    ('"Order Id"', "direct", ["Order Id"], "Order Id"),
    ("(amount)", "direct", ["amount"], "?column?"),
    ("SUM(amount)", "aggregate", ["amount"], "SUM"),
    ("count(DISTINCT order_id)", "aggregate", ["order_id"], "count"),
    ("SUM(amount) FILTER (WHERE ok)", "aggregate", ["amount", "ok"], "SUM"),
    ("SUM(amount) OVER w", "window", ["amount"], "SUM"),
    ("SUM(a) OVER (PARTITION BY b) + 1", "expression", ["a", "b"], "?column?"),
    ("price * quantity", "expression", ["price", "quantity"], "?column?"),
    ("(price * quantity) - discount", "expression", ["price", "quantity", "discount"], "?column?"),
    ("(a + b) * (c - d)", "expression", ["a", "b", "c", "d"], "?column?"),
    ("CASE WHEN status = 'active' THEN 1 ELSE 0 END", "case", ["status"], "?column?"),
    ("CASE WHEN a IN (1, 2) THEN b END", "case", ["a", "b"], "?column?"),
    ("CAST(amount AS INTEGER)", "cast", ["amount"], "?column?"),
    ("CAST(a AS double precision) + b", "expression", ["a", "b"], "?column?"),
    ("a + b::int", "expression", ["a", "b"], "?column?"),
    ("UPPER(TRIM(customer_name))", "expression", ["customer_name"], "UPPER"),
    ("name ILIKE '%SUM(x)%'", "expression", ["name"], "?column?"),
    ("COALESCE(a, 'it''s (b)', c)", "expression", ["a", "c"], "COALESCE"),
    ("d + INTERVAL '1' DAY", "expression", ["d"], "?column?"),
    ("a = a", "expression", ["a", "a"], "?column?"),
]


def _items(spark, exprs):
    return spark.createDataFrame([(i, 0, "t", None, e, False) for i, e in enumerate(exprs)], ITEM)


def test_kinds_columns_and_names(spark):
    texts = {r["expr"]: r for r in ops.read_texts(_items(spark, [c[0] for c in CASES])).collect()}
    tables = spark.createDataFrame([(i, 0, 1, None, "orders") for i in range(len(CASES))], TABLE)
    got = {}
    for r in ops.extract(_items(spark, [c[0] for c in CASES]), tables).collect():
        got.setdefault(CASES[r["query_id"]][0], []).append(r["source_column"])
    for expr, kind, columns, name in CASES:
        assert (texts[expr]["kind"], texts[expr]["name"]) == (kind, name), expr
        assert sorted(got[expr]) == sorted(columns), expr
        assert (texts[expr]["text"] is None) == (kind == "direct"), expr


def test_long_items_are_read(spark):
    literals = ", ".join(f"'x{i}'" for i in range(15000))
    sums = " + ".join(f"c{i}" for i in range(12000))
    nested = "(" * 400 + "a" + ")" * 400
    cases = "CASE WHEN a = 1 THEN " * 300 + "b" + " END" * 300
    exprs = [f"status IN ({literals})", sums, f"f({nested}) + b", cases, "CAST(a AS " + "w " * 20000 + ")"]
    texts = {r["expr"]: r for r in ops.read_texts(_items(spark, exprs)).collect()}
    assert [texts[e]["kind"] for e in exprs[:4]] == ["expression", "expression", "expression", "case"]
    assert texts[exprs[0]]["text"] == "status" and texts[exprs[0]]["refs"] == ["status"]
    assert len(texts[sums]["refs"]) == 12000 and texts[exprs[2]]["refs"] == ["a", "b"]


def test_operand_text(spark):
    exprs = ["x IN (1, 2)", "lower(x) NOT IN ('a')", "x BETWEEN 1 AND y", "a AND x IN (1)", "NOT x IN (1)"]
    texts = {r["expr"]: r["text"] for r in ops.read_texts(_items(spark, exprs)).collect()}
    assert texts == {exprs[0]: "x", exprs[1]: "lower(x)", exprs[2]: "x", exprs[3]: exprs[3], exprs[4]: exprs[4]}


def test_sources_and_warnings(spark):
    items = spark.createDataFrame(
        [(1, 0, "t", "a", "o.id", False), (1, 0, "t", "b", "z", False), (1, 1, "t", "a", "id", False), (2, 0, "t", None, "*", True),
         (3, 0, "t", "c", "(SELECT max(x) FROM y)", False)],
        ITEM,
    )
    tables = spark.createDataFrame([(1, 0, 1, "c", "customers"), (1, 0, 2, "o", "orders"), (1, 1, 1, "s", None), (2, 0, 1, None, "d1")], TABLE)
    edges = ops.resolve_tables(ops.extract(items, tables), tables)
    assert rows(edges, "branch", "source_table", "source_name") == [(0, "c", "customers"), (0, "o", "orders"), (1, "s", "<subquery:s>")]
    alone = ops.extract(items, tables.limit(0))
    assert rows(alone, "source_table") == [("<unknown>",), ("<unknown>",), ("o",)]
    assert sorted(r["query_id"] for r in ops.warnings(items).collect()) == [2, 3]
    datasets = spark.createDataFrame([(1, "d1")], "id bigint, name string")
    fields = spark.createDataFrame([(1, "p"), (1, "q")], "dataset_id bigint, name string")
    assert rows(ops.expand_wildcards(items, tables, datasets, fields)[0], "source_column", "target_column") == [("p", "p"), ("q", "q")]
