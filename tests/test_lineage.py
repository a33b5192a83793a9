"""Traversal, propagation and impact on hand-made graphs."""

import random

import pytest
from conftest import rows

from tablewarden.operators import lineage as ops

EDGE = "source_dataset_id bigint, source_field_name string, target_dataset_id bigint, target_field_name string, transformation_type string, expression string"


def graph(spark, edges):
    ids = sorted({e[0] for e in edges} | {e[2] for e in edges})
    datasets = spark.createDataFrame([(i, f"d{i}") for i in ids], "id bigint, name string")
    return spark.createDataFrame(edges, EDGE), datasets


def test_chain_up_and_down(spark):
    edges, ds = graph(spark, [(1, "event_id", 2, "event_id", "direct", None), (2, "event_id", 3, "event_id", "direct", None)])
    up = ops.column_closure(edges, ds, 3, "event_id", downstream=False)
    assert rows(up, "dataset_name", "depth") == [("d1", 2), ("d2", 1)]
    down = ops.column_closure(edges, ds, 1, "event_id", downstream=True, max_depth=1)
    assert rows(down, "dataset_name", "depth") == [("d2", 1)]


def test_diamond_keeps_each_depth_once_and_cycles_end(spark):
    edges, ds = graph(
        spark,
        [(1, "a", 2, "a", "direct", None), (1, "a", 3, "a", "direct", None), (2, "a", 4, "a", "direct", None),
         (3, "a", 4, "a", "direct", None), (1, "a", 4, "a", "direct", None), (4, "a", 1, "a", None, None)],
    )
    got = ops.column_closure(edges, ds, 1, "a", True, 4)
    assert [r for r in rows(got, "dataset_id", "depth") if r[0] == 4] == [(4, 1), (4, 2), (4, 3), (4, 4)]
    reach = ops.first_reach(edges, spark.createDataFrame([("x", 1, "a")], "label string, dataset_id bigint, column_name string"), 50)
    assert rows(reach, "dataset_id", "depth") == [(2, 1), (3, 1), (4, 1)]


def test_depth_is_as_given_and_none_runs_to_the_end(spark):
    edges, ds = graph(spark, [(i, "a", i + 1, "a", "direct", None) for i in range(1, 71)] + [(71, "a", 1, "a", "direct", None)])
    assert ops.column_closure(edges, ds, 1, "a", True, 60).count() == 60
    assert ops.column_closure(edges, ds, 1, "a", True, 0).count() == 0


def test_labels_that_are_null_are_seen(spark):
    edges, _ = graph(spark, [(1, "a", 2, "a", "direct", None), (2, "a", 1, "a", "direct", None), (2, "a", 3, "a", "direct", None)])
    roots = spark.createDataFrame([(None, 1, "a")], "label string, dataset_id bigint, column_name string")
    assert rows(ops.first_reach(edges, roots), "dataset_id", "depth") == [(2, 1), (3, 2)]
    assert {r["dataset_id"] for r in ops.traverse(edges, roots, True).collect()} == {1, 2, 3}


@pytest.mark.parametrize("levels, hub", [(12, 1_000_000), (3, 1_000_000), (1, 2), (4, 2)])
def test_walks_in_any_rounds_and_with_hubs(spark, monkeypatch, levels, hub):
    """Random graphs with cycles and a column that owns a third of the edges, against a walk in plain Python."""
    monkeypatch.setattr(ops, "LEVELS", levels)
    monkeypatch.setattr(ops, "HUB_EDGES", hub)
    rnd = random.Random(levels + hub)
    pairs = {(1 if rnd.random() < 0.33 else rnd.randrange(1, 15), rnd.randrange(1, 15)) for _ in range(24)} | {(i, i + 1) for i in range(14, 20)}
    edges, _ = graph(spark, [(a, "c", z, "c", t, None) for a, z in sorted(pairs) for t in (["direct"] if a % 2 else ["direct", "window"])])
    roots = spark.createDataFrame([("x", 1, "c"), ("y", 3, "c"), (None, 3, "c"), ("z", 99, "c"), ("n", None, "c")], "label string, dataset_id bigint, column_name string")
    for limit in (7, None):
        want, first, seen = set(), {}, set()
        level = {("x", 1), ("y", 3), (None, 3), ("z", 99)}
        for depth in range(1, 8 if limit else 100):
            level = {(label, z) for label, at in level for a, z in pairs if a == at}
            want |= {(label, z, depth) for label, z in level}
            for state in level:
                first.setdefault(state, depth)
            fresh, seen = level - seen, seen | level
            if limit is None and not fresh:
                break
        got = ops.traverse(edges, roots, True, limit)
        assert {tuple(r) for r in got.select("label", "dataset_id", "depth").collect()} == want
        kinds = {(r["label"], r["dataset_id"], r["depth"], r["transformation_type"]) for r in got.collect()}
        assert len(kinds) == got.count()
        reach = {(r["label"], r["dataset_id"]): r["depth"] for r in ops.first_reach(edges, roots, limit).collect()}
        starts = {("x", 1), ("y", 3), (None, 3), ("z", 99)}
        assert reach == {k: d for k, d in first.items() if k not in starts and (limit is None or d <= limit)}


def test_anonymise_and_severity(spark):
    edges, ds = graph(
        spark,
        [(1, "age", 2, "avg_age", "Aggregate", "AVG(age)"), (1, "age", 3, "age", "Direct", None), (3, "age", 4, "h", None, "sha2(age)"),
         (3, "age", 5, "p", None, None)],
    )
    got = {r["dataset_id"]: r["may_anonymize"] for r in ops.pii_propagation(edges, ds, 1, "age").collect()}
    assert got == {2: True, 3: False, 4: True, 5: False}
    fields = spark.createDataFrame([(7, 1, "age")], "id bigint, dataset_id bigint, name string")
    impact = ops.impact(edges, ds, fields, 7)
    assert {r["dataset_id"]: r["severity"] for r in impact.collect()} == {2: "medium", 3: "high", 4: "low", 5: "low"}
    assert tuple(ops.impact_summary(impact).first()) == (4, 4, 3, 1, 2)
    empty = ops.impact_summary(ops.impact(edges, ds, fields, 99)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_record_and_delete(spark):
    edges, _ = graph(spark, [(1, "a", 2, "b", "Direct", None), (0, "a", 2, "b", "Direct", None), (1, "", 2, "b", None, None), (1, "x" * 257, 2, "b", None, None)])
    kept, refused = ops.record_edges(edges.limit(0), edges)
    assert rows(kept, "transformation_type") == [("direct",)]
    assert rows(refused, "reason") == [("column name too long",), ("dataset id not positive",), ("empty column name",)]
    assert ops.delete_edges(kept, spark.createDataFrame([(2,)], "dataset_id bigint")).count() == 0


def test_record_refuses_null_ids(spark):
    edges, _ = graph(spark, [(1, "a", 2, "b", None, None)])
    null_id = edges.selectExpr("CAST(NULL AS BIGINT) AS source_dataset_id", "source_field_name", "target_dataset_id", "target_field_name", "transformation_type", "expression")
    assert rows(ops.check_edges(null_id), "reason") == [("dataset id not positive",)]
