"""Events between two snapshots of several kinds of entities."""

import json

import pytest

from tablewarden.operators import audit

SCHEMA = "id long, part string, note string, size long"


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_events_are_those_of_changed_rows(spark, buckets):
    """Nulls that change place are changes, as are new and missing rows; rows without a key are left out."""
    before = [(i, "a", f"n{i}", i) for i in range(200)] + [(500, "a", None, 1), (501, "b", "x", None), (None, "a", "no key", 1)]
    after = [(i, "a", f"n{i}" if i != 17 else "new", i) for i in range(200) if i != 40] + [(500, "a", "y", None), (501, "b", "x", None), (502, "b", None, None)]
    old, new = spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA).repartition(3)
    got = {r["entity_id"]: r for r in audit.changed_events(old, new, ["id", "part"], "thing", buckets).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"17/a": "update", "40/a": "delete", "500/a": "update", "502/b": "create"}
    assert json.loads(got["500/a"]["old_values"]) == {"id": 500, "part": "a", "note": None, "size": 1}
    assert json.loads(got["502/b"]["new_values"])["note"] is None and got["502/b"]["old_values"] is None
    assert audit.changed_events(old, old, ["id", "part"], "thing", buckets).count() == 0


def test_values_that_move_between_columns_are_seen(spark):
    left, right = (spark.createDataFrame([(1, *v)], "id long, a string, b string") for v in ((None, "v"), ("v", None)))
    assert audit.changed_events(left, right, ["id"], "thing").count() == 1


def test_events_of_empty_snapshots(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a", None, None)], SCHEMA)
    kinds = audit.catalog_events({"x": none, "y": some}, {"x": some, "y": none}, {"x": ["id"], "y": ["id"]})
    assert sorted((r["entity_type"], r["action"]) for r in kinds.collect()) == [("x", "create"), ("y", "delete")]
