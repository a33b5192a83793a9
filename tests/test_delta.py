"""Delta logs on disk."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewarden.sources import delta_log as log


def schema(*cols):
    return json.dumps({"type": "struct", "fields": [{"name": n, "type": t, "nullable": b, "metadata": {}} for n, t, b in cols]})


def write(folder, version, *actions):
    (folder / "_delta_log").mkdir(parents=True, exist_ok=True)
    (folder / "_delta_log" / f"{version:020d}.json").write_text("\n".join(json.dumps(a) for a in actions))


@pytest.fixture
def tables(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    info = lambda op, ts: {"commitInfo": {"timestamp": ts, "operation": op, "userName": "u", "operationParameters": {"mode": "Append"}}}
    meta = lambda *c: {"metaData": {"id": "x", "schemaString": schema(*c), "partitionColumns": ["day"]}}
    add = lambda p, size, stats: {"add": {"path": p, "size": size, "modificationTime": 1, "dataChange": True, "stats": stats}}
    write(a, 0, info("CREATE", 10), {"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, meta(("id", "integer", False), ("day", "date", True)))
    write(a, 1, info("WRITE", 20), add("f1", 100, '{"numRecords": 5}'), add("f2", 50, "oops"), add("f3", 1, None))
    write(a, 2, info("MERGE", 30), {"remove": {"path": "f1", "dataChange": True}}, add("f4", 7, '{"numRecords": 2}'),
          meta(("id", "long", False), ("note", "string", True)))
    write(b, 0, info("CREATE", 5), meta(("id", "integer", True)))
    return log.read_actions(spark, [str(a), str(b)]).withColumn("location", F.regexp_extract("location", "[^/]+$", 0))


def test_snapshot_follows_versions(tables):
    pick = ("location", "version", "row_count", "size_bytes", "num_files", "malformed_stats", "num_columns")
    assert rows(log.snapshot(tables), *pick) == [("a", 2, 2, 58, 3, 1, 2), ("b", 0, 0, 0, 0, 0, 1)]
    assert rows(log.snapshot(tables, 1), *pick)[0] == ("a", 1, 5, 151, 3, 1, 2)
    assert rows(log.live_files(tables), "path") == [("f2",), ("f3",), ("f4",)]


def test_checkpoints_stand_for_lost_commits(spark, tmp_path):
    """Two checkpoints, commits before the second gone, a checkpoint in parts, deletion vectors."""
    a = tmp_path / "a"
    add = lambda p, size, dv=None: {"add": {"path": p, "size": size, "modificationTime": 1, "dataChange": True, "stats": '{"numRecords": 1}', **({"deletionVector": dv} if dv else {})}}
    gone = lambda p, dv=None: {"remove": {"path": p, "dataChange": True, **({"deletionVector": dv} if dv else {})}}
    meta = {"metaData": {"id": "x", "schemaString": schema(("id", "integer", False)), "partitionColumns": []}}
    dv = {"storageType": "u", "pathOrInlineDv": "abc", "offset": 1}

    def checkpoint(version, part, *actions):
        log_dir = a / "_delta_log"
        log_dir.mkdir(parents=True, exist_ok=True)
        text = spark.createDataFrame([(json.dumps(x),) for x in actions], "value string")
        made = text.select(F.from_json("value", log.ACTION_SCHEMA).alias("a")).select("a.*").toPandas()
        name = f"{version:020d}.checkpoint{part}.parquet"
        out = tmp_path / f"made-{version}{part}"
        spark.createDataFrame(made, text.select(F.from_json("value", log.ACTION_SCHEMA).alias("a")).select("a.*").schema).coalesce(1).write.parquet(str(out))
        next(out.glob("part-*.parquet")).rename(log_dir / name)

    checkpoint(2, "", meta, add("old", 1), add("f1", 10))
    checkpoint(4, ".0000000001.0000000002", meta, add("f1", 10))
    checkpoint(4, ".0000000002.0000000002", add("f2", 20))
    write(a, 5, add("f3", 30), gone("f1"), add("f1", 10, dv))
    write(a, 6, gone("f2"), add("f2", 21))
    actions = log.read_actions(spark, [str(a)])
    assert rows(log.live_files(actions), "path", "size") == [("f1", 10), ("f2", 21), ("f3", 30)]
    assert rows(log.live_files(actions, 4), "path") == [("f1",), ("f2",)] and rows(log.live_files(actions, 2), "path") == [("f1",), ("old",)]
    assert rows(log.snapshot(actions), "version", "row_count", "num_files", "num_columns") == [(6, 3, 3, 1)]
    assert rows(log.extract_schema(log.table_metadata(actions), ["location"]), "column_name", "data_type") == [("id", "integer")]
    assert log.schema_changes(actions).count() == 0


def test_order_of_remove_and_add_in_a_commit(spark, tmp_path):
    for name, order in (("a", 1), ("b", -1)):
        both = [{"remove": {"path": "f", "dataChange": True}}, {"add": {"path": "f", "size": 2, "modificationTime": 1, "dataChange": True}}]
        write(tmp_path / name, 0, {"add": {"path": "f", "size": 1, "modificationTime": 1, "dataChange": True}})
        write(tmp_path / name, 1, *both[::order])
    actions = log.read_actions(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert rows(log.live_files(actions), "path", "size") == [("f", 2), ("f", 2)]


def test_history(tables):
    assert rows(log.commit_history(tables, 2), "location", "version", "operation") == [("a", 1, "WRITE"), ("a", 2, "MERGE"), ("b", 0, "CREATE")]


def test_schema_changes(tables):
    want = [("added", "note"), ("modified", "id"), ("removed", "day")]
    assert rows(log.schema_diff(tables, 0, 2), "change_kind", "column_name") == want
    assert rows(log.schema_changes(tables), "change_kind", "column_name") == want
    with pytest.raises(ValueError):
        log.schema_diff(tables, 2, 2)
    assert rows(log.schema_diff(tables, 0, 1000), "change_kind", "column_name") == want
    parts = log.extract_schema(log.table_metadata(tables, 1), ["location"])
    assert rows(parts.where("location = 'a'"), "position", "column_name", "is_partition") == [(0, "id", False), (1, "day", True)]


def _kinds(spark, folder, version=None):
    from tablewarden.sources import delta_files

    chosen = delta_files.choose(delta_files.list_files(spark, [str(folder)]), version)
    return sorted((r["kind"], r["version"], r["until"]) for r in chosen.collect()), delta_files.gaps(chosen).count()


def test_files_are_chosen_by_name(spark, tmp_path):
    """Ranges that overlap, an incomplete checkpoint, one in parts, names that mean nothing; nothing is opened."""
    a = tmp_path / "a"
    log_dir = a / "_delta_log"
    log_dir.mkdir(parents=True)
    for n in range(13):
        (log_dir / f"{n:020d}.json").write_text("not json")
    for x, y in ((1, 2), (4, 6), (5, 9), (7, 8), (7, 9), (11, 12)):
        (log_dir / f"{x:020d}.{y:020d}.compacted.json").write_text("-")
    for name in ("_last_checkpoint.json", "x.json", f"{3:020d}.crc", f"{10:020d}.checkpoint.0000000001.0000000002.parquet", "00000000000000000099.tmp.json"):
        (log_dir / name).write_text("-")
    for part in (1, 2):
        (log_dir / f"{3:020d}.checkpoint.{part:010d}.0000000002.parquet").write_text("-")
    now = [("checkpoint", 3, 3)] * 2 + [("commit", 10, 10), ("compacted", 4, 6), ("compacted", 7, 9), ("compacted", 11, 12)]
    assert _kinds(spark, a) == (now, 0)
    assert _kinds(spark, a, 8) == ([("checkpoint", 3, 3)] * 2 + [("compacted", 4, 6), ("compacted", 7, 8)], 0)
    assert _kinds(spark, a, 2) == ([("commit", 0, 0), ("compacted", 1, 2)], 0)
    (log_dir / f"{10:020d}.json").unlink()
    assert _kinds(spark, a)[1] == 1 and _kinds(spark, a, 9)[1] == 0


def test_incomplete_logs_are_an_error(spark, tmp_path):
    from tablewarden.sources import delta_files

    write(tmp_path / "a", 1, {"add": {"path": "f", "size": 1}})
    with pytest.raises(ValueError, match="incomplete"):
        delta_files.read_state(spark, [str(tmp_path / "a")])
    write(tmp_path / "a", 0, {"metaData": {"id": "x", "schemaString": schema(("id", "long", True)), "partitionColumns": []}})
    assert rows(log.live_files(delta_files.read_state(spark, [str(tmp_path / "a")])), "path") == [("f",)]


def test_all_commits_beside_compacted_files_and_sidecars(spark, tmp_path):
    """``read_actions`` takes single commits and whole checkpoints, named ones with their sidecars, and no compacted file."""
    a = tmp_path / "a"
    add = lambda p: {"add": {"path": p, "size": 1, "modificationTime": 1, "dataChange": True}}
    write(a, 3, add("c"))
    log_dir = a / "_delta_log"
    (log_dir / f"{1:020d}.{2:020d}.compacted.json").write_text(json.dumps(add("compacted")))
    (log_dir / f"{2:020d}.checkpoint.0f2e4c1a-0000-4000-8000-000000000001.json").write_text("\n".join(json.dumps({"sidecar": {"path": p}}) for p in ("s1.parquet", "s2.parquet")))
    (log_dir / "_sidecars").mkdir()
    for n, p in (("s1.parquet", "a"), ("s2.parquet", "b")):
        made = spark.createDataFrame([(json.dumps(add(p)),)], "value string").select(F.from_json("value", log.ACTION_SCHEMA).alias("a")).select("a.*")
        made.coalesce(1).write.parquet(str(tmp_path / f"made-{n}"))
        next((tmp_path / f"made-{n}").glob("part-*.parquet")).rename(log_dir / "_sidecars" / n)
    assert rows(log.live_files(log.read_actions(spark, [str(a)])), "path") == [("a",), ("b",), ("c",)]
