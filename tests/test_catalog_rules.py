"""Ingestion, contracts, alerts, quality and search on small hand-made cases."""

import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewarden.functions.exprs import json_string_list, ntz, redact_url
from tablewarden.functions.types import canonical_type
from tablewarden.operators import alerts, classify, contracts, ingest, quality, search
from tablewarden.sources.catalog_store import DatasetNotFound, load_catalog, save_catalog, scan_dataset

BATCH = """name string, path string, format string, description string, tenant string, domain string, owner string, emitted_at timestamp_ntz,
 row_count bigint, size_bytes bigint, partition_keys array<string>, fields array<struct<name:string,data_type:string,nullable:boolean>>,
 upstream array<string>, tags array<string>"""
DATASETS = """id bigint, name string, path string, format string, description string, tenant string, domain string, owner string,
 created_at timestamp_ntz, last_updated timestamp_ntz, row_count bigint, size_bytes bigint, partition_keys string"""
NOW = datetime.datetime(2024, 1, 1)


def test_emit_twice_and_store(spark, tmp_path):
    empty = ingest.Catalog(
        spark.createDataFrame([], DATASETS), spark.createDataFrame([], "dataset_id bigint, name string, data_type string, nullable boolean"),
        spark.createDataFrame([], "upstream_dataset_id bigint, downstream_dataset_id bigint"), spark.createDataFrame([], "dataset_id bigint, tag string"),
    )
    row = lambda name, up, field, day: (name, "/p", "parquet", None, None, "d", None, NOW + datetime.timedelta(days=day), 3, 9, ["day"], [(field, "bigint", False)], up, ["t", "t"])
    first = ingest.emit(empty, spark.createDataFrame([row("raw", ["nobody"], "a", 0), row("clean", ["raw"], "b", 0)], BATCH))
    save_catalog(first, str(tmp_path / "v1"))
    again = ingest.emit(load_catalog(spark, str(tmp_path / "v1")), spark.createDataFrame([row("clean", ["raw", "raw"], "c", 1)], BATCH))
    ids = {r["name"]: r for r in again.datasets.collect()}
    assert sorted(r["id"] for r in ids.values()) == [1, 2]
    assert ids["clean"]["created_at"] == NOW and ids["clean"]["last_updated"] == NOW + datetime.timedelta(days=1)
    assert rows(again.fields, "name") == [("a",), ("c",)]
    assert rows(again.lineage) == [(ids["raw"]["id"], ids["clean"]["id"])] and again.tags.count() == 2


def test_scan_dataset(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "x"))
    cat = spark.createDataFrame([("x", "d", str(tmp_path / "x"), "parquet"), ("y", "d", None, "parquet")], "name string, domain string, path string, format string")
    assert scan_dataset(cat, "d", "x", ["id"], "id > 3", 2).count() == 2
    with pytest.raises(DatasetNotFound):
        scan_dataset(cat, "other", "x")
    with pytest.raises(ValueError):
        scan_dataset(cat, "d", "y")


def test_name_rules(spark):
    cases = [
        ("dataset", "orders.v1-x", None), ("dataset", "-a", "hyphen at the edge"), ("dataset", "a b", "invalid characters"),
        ("dataset", "é" * 128, "too long"), ("field", "invalid-field", "invalid characters"), ("tag", "pii:email-1", None),
        ("tenant", "", "empty"), ("domain", "größe", None), ("path", "file:///a/../b", "path traversal"), ("path", "s3://a/../b", None),
        ("path", "file:///a\0", "path holds a null byte"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "kind string, value string")
    got = df.select("kind", "value", ingest.name_problem(F.col("kind"), F.col("value")).alias("r")).collect()
    assert [tuple(r) for r in got] == cases


def test_types_urls_json(spark):
    types = {
        "decimal(50,-3)": "Decimal128(38, -3)", "DECIMAL(4,9)": "Decimal128(4, 4)", "decimal(0, 0)": "Decimal128(1, 0)",
        "timestamp[us, tz=UTC]": "Timestamp(Microsecond, utc)", "timestamptz": "Timestamp(Microsecond, UTC)", "map<a,b>": "Utf8", "time": "Time64(Microsecond)",
    }
    df = spark.createDataFrame([(k,) for k in types], "t string").select(canonical_type(F.col("t"))["canonical"])
    assert [r[0] for r in df.collect()] == list(types.values())
    urls = {"https://h.example.com/webhook/s?token=a": "https://h.example.com/***", "https://h": "https://h/***", "nonsense": "***"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(redact_url(F.col("u"))).collect()
    assert [r[0] for r in got] == list(urls.values())
    keys = spark.createDataFrame([('["a","b"]',), ("x",), (None,)], "k string").select(json_string_list(F.col("k"))).collect()
    assert [r[0] for r in keys] == [["a", "b"], [], []]


def test_contract_patterns(spark):
    names = ["orders", "orders_raw", "my_orders", "my_orders_raw", "abc", "abxbc", "a*b"]
    want = {
        "orders": ["orders"], "orders*": ["orders", "orders_raw"], "*_raw": ["my_orders_raw", "orders_raw"],
        "*orders*": ["my_orders", "my_orders_raw", "orders", "orders_raw"], "*": sorted(names), "**": sorted(names),
        "ab*bc": ["abc", "abxbc"], "*a*b": ["a*b"], "a*b*c": [],
    }
    c = spark.createDataFrame([(i, p, True) for i, p in enumerate(want)], "id bigint, dataset_pattern string, enabled boolean")
    d = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    got = {p: [] for p in want}
    for r in contracts.match(c, d).collect():
        got[list(want)[r["contract_id"]]].append(r["dataset_name"])
    assert {p: sorted(v) for p, v in got.items()} == want


def test_urls_of_channels(spark):
    urls = ["https://h/x", "webhook:https://h", "webhook:", "ftp://h", "http://", "https://h\n", "https://" + "h" * 2050]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(contracts.url_problem(F.col("u"))).collect()]
    assert got[:2] == [None, None] and all(got[2:])


def test_freshness_contract_without_a_maximum_judges_nothing(spark):
    made = spark.createDataFrame(
        [(1, '{"max_staleness_secs":60}'), (2, '{"expected_interval_secs":60}'), (3, None)], "id bigint, freshness_contract string"
    ).selectExpr("*", "'c' AS name", "'*' AS dataset_pattern", "1 AS version", "CAST(NULL AS STRING) AS schema_contract", "CAST(NULL AS STRING) AS quality_contract", "CAST(NULL AS STRING) AS alert_channels")
    datasets = spark.createDataFrame([(7, NOW), (8, NOW - datetime.timedelta(hours=1)), (9, None)], "id bigint, last_updated timestamp_ntz")
    pairs = spark.createDataFrame([(c, d) for c in (1, 2, 3) for d in (7, 8, 9)], "contract_id bigint, dataset_id bigint")
    found = contracts.freshness_violations(pairs, made, datasets, ntz(NOW.strftime("%Y-%m-%d %H:%M:%S")))
    assert rows(found, "contract_id", "dataset_id") == [(1, 8), (1, 9)]
    problems = contracts.definition_problems(made)
    assert rows(problems.where("field = 'freshness_contract.max_staleness_secs'"), "contract_id", "message") == [(2, "missing")]


def test_scan_without_rules_or_texts_is_empty(spark):
    frames = {"numbers": spark.range(3), "texts": spark.createDataFrame([("a@b.org",)], "t string")}
    rules = classify.default_rules(spark)
    for some, of in ((frames, rules.where("false")), ({"numbers": frames["numbers"]}, rules), ({}, rules)):
        assert classify.scan_tables(some, of).count() == 0
    assert classify.scan_tables(frames, rules).count() > 0


def test_freshness_severity_and_cooldown(spark):
    s = spark.createDataFrame([(3700,), (7200,), (7300,), (14400,), (14500,)], "s bigint")
    got = [r[0] for r in s.select(alerts.freshness_severity(F.col("s"), F.lit(3600))).collect()]
    assert got == ["info", "warning", "warning", "critical", "critical"]
    at = lambda secs: NOW + datetime.timedelta(seconds=secs)
    asked = spark.createDataFrame(
        [(i, "quality", d, at(t), ch) for i, (d, t, ch) in enumerate([(1, 0, True), (1, 3599, True), (1, 3600, True), (1, 7000, True), (2, 100, True), (2, 5000, True), (3, 0, False)])],
        "id bigint, alert_type string, dataset_id bigint, created_at timestamp_ntz, has_channel boolean",
    )
    stored = spark.createDataFrame(
        [("quality", 2, at(-1000), None), ("quality", 1, at(-10), at(-5))], "alert_type string, dataset_id bigint, created_at timestamp_ntz, resolved_at timestamp_ntz"
    )
    assert rows(alerts.apply_cooldown(asked, stored), "id") == [(0,), (2,), (5,)]


def test_quality_edges(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert value(quality.completeness(lit(0), lit(0), lit(5))) == 1.0
    assert value(quality.completeness(lit(9), lit(2), lit(3))) == 0.0
    assert value(quality.freshness(lit(100), lit(60), lit(40))) == 1.0
    assert value(quality.freshness(lit(160), lit(60), lit(40))) == 0.5
    assert value(quality.freshness(lit(160), lit(None).cast("bigint"), lit(40))) is None
    mib = 1024 * 1024
    assert [value(quality.estimated_small_files(lit(s).cast("bigint"), lit(n))) for s, n in [(0, 0), (0, 3), (10 * 64 * mib, 10), (2 * 128 * mib, 2), (4 * mib, 4)]] == [0, 3, 2, 0, 4]
    assert value(quality.file_health(lit(2), lit(10))) == pytest.approx(0.9)
    scores = spark.createDataFrame([(0.5, None, 1.0), (None, None, None)], "completeness_score double, freshness_score double, file_health_score double")
    assert [r[0] for r in scores.select(quality.overall()).collect()] == [pytest.approx(0.4 / 0.6), None]
    assert value(quality.clamp_unit(lit(float("nan")))) == 0.0 and ntz("2024-01-01") is not None


def test_classification_rules(spark):
    fields = spark.createDataFrame([(i, 1, n) for i, n in enumerate(["Email", "zip", "description", "ssn_phone", "total"])], "id bigint, dataset_id bigint, name string")
    got = {r["column_name"]: r["category"] for r in classify.classify_by_name(fields, classify.default_rules(spark)).collect()}
    assert got == {"Email": "email", "zip": "ip_address", "description": "ip_address", "ssn_phone": "ssn", "total": None}
    kept = classify.upsert_classifications(
        spark.createDataFrame([(1, "public", None, 1.0, "manual", True), (2, "pii", "email", 0.9, "rule", False)], "field_id bigint, classification string, category string, confidence double, source string, verified boolean"),
        spark.createDataFrame([(i, "unknown", None, 0.5, "auto") for i in (1, 2, 3)], "field_id bigint, classification string, category string, confidence double, source string"),
    )
    assert rows(kept, "field_id", "classification", "verified") == [(1, "public", True), (2, "unknown", False), (3, "unknown", False)]


def test_search(spark):
    ds = spark.createDataFrame(
        [(1, "transactions_daily", "/data/transactions.parquet", "finance", None, "Daily transaction data from payment system"),
         (2, "users_profile", "/data/users.parquet", "analytics", None, "User profile information")],
        "id bigint, name string, path string, domain string, owner string, description string",
    )
    fields = spark.createDataFrame([(1, "amount_total"), (2, "user_email")], "dataset_id bigint, name string")
    index = search.catalog_index(ds, fields, spark.createDataFrame([(1, "pii:card")], "dataset_id bigint, tag string"))
    find = lambda *b: sorted(r[0] for r in search.boolean_search(index, search.any_of(*b)).collect())
    assert find(search.word("transactions")) == [1] and find(search.word("user")) == [2] and find(search.word("finance")) == [1]
    assert find(search.prefix("trans")) == [1] and find(search.phrase("payment system")) == [1] and find(search.phrase("system payment")) == []
    assert find(search.all_of(search.word("data"), search.word("users"))) == [2]
    assert find(search.word("payment"), search.phrase("user_email")) == [1, 2] and find(search.prefix("profile inf")) == [2]
    with pytest.raises(ValueError):
        search.word("--")
    assert find(search.word("x" * 5000)) == []


def test_column_statistics_are_exact(spark):
    from tablewarden.operators import quality

    stats = [
        '{"numRecords": 2, "nullCount": {"n": 1}, "minValues": {"n": 9007199254740993, "d": 9.5, "x": 9.5, "s": "10"}, "maxValues": {"n": 9007199254740993, "d": 9.5, "x": 9.5, "s": "10"}}',
        '{"numRecords": 1, "minValues": {"n": 10, "d": 10.25, "x": 10.25, "s": "9"}, "maxValues": {"n": 9007199254740992, "d": 10.25, "x": 10.25, "s": "9"}}',
    ]
    files = spark.createDataFrame([(1, f"f{i}", 1, s) for i, s in enumerate(stats)], "dataset_id bigint, path string, size bigint, stats string")
    kinds = {"n": "long", "d": "decimal(10,2)", "x": "double", "s": "string", "gone": "date"}
    schemas = spark.createDataFrame([(1, c, k) for c, k in kinds.items()], "dataset_id bigint, column_name string, data_type string")
    got = {r["column_name"]: (r["null_count"], r["min_value"], r["max_value"]) for r in quality.column_stats(files, schemas).collect()}
    assert got == {"n": (1, "10", "9007199254740993"), "d": (0, "9.50", "10.25"), "x": (0, "9.5", "10.25"), "s": (0, "10", "9"), "gone": (None, None, None)}


def test_days_with_many_users_are_counted_whole(spark):
    from pyspark.sql import functions as F

    from tablewarden.operators import usage

    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts")
    events = spark.range(10500).select(F.lit(1).cast("bigint").alias("dataset_id"), F.concat(F.lit("u"), "id").alias("user_name"), F.lit("read").alias("access_type"), day)
    assert usage.daily(events).first()["unique_users"] == 10500
    with pytest.raises(ValueError):
        usage.period_days("2w")


def test_requests_of_unknown_tenants_get_a_decision(spark):
    from pyspark.sql import functions as F

    from tablewarden.operators import tenancy

    asked = spark.createDataFrame([(1, "t", 1), (2, "t", 2), (3, "nobody", 1), (4, None, 1)], "id bigint, tenant_id string, requested_at int")
    tenants = spark.createDataFrame([("t", 1)], "tenant_id string, quota_max_datasets bigint")
    none = spark.createDataFrame([], "id bigint, tenant string")
    got = tenancy.admission(asked, tenants, none, F.col("requested_at"), dry_run=False)
    assert {r["id"]: r["decision"] for r in got.collect()} == {1: "admitted", 2: "blocked", 3: "unknown_tenant", 4: "unknown_tenant"}


def test_contracts_of_equal_terms_are_judged_once(spark):
    """Many contracts of two texts: the check sees each dataset once a text, and every pair gets the violations of its own."""
    pairs = spark.createDataFrame([(c, d, f"n{d}") for c in range(40) for d in range(3)], "contract_id int, dataset_id int, dataset_name string")
    table = spark.createDataFrame(
        [(c, f"c{c}", "block", None if c % 4 == 3 else f'{{"max_staleness_secs": {c % 2}}}') for c in range(40)],
        "id int, name string, on_violation string, freshness_contract string",
    )
    seen = []

    def check(some, terms):
        seen.append((some.count(), terms.count()))
        late = some.join(terms.withColumnRenamed("id", "contract_id"), "contract_id").where("freshness_contract LIKE '%1}' AND dataset_id > 0")
        return late.select("contract_id", "dataset_id", F.lit("stale").alias("kind"), F.lit("last_updated").alias("subject"))

    got = contracts.verdicts(pairs, table, {"freshness_contract": check})
    assert seen == [(6, 2)]
    late = lambda c, d: c % 4 == 1 and d > 0
    want = [(c, d, not late(c, d), int(late(c, d)), "stale:1" if late(c, d) else "", "block" if late(c, d) else "none") for c in range(40) for d in range(3)]
    assert rows(got, "contract_id", "dataset_id", "passed", "violations", "kinds", "action") == sorted(want, key=repr)
