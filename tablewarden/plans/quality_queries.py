"""Quality queries over file statistics derived from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.exprs import ntz
from tablewarden.operators import quality as ops
from tablewarden.plans.registry import query
from tablewarden.plans.views import AS_OF, Views
from tablewarden.session import settle


# Columns of the described tables: name in the file statistics, name in ``data_files``, declared type.
_COLUMNS = [("l_quantity", "quantity", "double"), ("l_returnflag", "flag", "string"), ("l_orderkey", "key", "long"),
            ("l_extendedprice", "price", "decimal(18,3)"), ("l_shipdate", "date", "date")]
_NULLS = ("quantity", "flag")
#: Line items of one dataset that one task can take.
TASK_ROWS = 1_000_000


def file_rows(v):
    """(dataset_id, path, size, stats): file entries with their statistics as JSON text."""
    ends = lambda end: F.struct(*[F.col(f"{end}_{c}").alias(name) for name, c, _ in _COLUMNS])
    nulls = F.struct(*[(F.col(f"null_{c}") if c in _NULLS else F.lit(0)).alias(name) for name, c, _ in _COLUMNS])
    stats = F.to_json(F.struct(F.col("num_records").alias("numRecords"), nulls.alias("nullCount"), ends("min").alias("minValues"), ends("max").alias("maxValues")))
    text = F.when(F.col("stats_kind") == "ok", stats).when(F.col("stats_kind") == "malformed", '{"numRecords": oops')
    return v.data_files.select("dataset_id", F.concat(F.lit("part-"), F.col("file_no")).alias("path"), "size", text.alias("stats"))


def by_dataset(v):
    """The views with line items dealt out by dataset, so that files and their statistics are summed where they are.

    Dealt by file instead, the five columns of each file travel with all their extremes. A dataset whose line items are
    too many for one task keeps that way, as its files are then summed in many tasks first.
    """
    most = v.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > TASK_ROWS:
        return v
    dealt = Views(v.spark, v.folder)
    dealt._made["lineitem"] = v.lineitem.repartition(int(v.spark.conf.get("spark.sql.shuffle.partitions")), "l_partkey")
    return dealt


def columns_of(v):
    """(dataset_id, column_name, data_type) of the described tables."""
    cols = F.array(*[F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("data_type")) for name, _, kind in _COLUMNS])
    return v.datasets.select(F.col("id").alias("dataset_id"), F.inline(cols))


_STATS = """SELECT dataset_id, CAST(coalesce(sum(CASE WHEN stats_kind = 'ok' THEN num_records END), 0) AS BIGINT) AS row_count,
    CAST(sum(size) AS BIGINT) AS size_bytes, count(*) AS num_files,
    count(*) FILTER (stats_kind = 'malformed') AS malformed_stats, count(*) FILTER (size < 134217728) AS small_files,
    CAST(coalesce(sum(CASE WHEN stats_kind = 'ok' THEN null_quantity + null_flag END), 0) AS BIGINT) AS nulls
    FROM {data_files} GROUP BY dataset_id"""


@query("table_stats", f"SELECT * EXCLUDE (nulls) FROM ({_STATS})")
def table_stats(v):
    return ops.table_stats(file_rows(v))


_COLUMN = """SELECT id AS dataset_id, '{name}' AS column_name, '{kind}' AS data_type, s.n AS null_count, s.lo AS min_value,
      s.hi AS max_value, CAST(NULL AS BIGINT) AS distinct_count
    FROM {{datasets}} LEFT JOIN (SELECT dataset_id, CAST(sum({n}) AS BIGINT) AS n, CAST(min(min_{c}) AS VARCHAR) AS lo,
      CAST(max(max_{c}) AS VARCHAR) AS hi FROM {{data_files}} WHERE stats_kind = 'ok' GROUP BY dataset_id) s ON s.dataset_id = id"""


@query(
    "column_stats",
    " UNION ALL ".join(_COLUMN.format(name=name, kind=kind, c=c, n=f"null_{c}" if c in _NULLS else "0") for name, c, kind in _COLUMNS),
)
def column_stats(v):
    return ops.column_stats(file_rows(by_dataset(v)), columns_of(v))


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM {{access_events}}"
        for c in ("event_id", "dataset_id", "user_name", "access_type")
    ) + " UNION ALL SELECT 'ts', count(*), count(*) - count(ts), CAST(min(ts) AS VARCHAR), CAST(max(ts) AS VARCHAR) FROM {access_events}",
)
def column_profile(v):
    return ops.profile(v.access_events)


def scored(v):
    files = settle(ops.parse_file_stats(file_rows(v)).select("dataset_id", "size", "parsed", "malformed"), "file-stats")
    stats = ops.table_stats(files)
    nulls = ops.column_stats(files, columns_of(v)).groupBy("dataset_id").agg(
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("null_count"), F.count(F.lit(1)).alias("column_count")
    )
    updated = v.datasets.select(F.col("id").alias("dataset_id"), "last_updated")
    return ops.scores(stats, nulls, updated, v.freshness_config, ntz(AS_OF))


_STALE = f"CAST(epoch($TS '{AS_OF}' - d.last_updated) AS BIGINT)"
_SCORES = f"""SELECT d.id AS dataset_id,
    CASE WHEN coalesce(s.row_count, 0) = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - nulls / (s.row_count * 5.0))) END AS completeness_score,
    CASE WHEN {_STALE} <= expected_interval_secs + grace_period_secs THEN 1.0
      ELSE 1.0 / (1.0 + ({_STALE} - expected_interval_secs - grace_period_secs) / expected_interval_secs) END AS freshness_score,
    CASE WHEN num_files IS NULL THEN 1.0 ELSE 1.0 - 0.5 * CASE WHEN s.size_bytes // num_files < 134217728
      THEN least(CAST(floor(134217728.0 / (s.size_bytes // num_files)) AS BIGINT), num_files) ELSE 0 END / num_files END
      AS file_health_score, small_files, num_files
    FROM {{datasets}} d LEFT JOIN ({_STATS}) s ON d.id = s.dataset_id
    LEFT JOIN {{freshness_config}} f ON f.dataset_id = d.id"""
_ROUND = "CAST(round({0}, 6) AS DOUBLE) AS {0}"


def _rounded(df, *names):
    return df.select("dataset_id", *[F.round(n, 6).alias(n) for n in names])


@query("quality_completeness", f"SELECT dataset_id, {_ROUND.format('completeness_score')} FROM ({_SCORES})")
def quality_completeness(v):
    return _rounded(scored(v), "completeness_score")


@query(
    "quality_freshness",
    f"""SELECT d.id AS dataset_id, CAST(round(CASE WHEN {_STALE} <= expected_interval_secs + grace_period_secs THEN 1.0
      ELSE 1.0 / (1.0 + ({_STALE} - expected_interval_secs - grace_period_secs) / expected_interval_secs) END, 6) AS DOUBLE)
      AS freshness_score FROM {{datasets}} d LEFT JOIN {{freshness_config}} f ON f.dataset_id = d.id""",
)
def quality_freshness(v):
    updated = v.datasets.select(F.col("id").alias("dataset_id"), "last_updated").join(v.freshness_config, "dataset_id", "left")
    from tablewarden.functions.exprs import seconds_between

    stale = seconds_between(ntz(AS_OF), F.col("last_updated"))
    score = ops.freshness(stale, F.col("expected_interval_secs"), F.col("grace_period_secs"))
    return updated.select("dataset_id", F.round(score, 6).alias("freshness_score"))


@query("quality_file_health", f"SELECT dataset_id, {_ROUND.format('file_health_score')} FROM ({_SCORES})")
def quality_file_health(v):
    return _rounded(scored(v), "file_health_score")


@query(
    "small_files_exact",
    f"""SELECT dataset_id, small_files, num_files, CAST(round(1.0 - 0.5 * small_files / num_files, 6) AS DOUBLE) AS file_health_exact
    FROM ({_STATS})""",
)
def small_files_exact(v):
    exact = F.round(ops.file_health(F.col("small_files"), F.col("num_files")), 6)
    return ops.table_stats(file_rows(v)).select("dataset_id", "small_files", "num_files", exact.alias("file_health_exact"))


@query(
    "quality_overall",
    f"""SELECT dataset_id, {_ROUND.format('completeness_score')}, {_ROUND.format('freshness_score')},
    {_ROUND.format('file_health_score')}, CAST(round((0.4 * completeness_score + coalesce(0.4 * freshness_score, 0)
      + 0.2 * file_health_score) / CASE WHEN freshness_score IS NULL THEN 0.6 ELSE 1.0 END, 6) AS DOUBLE) AS overall_score
    FROM ({_SCORES})""",
)
def quality_overall(v):
    return _rounded(scored(v), "completeness_score", "freshness_score", "file_health_score", "overall_score")


_LATEST = """SELECT * FROM {quality_metrics} QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY computed_at DESC, id DESC) = 1"""


@query("quality_latest", _LATEST)
def quality_latest(v):
    return ops.latest(v.quality_metrics)


@query(
    "quality_unhealthy",
    f"""SELECT q.dataset_id, d.name AS dataset_name, overall_score, completeness_score, freshness_score, file_health_score, computed_at
    FROM ({_LATEST}) q JOIN {{datasets}} d ON d.id = q.dataset_id WHERE overall_score < 0.5""",
)
def quality_unhealthy(v):
    return ops.unhealthy(v.quality_metrics, v.datasets, 0.5)


@query(
    "quality_history",
    """SELECT *, lag(overall_score) OVER (PARTITION BY dataset_id ORDER BY computed_at, id) AS previous_overall
    FROM {quality_metrics}""",
)
def quality_history(v):
    return ops.history(v.quality_metrics)
