"""Profiles and quality scores, for all tables of the catalog at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.exprs import clamp_unit, seconds_between
from tablewarden.functions.fixed_values import QUALITY_WEIGHTS, SMALL_FILE_BYTES
from tablewarden.operators.skew import bucketed_lag, latest_per_key

FILE_STATS_SCHEMA = (
    "numRecords bigint, nullCount map<string,string>, minValues map<string,string>, maxValues map<string,string>, "
    "_broken string"
)


_NUMBERS = {"whole": "decimal(38,0)", "exact": "decimal(38,18)", "double": "double"}


def parse_file_stats(files: DataFrame) -> DataFrame:
    """File rows (dataset_id, path, size, stats JSON) with ``parsed``; unreadable stats are flagged, absent ones are not.

    Rows that are parsed already stay as they are.
    """
    if "parsed" in files.columns:
        return files
    parsed = F.from_json(
        "stats", FILE_STATS_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    )
    files = files.withColumn("parsed", parsed)
    unreadable = F.col("stats").isNotNull() & (F.col("parsed._broken").isNotNull() | F.col("parsed.numRecords").isNull())
    return files.withColumn("malformed", unreadable).withColumn("parsed", F.when(~unreadable, F.col("parsed")))


def table_stats(files: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Rows, bytes and files per table; files with unreadable stats count bytes but no rows."""
    return parse_file_stats(files).groupBy(key).agg(
        F.coalesce(F.sum("parsed.numRecords"), F.lit(0)).alias("row_count"),
        F.sum("size").alias("size_bytes"),
        F.count(F.lit(1)).alias("num_files"),
        F.count_if("malformed").alias("malformed_stats"),
        F.count_if(F.col("size") < SMALL_FILE_BYTES).alias("small_files"),
    )


def column_stats(files: DataFrame, schemas: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Null count and true minimum and maximum per column, from file statistics alone.

    ``schemas`` has (key, column_name, data_type); whole numbers and decimals are compared exactly, floating ones as doubles,
    and shown as the files have them. The statistics are summed per column before they meet the schema, so wide or hot tables shuffle little.
    """
    parsed = parse_file_stats(files).where("parsed IS NOT NULL")
    names = F.array_distinct(
        F.concat(
            *[F.coalesce(F.map_keys(f"parsed.{m}"), F.array().cast("array<string>")) for m in ("nullCount", "minValues", "maxValues")]
        )
    )
    per_file = parsed.select(key, "parsed", F.explode(names).alias("column_name")).select(
        key,
        "column_name",
        F.try_element_at("parsed.nullCount", F.col("column_name")).try_cast("bigint").alias("nulls"),
        F.try_element_at("parsed.minValues", F.col("column_name")).alias("lo"),
        F.try_element_at("parsed.maxValues", F.col("column_name")).alias("hi"),
    )
    summed = per_file.groupBy(key, "column_name").agg(
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_count"),
        F.min("lo").alias("lo_text"),
        F.max("hi").alias("hi_text"),
        *[F.min_by("lo", F.col("lo").try_cast(kind)).alias(f"lo_{name}") for name, kind in _NUMBERS.items()],
        *[F.max_by("hi", F.col("hi").try_cast(kind)).alias(f"hi_{name}") for name, kind in _NUMBERS.items()],
    )
    joined = schemas.select(key, "column_name", "data_type").join(summed, [key, "column_name"], "left")
    kind = F.lower("data_type")
    shown = lambda end: (
        F.when(kind.rlike(r"^(byte|short|int|integer|long|bigint|smallint|tinyint)\b"), F.col(f"{end}_whole"))
        .when(kind.rlike(r"^(decimal|numeric)\b"), _with_scale(F.col(f"{end}_exact"), kind))
        .when(kind.rlike(r"^(float|double|real)\b"), F.col(f"{end}_double"))
        .otherwise(F.col(f"{end}_text"))
    )
    return joined.select(
        key,
        "column_name",
        "data_type",
        "null_count",
        shown("lo").alias("min_value"),
        shown("hi").alias("max_value"),
        F.lit(None).cast("bigint").alias("distinct_count"),
    )


def _with_scale(text: Column, kind: Column) -> Column:
    """A decimal's text with the digits after the point that its declared type has."""
    scale = F.coalesce(F.regexp_extract(kind, r",\s*(\d+)", 1).try_cast("int"), F.lit(0))
    whole, part = F.substring_index(text, ".", 1), F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise("")
    return F.when(scale > 0, F.concat(whole, F.lit("."), F.rpad(part, F.greatest(scale, F.length(part)), F.lit("0")))).otherwise(text)


def profile(df: DataFrame) -> DataFrame:
    """One pass over data: (column_name, row_count, null_count, min_value, max_value) per column."""
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, c in enumerate(df.columns):
        aggs += [F.count(c).alias(f"_n{i}"), F.min(c).cast("string").alias(f"_lo{i}"), F.max(c).cast("string").alias(f"_hi{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("_rows").alias("row_count"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("null_count"),
                F.col(f"_lo{i}").alias("min_value"),
                F.col(f"_hi{i}").alias("max_value"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def completeness(nulls: Column, rows: Column, columns: Column) -> Column:
    cells = rows * columns
    return F.when(cells == 0, F.lit(1.0)).otherwise(clamp_unit(1.0 - nulls / cells))


def freshness(staleness: Column, interval: Column, grace: Column) -> Column:
    late = staleness - (interval + grace)
    return F.when(late <= 0, F.lit(1.0)).when(interval == 0, F.lit(0.0)).otherwise(clamp_unit(1.0 / (1.0 + late / interval)))


def estimated_small_files(size: Column, files: Column) -> Column:
    """Number of small files guessed from the average size alone."""
    avg = F.when(files > 0, F.floor(size / files)).cast("bigint")
    guess = F.least(F.floor(F.lit(float(SMALL_FILE_BYTES)) / avg).cast("bigint"), files)
    return F.when(files == 0, F.lit(0)).when(avg >= SMALL_FILE_BYTES, F.lit(0)).when(avg == 0, files).otherwise(guess)


def file_health(small: Column, files: Column) -> Column:
    return F.when(files == 0, F.lit(1.0)).otherwise(clamp_unit(1.0 - 0.5 * small / files))


def overall() -> Column:
    """Weighted mean of the scores present; NULL when there is none."""
    top = reduce(lambda a, b: a + b, [F.coalesce(F.col(s) * w, F.lit(0.0)) for s, w in QUALITY_WEIGHTS.items()])
    bottom = reduce(lambda a, b: a + b, [F.when(F.col(s).isNotNull(), w).otherwise(0.0) for s, w in QUALITY_WEIGHTS.items()])
    return F.when(bottom > 0, clamp_unit(top / bottom))


def scores(stats: DataFrame, nulls: DataFrame, updated: DataFrame, config: DataFrame, as_of: Column) -> DataFrame:
    """All four scores for every table of ``updated`` (dataset_id, last_updated), those without files or rows too.

    stats: ``table_stats``; nulls: (dataset_id, null_count, column_count).
    """
    base = updated.join(stats, "dataset_id", "left").join(nulls, "dataset_id", "left").join(config, "dataset_id", "left")
    base = base.fillna(0, ["row_count", "num_files", "size_bytes"])
    columns = F.coalesce(F.col("column_count"), F.lit(0))
    stale = seconds_between(as_of, F.col("last_updated"))
    small = estimated_small_files(F.col("size_bytes"), F.col("num_files"))
    return base.select(
        "dataset_id",
        completeness(F.coalesce(F.col("null_count"), F.lit(0)), F.col("row_count"), columns).alias("completeness_score"),
        freshness(stale, F.col("expected_interval_secs"), F.col("grace_period_secs")).alias("freshness_score"),
        file_health(small, F.col("num_files")).alias("file_health_score"),
        "row_count",
        F.col("num_files").alias("file_count"),
        "size_bytes",
        small.alias("small_file_count"),
        stale.alias("staleness_secs"),
    ).withColumn("overall_score", overall())


def latest(metrics: DataFrame) -> DataFrame:
    return latest_per_key(metrics, ["dataset_id"], ["computed_at", "id"])


def unhealthy(metrics: DataFrame, datasets: DataFrame, threshold: float) -> DataFrame:
    low = latest(metrics).where(F.col("overall_score") < threshold)
    named = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return (
        low.join(named, "dataset_id")
        .select("dataset_id", "dataset_name", "overall_score", "completeness_score", "freshness_score", "file_health_score", "computed_at")
        .orderBy("overall_score", "dataset_id")
    )


def history(metrics: DataFrame) -> DataFrame:
    """Every metrics row with the overall score of the row before it, newest first per dataset."""
    trend = bucketed_lag(
        metrics, ["dataset_id"], ["computed_at", "id"], "overall_score", F.year("computed_at"), "previous_overall"
    )
    return trend.orderBy("dataset_id", F.desc("computed_at"), F.desc("id"))
