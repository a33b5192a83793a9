"""Small column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts) -> Column:
    """Microseconds since 1970 of a ``timestamp_ntz``, independent of the session time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    secs = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return secs * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def seconds_between(later, earlier) -> Column:
    """Whole seconds from ``earlier`` to ``later``, truncated towards zero."""
    gap = epoch_us(later) - epoch_us(earlier)
    return F.when(gap >= 0, F.floor(gap / 1_000_000)).otherwise(F.ceil(gap / 1_000_000)).cast("bigint")


def utc_instant(ts: Column) -> Column:
    """A ``timestamp_ntz`` taken as UTC, as the instant that watermarks need."""
    return F.timestamp_micros(epoch_us(ts))


def utc_wall_clock(instant: Column) -> Column:
    """Inverse of ``utc_instant`` for whole seconds."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(instant).cast("decimal(18,6)"))


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def clamp_unit(score: Column) -> Column:
    """Limit to [0, 1]; NaN and infinities become 0, NULL stays NULL."""
    bad = F.isnan(score) | (F.abs(score) == F.lit(float("inf")))
    return F.when(bad, 0.0).when(score < 0, 0.0).when(score > 1, 1.0).otherwise(score)


def percent_text(ratio: Column, digits: int) -> Column:
    """``ratio`` as a percentage with fixed decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(ratio * 100.0, digits))


def redact_url(url: Column) -> Column:
    """Keep scheme and host, hide the rest; text without a scheme is hidden entirely."""
    shown = F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/]*)", 1), F.lit("/***"))
    return F.when(url.contains("://"), shown).otherwise(F.when(url.isNotNull(), "***"))


def json_string_list(col: Column) -> Column:
    """JSON array of strings to a list; NULL or anything else gives the empty list."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def page(df, limit: int | None, offset: int | None):
    """One page of an already ordered frame: all rows after ``offset``, or the first ``limit`` of them."""
    rest = df.offset(offset) if offset else df
    return rest if limit is None else rest.limit(limit)
