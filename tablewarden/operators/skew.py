"""Ordered-group primitives that never put one whole group into one task.

A key may hold a third of all rows. Each primitive splits a group by a coarse bucket that is
monotone in the ordering (a day, an hour), works inside (key, bucket), and combines buckets
through one pre-aggregated row per (key, bucket).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.session import settle, settle_counted

#: A key held by more texts than this is joined in parts of about so many.
PART_ROWS = 100_000
#: A key that makes more pairs than this is joined in parts of about so many.
PART_PAIRS = 5_000_000
#: So many keys, of some tens of bytes, are sent to all tasks; more are joined by exchange.
FEW_KEYS = 500_000
#: The start or end of a text that serves as a key.
ANCHOR = 8


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the left side's keys stay."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by a partially aggregated ``max_by``."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def bucketed_row_number(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "row_no"
) -> DataFrame:
    """Exact ``row_number`` per key, ascending by ``order``; ``bucket`` must not decrease along it."""
    df = df.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = join_null_safe(df.withColumn("_inside", inside), offsets, part)
    return numbered.withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def bucketed_lag(
    df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """Exact ``lag(value)`` per key ascending by ``order``, crossing bucket borders."""
    df = df.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    lasts = df.groupBy(*part).agg(F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("_last"))
    carried = lasts.select(*part, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_prev"))
    inside = Window.partitionBy(*part).orderBy(*order)
    step = df.withColumn("_rn", F.row_number().over(inside)).withColumn("_lag", F.lag(value).over(inside))
    merged = join_null_safe(step, carried, part)
    lagged = F.when(F.col("_rn") == 1, F.col(f"_prev.{value}")).otherwise(F.col("_lag"))
    return merged.withColumn(out, lagged).drop("_bucket", "_rn", "_lag", "_prev")


def dense_ids(df: DataFrame, key: str, start: Column, out: str, buckets: int = 4096) -> DataFrame:
    """Unique consecutive ids after ``start`` for rows unique in ``key``: hash buckets plus prefix sums."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``buckets`` rows reach this ordered window.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    numbered = df.withColumn("_inside", inside).join(offsets, "_bucket")
    return numbered.withColumn(out, start + F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def _grams(text: Column, n: int) -> Column:
    size = F.length(text)
    spots = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.substring(text, i, F.lit(n)))


def needle_keys(needle: Column) -> Column:
    """Keys of a needle to be found anywhere in a text: its grams of three characters, or itself if it is shorter."""
    grams = F.transform(_grams(needle, 3), lambda g: F.concat(F.lit("c3:"), g))
    short = F.array(F.concat(F.lit("c"), F.length(needle).cast("string"), F.lit(":"), needle))
    return F.when(needle == "", F.array(F.lit("a0:"))).when(F.length(needle) >= 3, grams).otherwise(short)


def start_key(needle: Column) -> Column:
    """Key of a needle that a text has to start with."""
    own = F.left(needle, F.lit(ANCHOR))
    return F.concat(F.lit("p"), F.length(own).cast("string"), F.lit(":"), own)


def end_key(needle: Column) -> Column:
    """Key of a needle that a text has to end with."""
    own = F.right(needle, F.lit(ANCHOR))
    return F.concat(F.lit("s"), F.length(own).cast("string"), F.lit(":"), own)


def whole_key(needle: Column) -> Column:
    """Key of a needle that a text has to be equal to."""
    return F.concat(F.lit("e0:"), needle)


def _offered(text: Column, kind: str) -> Column:
    """The keys of one kind (its letter and number of characters) that a text holds."""
    tag, n = kind[0], int(kind[1:])
    head = lambda x: F.concat(F.lit(f"{kind}:"), x)
    if tag == "c":
        return F.transform(_grams(text, n), head)
    one = {"a": lambda: F.lit("a0:"), "e": lambda: head(text), "p": lambda: head(F.left(text, F.lit(n))), "s": lambda: head(F.right(text, F.lit(n)))}[tag]()
    return F.when(F.length(text) >= n, F.array(one)).otherwise(F.array().cast("array<string>"))


def keyed_matches(
    left: DataFrame, text: str, right: DataFrame, keys: Column, condition: Column, part_rows: int = PART_ROWS, weight: Column | None = None
) -> DataFrame:
    """All pairs for which ``condition`` holds, as an equality join on keys: a text has to hold each of the ``keys`` of what it meets.

    The keys are counted over all texts first, and every row of ``right`` is found by the rarest of its keys; one that has
    a key no text has is out. Texts offer each of these keys that they hold once, and only offers that are asked for are dealt out: while
    the keys are at most ``FEW_KEYS`` they go to the texts. A key is joined in as many parts as its texts (``part_rows`` each) and its pairs
    (``PART_PAIRS`` each) ask for, the rows of ``right`` repeated for each; ``weight`` says how many pairs one of them stands for. NULL
    texts and keys meet nothing.
    """
    spark, some = left.sparkSession, F.lit(1) if weight is None else weight
    texts = left.where(F.col(text).isNotNull())
    asking = right.withColumns({"_keys": F.array_sort(F.array_distinct(keys)), "_weight": some})
    asking = settle(asking, "needles").where("size(_keys) > 0 AND NOT exists(_keys, k -> k IS NULL)")
    sets = asking.groupBy("_keys").agg(F.sum("_weight").alias("_weight"))
    pieces = settle(sets.select("_keys", "_weight", F.explode("_keys").alias("_key")), "needle-keys")
    kinds = sorted(r[0] for r in pieces.select(F.substring_index("_key", ":", 1)).distinct().collect())
    none = F.array().cast("array<string>")
    offered = F.explode(F.array_distinct(F.concat(none, *[_offered(F.col(text), k) for k in kinds]))).alias("_key")
    wanted = _for_all(*settle_counted(pieces.select("_key").distinct(), "needle-kinds"))
    held = texts.select(offered).join(wanted, "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    counted = pieces.join(held, "_key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = counted.groupBy("_keys", "_weight").agg(F.min_by(F.struct("_key", "_n"), F.struct("_n", "_key")).alias("g")).where("g._n > 0")
    index = settle(rarest.select("_keys", "_weight", "g.*"), "needle-index")
    pairs = F.col("_n") * F.sum("_weight")
    parts = F.least("_n", F.greatest(F.ceil(F.col("_n") / part_rows), F.ceil(pairs / PART_PAIRS))).cast("int")
    found, count = settle_counted(index.groupBy("_key", "_n").agg(parts.alias("_parts")).drop("_n"), "needle-parts")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int").alias("_part")
    probe = texts.select("*", offered).join(_for_all(found, count), "_key").select("*", spread).drop("_parts")
    # dealt out by a number that adaptive execution keeps: few texts may make many pairs
    probe = probe.repartition(slices, "_key", "_part")
    build = asking.drop("_weight").join(index.select("_keys", "_key"), "_keys").drop("_keys").join(found, "_key")
    build = build.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return probe.join(build, ["_key", "_part"]).where(condition).drop("_key", "_part")


def _for_all(keys: DataFrame, count: int) -> DataFrame:
    return F.broadcast(keys) if count <= FEW_KEYS else keys


def substring_matches(
    left: DataFrame, text: str, right: DataFrame, needle: str, condition: Column | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """All pairs where ``left.text`` contains ``right.needle`` (``keyed_matches`` on short character grams).

    ``condition`` (by default ``contains``) decides. Empty needles meet every text, NULL texts and needles nothing.
    """
    hit = F.contains(F.col(text), F.col(needle)) if condition is None else condition
    return keyed_matches(left, text, right, needle_keys(F.col(needle)), hit, part_rows)
