"""Skew-safe primitives against plain windows and brute force, with one key holding most rows."""

import random

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewarden.operators import skew


def _events(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(6)}", rnd.randrange(200), i, rnd.random()) for i in range(800)]
    return spark.createDataFrame(data, "k string, t int, id int, v double")


def test_row_number_and_lag_cross_buckets(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    numbered = skew.bucketed_row_number(df, ["k"], ["t", "id"], F.floor(F.col("t") / 10))
    assert rows(numbered, "id", "row_no") == rows(df.withColumn("row_no", F.row_number().over(w)), "id", "row_no")
    lagged = skew.bucketed_lag(df, ["k"], ["t", "id"], "v", F.floor(F.col("t") / 10), "before")
    assert rows(lagged, "id", "before") == rows(df.withColumn("before", F.lag("v").over(w)), "id", "before")


def test_latest_and_dense_ids(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    want = df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    assert rows(skew.latest_per_key(df, ["k"], ["t", "id"])) == rows(want)
    names = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("name"))
    ids = [r[0] for r in skew.dense_ids(names, "name", F.lit(40), "new_id", 16).select("new_id").collect()]
    assert sorted(ids) == list(range(41, 1041))


def test_substring_matches(spark):
    texts = ["description", "zip", "client_ip", "", "a", "ab", "aaaa", "xaaay"]
    needles = ["ip", "", "a", "aaa", "desc", "client_ip_long", "y"]
    left = spark.createDataFrame([(t,) for t in texts], "text string")
    right = spark.createDataFrame([(n,) for n in needles], "needle string")
    want = sorted(((t, n) for t in texts for n in needles if n in t), key=repr)
    for part_rows in (1, 3, 100_000):
        assert rows(skew.substring_matches(left, "text", right, "needle", part_rows=part_rows), "text", "needle") == want


def test_substring_matches_of_nulls_and_repeats(spark):
    """Repeated rows stay apart, NULLs meet nothing, a needle no text has is out, as are empty tables."""
    texts, needles = ["abcabc", "abcabc", None, "", "zabz"], ["abc", "abc", None, "", "ab", "qqq", "abq"]
    left = spark.createDataFrame([(t,) for t in texts], "text string")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "id int, needle string")
    want = sorted(((t, i) for t in texts for i, n in enumerate(needles) if t is not None and n is not None and n in t), key=repr)
    for part_rows in (1, 100_000):
        assert rows(skew.substring_matches(left, "text", right, "needle", part_rows=part_rows), "text", "id") == want
    assert skew.substring_matches(left.limit(0), "text", right, "needle").count() == 0
    assert skew.substring_matches(left, "text", right.limit(0), "needle").count() == 0


def test_null_keys_and_times_stay(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, 1, 2), (None, 2, 3), ("a", None, 4)], "k string, t int, id int")
    numbered = skew.bucketed_row_number(df, ["k"], ["t", "id"], F.floor(F.col("t") / 10))
    assert rows(numbered, "id", "row_no") == [(1, 2), (2, 1), (3, 2), (4, 1)]
    assert rows(skew.bucketed_lag(df, ["k"], ["t", "id"], "id", F.floor(F.col("t") / 10), "before"), "id", "before") == [(1, 4), (2, None), (3, 2), (4, None)]
