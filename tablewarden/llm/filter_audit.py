"""How filters act together: what each removes in every order, from tables of the rows that fail them.

Each filter has a stored table of the rows that fail it. A prefix of an order removes what its set of filters removes, so the
2 ** n sets stand for all prefixes:

1. Rows that fail at least one filter start with the empty prefix. Filter by filter, each prefix is taken with and without the
   filter, and a left-anti join takes the filter's failing rows out of those prefixes that have it. What is left are the
   survivors of every prefix. Rows that fail nothing survive everywhere and are only counted.
2. For each filter, a left-semi join of the survivors of all prefixes without it with its failing rows gives what it removes
   after them, with the labels lost. The failing rows that are not removed there are redundant after that prefix, and those
   removed after all other filters fail this one only.
3. The counts by part, prefix and filter are joined with the orders they occur in.

All joins are on a number given to each row, so repeated ids, repeated rows and hot sources are no hot keys. A row of the
survivors' table has some 20 bytes; a row that fails m of n filters has 2 ** (n - m) of them.

Null texts are empty, the part of a null source is the empty string. A null id neither fails for a copy nor makes one fail, and
has no labels. Repeated rows count as often as they are there. Of several labels of one id any counts. Equal texts are told by
their 256-bit hash. Other columns of the tables, whatever their names, are not read. No rows give no result rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import keep

CLASS_PART = 1024
SALTS = 64
_WORD_GAPS = r"[\x20\x09-\x0D]+"


def text_conditions(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of one text: too short, too repetitive, too many capitals, symbols."""
    words = F.filter(F.split(text, _WORD_GAPS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": 100 * distinct.cast("long") < 65 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def number_rows(docs: DataFrame, conditions: Mapping[str, Column], doc_id: str, text: str, part: str) -> DataFrame:
    """(row, doc_id, part, print, one boolean for each condition) of every row, stored; ``conditions`` speak of column ``text``."""
    plain = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    judged = plain.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("print"),
        *[F.coalesce(c, F.lit(False)).alias(f"fails_{name}") for name, c in conditions.items()],
    )
    return keep(judged, "judged")  # the numbers hold from here on


def copies(judged: DataFrame) -> DataFrame:
    """(row, doc_id) of rows whose text a smaller id has too; large groups of copies are joined under salts."""
    groups = judged.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    groups = keep(groups.select("print", "first", F.when(F.col("n") > CLASS_PART, SALTS).otherwise(1).alias("salts")), "copied")
    rows = judged.select("row", "doc_id", "print")
    some = rows.join(groups.where("salts = 1").select("print", "first"), "print")
    large = groups.where("salts > 1").select("print", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(large, ["print", "salt"])
    return some.unionByName(salted.drop("salt")).where("doc_id > first").select("row", "doc_id")


def failing_tables(judged: DataFrame, names: list[str], copied: str | None) -> dict[str, DataFrame]:
    """A stored table (row, doc_id) for each filter; that of ``copied`` is found over all rows."""
    out = {n: keep(judged.where(f"fails_{n}").select("row", "doc_id"), f"fails-{n}") for n in names}
    if copied:
        out[copied] = keep(copies(judged), f"fails-{copied}")
    return dict(sorted(out.items()))


def labelled(judged: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    """(row, part, good, toxic): 1 where the row's id has such a label."""
    of = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    of = of.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("g", F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce("t", F.lit(False)).cast("int")).alias("toxic"))
    joined = judged.select("row", "doc_id", "part").join(of, "doc_id", "left")
    return joined.select("row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def survivors(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """(row, part, good, toxic, prefix) for every set of filters that the row passes, of rows that fail some filter."""
    some = None
    for table in failing.values():
        some = table.select("row") if some is None else some.unionByName(table.select("row"))
    left = rows.join(some.distinct(), "row", "left_semi").withColumn("prefix", F.lit(0))
    for k, table in enumerate(failing.values()):
        bit = 1 << k
        left = left.withColumn("prefix", F.explode(F.array(F.col("prefix"), F.col("prefix").bitwiseOR(F.lit(bit)))))
        gone = table.select(F.col("row").alias("gone"))
        left = left.join(gone, (F.col("row") == F.col("gone")) & (F.col("prefix").bitwiseAND(F.lit(bit)) != 0), "left_anti")
    return left


def orders_table(names: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(order, step, filter, prefix before, prefix after) for all orders of the filters."""
    out = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, f, before, before | 1 << f))
            before |= 1 << f
    return out


def audit(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column] | None = None, copied: str | None = "E", doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included.

    ``conditions`` say by name (one letter) when a text fails, of a column ``text``; ``copied`` names the filter of repeated texts.
    """
    spark = docs.sparkSession
    conditions = text_conditions(F.col("text")) if conditions is None else conditions
    judged = number_rows(docs, conditions, doc_id, text, part)
    failing = failing_tables(judged, list(conditions), copied)
    names = list(failing)
    rows = keep(labelled(judged, labels, doc_id), "labelled")
    left = keep(survivors(rows, failing), "survivors")

    total = rows.groupBy("part").agg(F.count("*").alias("total"))
    passing = left.groupBy("part", "prefix").agg(F.count("*").alias("passing"))
    removed = None
    for k, table in enumerate(failing.values()):
        lost = left.where(F.col("prefix").bitwiseAND(F.lit(1 << k)) == 0).join(table, "row", "left_semi")
        counts = lost.groupBy("part", "prefix").agg(F.count("*").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
        counts = counts.withColumn("filter", F.lit(k))
        removed = counts if removed is None else removed.unionByName(counts)
    removed = keep(removed, "removed")
    n = len(names)
    whole = (1 << n) - 1
    weight = F.element_at(F.array(*[F.lit(factorial(m) * factorial(n - 1 - m)) for m in range(n)]), F.bit_count("prefix") + 1)
    by_filter = removed.groupBy("part", "filter").agg(
        F.max(F.when(F.col("prefix") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.expr(f"prefix = {whole} - shiftleft(1, filter)"), F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"),
    )
    failed_at_all = passing.where("prefix = 0").select("part", F.col("passing").alias("failed"))

    pairs = [(f, before) for f in range(n) for before in range(1 << n) if not before >> f & 1]
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("prefix"), F.lit(b | 1 << f).alias("after")) for f, b in pairs]))
    cells = total.join(failed_at_all, "part", "left").select("part", "total", F.coalesce("failed", F.lit(0)).alias("failed"), grid.alias("c"))
    cells = cells.select("part", "total", "failed", "c.filter", "c.prefix", "c.after")
    cells = cells.join(removed, ["part", "filter", "prefix"], "left").join(by_filter, ["part", "filter"], "left")
    cells = cells.join(passing.select("part", F.col("prefix").alias("after"), "passing"), ["part", "after"], "left")
    cells = keep(cells.na.fill(0), "cells")
    orders = spark.createDataFrame(orders_table(names), "filter_order string, step int, filter int, prefix int, after int").drop("after")
    out = cells.join(F.broadcast(orders), ["filter", "prefix"])  # n! * n rows, whatever the data
    return out.select(
        "part", "filter_order", "step", (F.col("total") - F.col("failed") + F.col("passing")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley"),
    )
