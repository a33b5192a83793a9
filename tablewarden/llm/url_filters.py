"""URL filters: host and path rules, and exact list membership from a cascade of Bloom filters without a join.

The complete key universe is known: every host of the corpus, listed or not. Level 1 of the cascade encodes the listed
keys; the unlisted keys that it takes for listed are encoded by level 2, the listed keys that level 2 takes for those by
level 3, and so on until no key is mistaken. A key's first level that does not hold it tells its class, and a key that
all levels hold is of the class of the last, so the answer is exact for every key of the universe.

With r listed and s other keys level 1 has a false positive rate of sqrt(1/2) * r / s and the others have 1/2, which is
about r * (1.44 * log2(s / r) + 4) bits in all; they are read as scalar subqueries, so each executor holds them once. More
than ``MAX_FILTER_BYTES`` is refused: such lists belong into a join. Levels and keys are kept in the shared folder.

Null URLs and those without ``://`` have an empty host and path, which no rule fits. Everything is SQL functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import keep

MAX_FILTER_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?`` or ``#``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. ``rules``: (allow or block, host and path prefix)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda x: len(x[1])):
        domain, slash, tail = text.partition("/")
        fits = (host == domain) | host.endswith("." + domain)
        fits &= path.startswith(slash + tail) if slash else F.lit(True)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    words: DataFrame
    n_words: int
    bits: int
    hashes: int
    number: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(1000 * self.number + j)), F.lit(self.bits)) for j in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        """Whether the filter has all bits of ``key``; the filter is one scalar subquery."""
        words = self.words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("filter")).scalar()
        out = F.lit(True)
        for p in self.positions(key):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            out &= F.getbit(word, p.bitwiseAND(63).cast("int")) == 1
        return out


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(~level.holds(key), F.lit(level.number % 2 == 0)).otherwise(answer)
        return answer


def build_level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """A Bloom filter of the ``n`` rows of ``keys`` (column key), as rows (word, bits) of 64 bits, none left out."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    n_words = -(-bits // 64)
    if 8 * n_words > MAX_FILTER_BYTES:
        raise ValueError(f"a filter of {8 * n_words} bytes is over the bound of {MAX_FILTER_BYTES}")
    level = Level(keys, n_words, bits, hashes, number)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    filled = at.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    every = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = filled.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    level.words = keep(words, f"filter-{number}")
    return level


def build_cascade(universe: DataFrame) -> Cascade:
    """The cascade for ``universe``: (key, listed), each key once."""
    keys = keep(universe.select("key", "listed"), "keys")
    sizes = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    n_in, n_out = sizes.get(True, 0), sizes.get(False, 0)
    levels: list[Level] = []
    rate = min(0.5, math.sqrt(0.5) * n_in / n_out) if n_out else 0.5
    while n_in:
        level = build_level(inside, n_in, rate, len(levels) + 1)
        levels.append(level)
        mistaken = keep(outside.where(level.holds(F.col("key"))), f"mistaken-{level.number}")
        inside, outside, n_out, n_in, rate = mistaken, inside, n_in, mistaken.count(), 0.5
    return Cascade(levels)


def judge(pages: DataFrame, rules: list[tuple[str, str]], is_listed: Column, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    ``is_listed`` is decided once for each host, on column key.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    universe = pages.select(host.alias("key")).distinct().select("key", F.coalesce(is_listed, F.lit(False)).alias("listed"))
    cascade = build_cascade(universe)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_list = F.when(cascade.listed(F.col("host")), "block").otherwise("allow")
    out = pages.withColumns({"host": host, "path": path})
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_list)})
