"""Which files of a Delta log to read, chosen by their names before any of them is opened.

A table's state at a version is made of the newest complete checkpoint not after it (one file, several parts, or a file
that names sidecar files) and the commits after that. A compacted file stands for a range of commits; ranges that begin after the
checkpoint and end by the version are taken in order, the longest of those with one beginning, and the commits they cover are
left out. Versions that are covered by nothing make the log incomplete, which is an error and never a smaller result. The names
are listed with the files' contents left unread; the driver holds the chosen names, as Spark's own file index does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.session import settle
from tablewarden.sources.delta_log import ACTION_SCHEMA

SIDECAR = "sidecar struct<path:string, sizeInBytes:bigint, modificationTime:bigint>"
FILE_SCHEMA = f"{ACTION_SCHEMA}, {SIDECAR}"
_DIGITS = r"/_delta_log/(\d{20})"


def list_files(spark: SparkSession, locations: list[str]) -> DataFrame:
    """(location, path, kind, version, until, part, parts) of the log files of the tables; other names are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,parquet}").load([f"{loc.rstrip('/')}/_delta_log" for loc in locations])
    path = F.col("path")
    kinds = {"commit": r"\.json$", "compacted": r"\.\d{20}\.compacted\.json$", "checkpoint": r"\.checkpoint\.parquet$", "part": r"\.checkpoint\.\d{10}\.\d{10}\.parquet$", "named": r"\.checkpoint\.[0-9a-fA-F-]{36}\.(json|parquet)$"}
    kind = reduce(lambda c, k: c.when(path.rlike(_DIGITS + kinds[k]), k), kinds, F.when(F.lit(False), ""))
    number = lambda pattern: F.expr(f"try_cast(regexp_extract(path, r'{pattern}', 1) AS BIGINT)")
    listed = found.select(F.regexp_extract(path, r"^(.*)/_delta_log/", 1).alias("location"), "path", kind.alias("kind"), number(_DIGITS + r"\.").alias("version"), number(r"/\d{20}\.(\d{20})\.compacted\.json$").alias("until"),
                          number(r"\.checkpoint\.(\d{10})\.\d{10}\.parquet$").alias("part"), number(r"\.checkpoint\.\d{10}\.(\d{10})\.parquet$").alias("parts"))
    return listed.where("kind is not null")


def complete_checkpoints(files: DataFrame) -> DataFrame:
    """The files of whole checkpoints, one form of each version: a single file before a named one before one in parts."""
    parts = files.where("kind = 'part'")
    whole = parts.where("part between 1 and parts").groupBy("location", "version", "parts").agg(F.countDistinct("part").alias("n")).where("n = parts")
    forms = files.where("kind in ('checkpoint', 'named')").select("location", "version", F.when(F.col("kind") == "checkpoint", 0).otherwise(1).alias("rank"), F.lit(0).cast("bigint").alias("parts"), F.col("path").alias("one"))
    forms = forms.unionByName(whole.select("location", "version", F.lit(2).alias("rank"), "parts", F.lit("").alias("one")))
    best = forms.groupBy("location", "version").agg(F.min(F.struct("rank", "one", "parts")).alias("best"))
    held = files.join(best, ["location", "version"]).where("kind in ('checkpoint', 'named', 'part')")
    return held.where("CASE WHEN best.rank = 2 THEN kind = 'part' AND parts = best.parts ELSE path = best.one END").drop("best")


def choose(files: DataFrame, version: int | None = None) -> DataFrame:
    """(location, path, kind, version, until, last): the files that make up each table at ``version``, or as it is now."""
    seen = files if version is None else files.where((F.col("version") <= version) & (F.coalesce("until", "version") <= version))
    checkpoints = complete_checkpoints(seen)
    base = checkpoints.groupBy("location").agg(F.max("version").alias("base"))
    top = seen.where("kind <> 'part'").groupBy("location").agg(F.max(F.coalesce("until", "version")).alias("last"))
    after = seen.where("kind in ('commit', 'compacted')").join(base, "location", "left").withColumn("base", F.coalesce("base", F.lit(-1))).where("version > base")
    ranges = after.where("kind = 'compacted' and until >= version").groupBy("location").agg(F.sort_array(F.collect_list(F.struct("version", (-F.col("until")).alias("minus"), "path"))).alias("r"))
    # the ranges since one checkpoint, in order; each that begins after the end of the one before it is taken
    taken = F.aggregate(
        "r", F.struct(F.lit(-1).cast("bigint").alias("end"), F.array().cast("array<struct<version:bigint,minus:bigint,path:string>>").alias("kept")),
        lambda acc, x: F.when(x["version"] > acc["end"], F.struct((-x["minus"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    chosen = settle(ranges.select("location", F.explode(taken).alias("x")).select("location", F.col("x.version").alias("version"), (-F.col("x.minus")).alias("until"), F.col("x.path").alias("path")), "log-ranges")
    singles = after.where("kind = 'commit'").select("location", "path", "version")
    covered = chosen.select(F.col("location").alias("l"), F.col("version").alias("a"), F.col("until").alias("z"))
    singles = singles.join(covered, (F.col("location") == F.col("l")) & F.col("version").between(F.col("a"), F.col("z")), "left_anti")
    of_base = checkpoints.join(base.withColumnRenamed("base", "version"), ["location", "version"], "left_semi")
    segment = of_base.select("location", "path", F.lit("checkpoint").alias("kind"), "version", F.col("version").alias("until"))
    segment = segment.unionByName(singles.select("location", "path", F.lit("commit").alias("kind"), "version", F.col("version").alias("until")))
    segment = segment.unionByName(chosen.select("location", "path", F.lit("compacted").alias("kind"), "version", "until"))
    return segment.join(top, "location")


def gaps(segment: DataFrame) -> DataFrame:
    """(location, missing): tables whose chosen files do not cover every version up to the last one."""
    once = segment.groupBy("location", "last", "kind", "version").agg(F.max("until").alias("until"))
    covered = F.when(F.col("kind") == "checkpoint", F.col("version") + 1).otherwise(F.col("until") - F.col("version") + 1)
    return once.groupBy("location", "last").agg((F.col("last") + 1 - F.sum(covered)).alias("missing")).where("missing <> 0").select("location", "missing")


def _plain(path: str) -> Column:
    """A path without its scheme, which the listing and the readers may write differently."""
    return F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", FILE_SCHEMA).alias("a"))
    return text.select("path", "a.*")


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = spark.read.schema(FILE_SCHEMA).parquet(*paths)
    return found.select(F.col("_metadata.file_path").alias("path"), *[F.col(f.name) for f in found.schema])


def read_files(spark: SparkSession, segment: DataFrame) -> DataFrame:
    """The actions (location, version, checkpoint, add, remove, ...) of the chosen files and of the sidecars that they name."""
    names = segment.select("path", "kind").collect()
    opened = []
    for is_text, reader in ((True, _lines), (False, _rows)):
        paths = [r["path"] for r in names if r["path"].endswith(".json") is is_text]
        if paths:
            opened.append(reader(spark, paths))
    if not opened:
        return spark.createDataFrame([], f"location string, version bigint, checkpoint boolean, {ACTION_SCHEMA}")
    of = segment.select("location", F.col("until").alias("version"), (F.col("kind") == "checkpoint").alias("checkpoint"), "path")
    places = settle(of.withColumn("file", _plain("path")).drop("path"), "log-places")
    rows = reduce(DataFrame.unionByName, opened).withColumn("file", _plain("path")).drop("path")
    actions = settle(rows.join(F.broadcast(places), "file").drop("file"), "delta-actions")
    beside = actions.where("sidecar is not null").select("location", "version", "checkpoint", F.col("sidecar.path").alias("name")).distinct()
    beside = beside.withColumn("path", F.when(F.col("name").contains("/"), F.col("name")).otherwise(F.concat("location", F.lit("/_delta_log/_sidecars/"), "name")))
    held = beside.collect()
    actions = actions.drop("sidecar")
    if held:
        side = _rows(spark, sorted({r["path"] for r in held})).withColumn("file", _plain("path")).drop("path", "sidecar")
        of_side = beside.withColumn("file", _plain("path")).select("file", "location", "version", "checkpoint")
        actions = actions.unionByName(side.join(F.broadcast(of_side), "file").drop("file").select(*actions.columns))
        actions = settle(actions, "delta-actions")
    return actions


def read_state(spark: SparkSession, locations: list[str], version: int | None = None) -> DataFrame:
    """The actions that make up the tables at ``version`` (as they are now by default), and of no other files."""
    segment = settle(choose(settle(list_files(spark, locations), "log-files"), version), "log-segment")
    incomplete = gaps(segment).orderBy("location").limit(5).collect()
    if incomplete:
        raise ValueError(f"incomplete logs, versions missing: {[(r['location'], r['missing']) for r in incomplete]}")
    return read_files(spark, segment)


def read_commits(spark: SparkSession, locations: list[str]) -> DataFrame:
    """The actions of all single commits that are there, as history needs them."""
    paths = [r["path"] for r in list_files(spark, locations).where("kind = 'commit'").select("path").collect()]
    if not paths:
        return spark.createDataFrame([], f"location string, version bigint, checkpoint boolean, {ACTION_SCHEMA}")
    location, version = F.regexp_extract("path", r"^(.*)/_delta_log/", 1), F.expr(f"try_cast(regexp_extract(path, r'{_DIGITS}', 1) AS BIGINT)")
    rows = _lines(spark, paths).select(location.alias("location"), version.alias("version"), F.lit(False).alias("checkpoint"), "*")
    return settle(rows.drop("path", "sidecar"), "delta-actions")
