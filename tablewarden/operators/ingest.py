"""Registering dataset descriptors: name rules, upsert of the catalog tables, operational metadata."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.fixed_values import MAX_DATASET_NAME, MAX_FIELD_NAME, MAX_IDENTIFIER, MAX_TAG
from tablewarden.operators.skew import dense_ids, latest_per_key

# Letters and digits of any script.
_WORD = r"\p{IsAlphabetic}\p{N}"
_CHARS = {
    "dataset": (MAX_DATASET_NAME, rf"^[{_WORD}_.\-]*$"),
    "field": (MAX_FIELD_NAME, rf"^[{_WORD}_]*$"),
    "tag": (MAX_TAG, rf"^[{_WORD}_:\-]*$"),
    "tenant": (MAX_IDENTIFIER, rf"^[{_WORD}_\-]*$"),
    "domain": (MAX_IDENTIFIER, rf"^[{_WORD}_\-]*$"),
}


def name_problem(kind: Column, value: Column) -> Column:
    """Why a name of the given kind is refused, or NULL. Lengths count bytes."""
    out = F.when((kind == "path") & value.startswith("file://") & value.contains(".."), "path traversal")
    out = out.when((kind == "path") & value.startswith("file://") & value.contains("\0"), "path holds a null byte")
    out = out.when((kind != "path") & (value == ""), "empty")
    for k, (limit, chars) in _CHARS.items():
        out = out.when((kind == k) & (F.octet_length(value) > limit), "too long")
        out = out.when((kind == k) & ~value.rlike(chars), "invalid characters")
    edge = value.startswith("-") | value.endswith("-")
    return out.when((kind == "dataset") & edge, "hyphen at the edge")


def descriptor_items(descriptors: DataFrame) -> DataFrame:
    """(name, kind, value): every name used by a batch of descriptors."""
    one = lambda kind, col: F.array(F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value")))
    many = lambda kind, col, get: F.transform(F.col(col), lambda x: F.struct(F.lit(kind).alias("kind"), get(x).alias("value")))
    items = F.concat(
        one("dataset", "name"), one("path", "path"), one("tenant", "tenant"), one("domain", "domain"),
        many("field", "fields", lambda x: x["name"]), many("tag", "tags", lambda x: x),
    )
    return descriptors.select("name", F.explode(items).alias("i")).select("name", "i.*").where("value IS NOT NULL")


def violations(items: DataFrame) -> DataFrame:
    return items.withColumn("reason", name_problem(F.col("kind"), F.col("value"))).where("reason IS NOT NULL")


def split_valid(descriptors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(descriptors free of violations, violations)."""
    bad = violations(descriptor_items(descriptors))
    return descriptors.join(bad.select("name").distinct(), "name", "left_anti"), bad


@dataclass(frozen=True)
class Catalog:
    """The catalog tables an emission touches."""

    datasets: DataFrame  # id, name, path, format, description, tenant, domain, owner, created_at, last_updated, row_count, size_bytes, partition_keys
    fields: DataFrame  # dataset_id, name, data_type, nullable
    lineage: DataFrame  # upstream_dataset_id, downstream_dataset_id
    tags: DataFrame  # dataset_id, tag


def emit(catalog: Catalog, batch: DataFrame) -> Catalog:
    """The catalog after registering ``batch``.

    batch: name, path, format, description, tenant, domain, owner, emitted_at, row_count, size_bytes,
    partition_keys array, fields array<struct<name, data_type, nullable>>, upstream array<string>,
    tags array<string>. Of rows with one name the last by emitted_at counts. Known datasets keep id and created_at, everything else
    of an emitted dataset is replaced; upstream names the catalog does not know are skipped.
    """
    batch = latest_per_key(batch, ["name"], ["emitted_at", "path"])
    known = catalog.datasets.select(F.col("name"), F.col("id").alias("known_id"), F.col("created_at").alias("known_created"))
    top = F.coalesce(catalog.datasets.agg(F.max("id")).scalar(), F.lit(0))
    matched = batch.join(known, "name", "left")
    # Only new names need an id; the numbering is a function of the names, so recomputing it gives the same ids.
    fresh = dense_ids(matched.where("known_id IS NULL").select("name"), "name", top, "new_id")
    placed = matched.join(fresh, "name", "left").withColumn("id", F.coalesce("known_id", "new_id"))
    keys = F.when(F.size("partition_keys") > 0, F.to_json("partition_keys"))
    rows = placed.select(
        "id", "name", "path", "format", "description", "tenant", "domain", "owner",
        F.coalesce("known_created", "emitted_at").alias("created_at"), F.col("emitted_at").alias("last_updated"),
        "row_count", "size_bytes", keys.alias("partition_keys"),
    )
    kept = catalog.datasets.join(batch.select("name"), "name", "left_anti")
    datasets = kept.select(*rows.columns).unionByName(rows)

    emitted = placed.select("id", "fields", "upstream", "tags")
    ids = emitted.select(F.col("id").alias("dataset_id"))
    new_fields = emitted.select(F.col("id").alias("dataset_id"), F.inline("fields"))
    fields = catalog.fields.join(ids, "dataset_id", "left_anti").select(*new_fields.columns).unionByName(new_fields)
    new_tags = emitted.select(F.col("id").alias("dataset_id"), F.explode("tags").alias("tag")).distinct()
    tags = catalog.tags.join(ids, "dataset_id", "left_anti").select("dataset_id", "tag").unionByName(new_tags)

    inbound = emitted.select(F.col("id").alias("downstream_dataset_id"), F.explode("upstream").alias("up"))
    sources = datasets.select(F.col("name").alias("up"), F.col("id").alias("upstream_dataset_id"))
    new_edges = inbound.join(sources, "up").select("upstream_dataset_id", "downstream_dataset_id").distinct()
    gone = ids.withColumnRenamed("dataset_id", "downstream_dataset_id")
    lineage = catalog.lineage.join(gone, "downstream_dataset_id", "left_anti").select(*new_edges.columns).unionByName(new_edges)
    return replace(catalog, datasets=datasets, fields=fields, lineage=lineage, tags=tags)


def operational_meta(df: DataFrame) -> DataFrame:
    """Rows, files and bytes of a file-backed frame, from one scan that reads no column."""
    files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )
    return files.agg(F.sum("rows").alias("row_count"), F.count(F.lit(1)).alias("num_files"), F.sum("bytes").alias("size_bytes"))


def schema_fields(df: DataFrame) -> DataFrame:
    """A frame's own columns as rows (position, name, data_type, nullable)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, data_type string, nullable boolean")


def clean_transactions(df: DataFrame) -> DataFrame:
    return df.where("status = 'completed' AND customer_id IS NOT NULL AND amount > 0")


def customer_summary(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("total_amount"), F.avg("amount").alias("avg_amount"))
        .orderBy(F.desc("total_amount"), "customer_id")
    )
