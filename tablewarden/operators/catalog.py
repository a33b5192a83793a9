"""Catalog listings, details and counts; domains, glossary, tags and owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.exprs import page


def listing(datasets: DataFrame, tenant: str | None = None, domain: str | None = None) -> DataFrame:
    if tenant is not None:
        datasets = datasets.where(F.col("tenant") == tenant)
    if domain is not None:
        datasets = datasets.where(F.col("domain") == domain)
    return datasets.orderBy(F.desc("last_updated"), "id")


def details(
    datasets: DataFrame, fields: DataFrame, tags: DataFrame, neighbors: DataFrame, latest_quality: DataFrame | None = None,
    column_edges: DataFrame | None = None,
) -> DataFrame:
    """Every dataset's detail page as rows (dataset_id, section, item, value).

    One row per item instead of nested lists, so a dataset with millions of fields or neighbours is
    never gathered into one row. Quality and column lineage are optional sections.
    """
    text = lambda c: F.col(c).cast("string")
    attributes = ["name", "path", "format", "description", "tenant", "domain", "owner", "created_at", "last_updated", "row_count", "size_bytes"]
    own = datasets.select(
        F.col("id").alias("dataset_id"),
        F.inline(F.array(*[F.struct(F.lit("dataset").alias("section"), F.lit(a).alias("item"), text(a).alias("value")) for a in attributes])),
    ).where("value IS NOT NULL")
    nullable = F.when(F.col("nullable"), " null").otherwise(" not null")
    parts = [
        own,
        fields.select("dataset_id", F.lit("field").alias("section"), F.col("name").alias("item"), F.concat("data_type", nullable).alias("value")),
        tags.select("dataset_id", F.lit("tag").alias("section"), F.col("tag").alias("item"), F.lit("").alias("value")),
        neighbors.select("dataset_id", F.col("direction").alias("section"), F.col("neighbor_name").alias("item"), F.lit("").alias("value")),
    ]
    if latest_quality is not None:
        scores = [c for c in latest_quality.columns if c.endswith("_score")]
        rows = F.array(*[F.struct(F.lit("quality").alias("section"), F.lit(s).alias("item"), text(s).alias("value")) for s in scores])
        parts.append(latest_quality.select("dataset_id", F.inline(rows)).where("value IS NOT NULL"))
    if column_edges is not None:
        source = F.concat_ws(".", F.col("source_dataset_id").cast("string"), "source_field_name")
        parts.append(
            column_edges.select(
                F.col("target_dataset_id").alias("dataset_id"), F.lit("column_lineage").alias("section"),
                F.col("target_field_name").alias("item"), source.alias("value"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def stats(**tables: DataFrame) -> DataFrame:
    """(table, rows) of each catalog table, from one union of partial counts."""
    ones = [df.select(F.lit(name).alias("table")) for name, df in tables.items()]
    zeros = tables[next(iter(tables))].sparkSession.createDataFrame([(n,) for n in tables], "table string")
    counted = reduce(DataFrame.unionByName, ones).groupBy("table").agg(F.count(F.lit(1)).alias("rows"))
    return zeros.join(counted, "table", "left").select("table", F.coalesce("rows", F.lit(0)).alias("rows"))


def top_values(datasets: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent non-null values of a column."""
    counted = datasets.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("datasets"))
    return counted.orderBy(F.desc("datasets"), column).limit(k)


def domain_counts(domains: DataFrame, datasets: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Active domains with their number of datasets (also none), by name."""
    counted = datasets.where("domain IS NOT NULL").groupBy(F.col("domain").alias("name")).agg(F.count("id").alias("n"))
    active = domains.where("is_active").select("name").join(counted, "name", "left")
    return page(active.select("name", F.coalesce("n", F.lit(0)).alias("dataset_count")).orderBy("name"), limit, offset)


def domain_datasets(domains: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets of active domains; unknown and inactive domains have none."""
    active = domains.where("is_active").select(F.col("name").alias("domain"))
    return datasets.join(active, "domain", "left_semi").select("domain", "id", "name").orderBy("domain", "name")


def glossary_link_counts(terms: DataFrame, links: DataFrame) -> DataFrame:
    counted = links.groupBy(F.col("term_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        terms.join(counted, "id", "left")
        .select("id", "term", "domain", F.coalesce("status", F.lit("draft")).alias("status"), F.coalesce("n", F.lit(0)).alias("link_count"))
        .orderBy("term")
    )


def glossary_links(links: DataFrame, datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """Links with the name of the dataset or field they point to."""
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    f = fields.select(F.col("id").alias("field_id"), F.col("name").alias("field_name"))
    # A missing target is no key: it is joined on nothing rather than hashed as one hot NULL.
    whole = lambda part, other, key: part.where(F.col(key).isNotNull()).join(other, key, "left").unionByName(
        part.where(F.col(key).isNull()), allowMissingColumns=True
    )
    named = whole(whole(links, d, "dataset_id"), f, "field_id")
    return named.select("id", "term_id", "dataset_name", "field_name").orderBy("term_id", "id")


def glossary_link_check(links: DataFrame) -> DataFrame:
    """Links that do not point to exactly one of a dataset and a field."""
    return links.where(F.col("dataset_id").isNull() == F.col("field_id").isNull())


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    return tags.unionByName(new).dropDuplicates(["dataset_id", "tag"])


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, ["dataset_id", "tag"], "left_anti")


def owner_list(owners: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    return page(owners.orderBy("name", "owner_id"), limit, offset)
