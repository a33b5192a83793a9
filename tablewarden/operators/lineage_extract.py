"""Column lineage of a query corpus given as SELECT items and FROM lists.

items: query_id, branch, target_table, target_column (NULL when unnamed), expr, is_wildcard
tables: query_id, branch, ordinal, alias (NULL when none), table (NULL for a derived table)

``branch`` numbers the SELECTs of a set operation, each with its own FROM list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import lineage_exprs as lx
from tablewarden.session import settle

_QUERY = ["query_id", "branch"]


def source_tables(tables: DataFrame) -> DataFrame:
    """Tables each SELECT reads under the name it uses for them; derived tables as ``<subquery:alias>``."""
    named = tables.select(
        *_QUERY, "ordinal", F.coalesce("alias", "table").alias("source_table"),
        F.coalesce("table", F.concat(F.lit("<subquery:"), "alias", F.lit(">"))).alias("table_name"),
    )
    return named.groupBy(*_QUERY, "source_table", "table_name").agg(F.min("ordinal").alias("ordinal"))


def read_texts(texts: DataFrame) -> DataFrame:
    """(expr, name, kind, text, refs) of each distinct item text: query logs repeat their items.

    Every step is a column of its own, so each mask is computed once. The result is written out: otherwise
    a filter on it would be pushed below the ``distinct`` and read every item again.
    """
    steps = texts.select("expr").distinct().withColumn("item", lx.unwrap(F.col("expr")))
    steps = steps.withColumn("masked", lx.mask(F.col("item")))
    steps = steps.withColumn("top", F.trim(lx.collapse_cases(F.col("masked")))).withColumn("kind", lx.operation(F.col("top")))
    wrapped = F.col("item") != F.trim("expr")
    texts_read = steps.select(
        "expr", F.when(wrapped, "?column?").otherwise(lx.default_name(F.col("masked"))).alias("name"), "kind",
        lx.expression_text(F.col("item"), F.col("masked"), F.col("top"), F.col("kind")).alias("text"),
        lx.column_references(F.col("item")).alias("refs"), lx.has_subquery(F.col("expr")).alias("has_subquery"),
    )
    return settle(texts_read, "item-texts")


def extract(items: DataFrame, tables: DataFrame) -> DataFrame:
    """One edge per column occurrence: its source under the name the query uses, and the item's outermost operation.

    Unqualified columns belong to the first table of the FROM list, or to ``<unknown>`` without one.
    """
    plain = items.where(~F.col("is_wildcard"))
    refs = plain.join(read_texts(plain).where(~F.col("has_subquery")), "expr").select(
        *_QUERY, "target_table", F.coalesce("target_column", "name").alias("target_column"), F.col("kind").alias("transformation"),
        F.col("text").alias("expression"), F.explode("refs").alias("ref"),
    )
    parts = F.transform(F.regexp_extract_all("ref", F.lit(r'("[^"]+"|[^."]+)'), F.lit(1)), lambda p: F.regexp_replace(p, '"', ""))
    split = refs.withColumn("parts", parts).withColumn("source_column", F.element_at("parts", -1))
    split = split.withColumn("qualifier", F.when(F.size("parts") >= 2, F.element_at("parts", -2)))
    first = source_tables(tables).groupBy(*_QUERY).agg(F.min_by("source_table", "ordinal").alias("first_table"))
    return split.join(first, _QUERY, "left").select(
        *_QUERY, F.coalesce("qualifier", "first_table", F.lit("<unknown>")).alias("source_table"), "source_column",
        "target_table", "target_column", "transformation", "expression",
    )


def resolve_tables(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges with the table behind each source name; names that are no alias stay as they are."""
    known = source_tables(tables).groupBy(*_QUERY, "source_table").agg(F.min_by("table_name", "ordinal").alias("table_name"))
    joined = edges.join(known, [*_QUERY, "source_table"], "left")
    return joined.withColumn("source_name", F.coalesce("table_name", "source_table")).drop("table_name")


def default_names(items: DataFrame) -> DataFrame:
    """Unnamed items with the name they get."""
    return items.join(read_texts(items).select("expr", "name"), "expr")


def warnings(items: DataFrame) -> DataFrame:
    """Items whose lineage is incomplete: wildcards without a known schema, and subqueries."""
    lost = F.when(
        F.col("is_wildcard"), F.concat(F.lit("columns unknown: "), F.trim("expr"))
    ).otherwise(
        F.concat(F.lit("subquery not read: "), F.coalesce("target_column", F.lit("?column?")))
    )
    inner = items.where(~F.col("is_wildcard"))
    nested = inner.join(read_texts(inner).where("has_subquery").select("expr"), "expr", "left_semi").select(*items.columns)
    return items.where("is_wildcard").unionByName(nested).select(*_QUERY, "target_table", lost.alias("warning"))


def expand_wildcards(items: DataFrame, tables: DataFrame, datasets: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(direct edges for ``*`` and ``t.*`` from catalogued schemas, warnings where a table is unknown)."""
    wild = items.where("is_wildcard").select(
        *_QUERY, "target_table", "expr", F.regexp_replace(F.regexp_extract("expr", r"^\s*(.*?)\.?\*\s*$", 1), '"', "").alias("qualifier")
    )
    uses = wild.join(source_tables(tables), _QUERY).where((F.col("qualifier") == "") | (F.col("qualifier") == F.col("source_table")))
    known = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("table_name"))
    placed = uses.join(known, "table_name", "left")
    cols = fields.select("dataset_id", F.col("name").alias("source_column"))
    edges = placed.where("dataset_id IS NOT NULL").join(cols, "dataset_id").select(
        *_QUERY, "source_table", "source_column", "target_table", F.col("source_column").alias("target_column"),
        F.lit("direct").alias("transformation"), F.lit(None).cast("string").alias("expression"),
    )
    lost = placed.where("dataset_id IS NULL").select(*_QUERY, "target_table", F.col("table_name").alias("unknown_table"))
    return edges, lost
