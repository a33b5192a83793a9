"""Reading datasets through the catalog, and catalog snapshots kept as parquet folders."""

from __future__ import annotations

from dataclasses import fields as dataclass_fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.ingest import Catalog


class DatasetNotFound(LookupError):
    pass


def scan_dataset(
    catalog: DataFrame, domain: str, name: str, columns: list[str] | None = None, where: Column | str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The data of one catalogued dataset; projection, filter and limit reach its scan.

    A dataset of another domain is not found; one without a location is an error, not empty.
    """
    row = catalog.where((F.col("name") == name) & (F.col("domain") == domain)).select("path", "format").limit(1).first()
    if row is None:
        raise DatasetNotFound(f"{domain}.{name}")
    if not row["path"]:
        raise ValueError(f"dataset {domain}.{name} has no location")
    df = catalog.sparkSession.read.format(row["format"] or "parquet").load(row["path"])
    if where is not None:
        df = df.where(where)
    if columns is not None:
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def save_catalog(catalog: Catalog, folder: str) -> None:
    """Write a whole new snapshot; readers switch to it by its folder name, so it appears at once."""
    for f in dataclass_fields(Catalog):
        getattr(catalog, f.name).write.parquet(f"{folder}/{f.name}")


def load_catalog(spark: SparkSession, folder: str) -> Catalog:
    return Catalog(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in dataclass_fields(Catalog)})
