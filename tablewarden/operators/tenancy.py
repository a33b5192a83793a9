"""Tenant quotas and their enforcement on batches of new datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.exprs import percent_text
from tablewarden.operators.skew import bucketed_row_number


def _dataset_counts(datasets: DataFrame) -> DataFrame:
    return datasets.where("tenant IS NOT NULL").groupBy(F.col("tenant").alias("tenant_id")).agg(F.count(F.lit(1)).alias("n"))


def usage(tenants: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets against quota per tenant; a quota of zero or less is unlimited."""
    joined = tenants.join(_dataset_counts(datasets), "tenant_id", "left").withColumn("dataset_count", F.coalesce("n", F.lit(0)))
    quota = F.col("quota_max_datasets")
    ratio = F.when(quota > 0, F.col("dataset_count") / quota).otherwise(0.0)
    status = F.when(quota <= 0, "unlimited").when(ratio >= 1.0, "exceeded").when(ratio >= 0.8, "warning").otherwise("ok")
    amounts = F.concat(F.col("dataset_count").cast("string"), F.lit(" of "), quota.cast("string"))
    warning = F.when(status == "exceeded", F.concat(F.lit("over quota: "), amounts)).when(
        status == "warning", F.concat(F.lit("near quota: "), amounts, F.lit(" ("), percent_text(ratio, 0), F.lit("%)"))
    )
    return joined.select(
        "tenant_id", "dataset_count", "quota_max_datasets", ratio.alias("usage_ratio"), status.alias("status"), warning.alias("warning")
    )


def admission(requests: DataFrame, tenants: DataFrame, datasets: DataFrame, bucket: Column, dry_run: bool = True) -> DataFrame:
    """Decide a batch of new datasets (id, tenant_id, requested_at) in order of arrival.

    Over the quota a request is blocked, or in a dry run admitted with a warning. Blocked requests
    use no quota, but nor do later ones fit, so a request's place alone decides. A request without a
    tenant, or of one that is not known, is ``unknown_tenant``. ``bucket`` coarsens
    the order of arrival (say the hour) and splits tenants with very many requests.
    """
    placed = bucketed_row_number(requests, ["tenant_id"], ["requested_at", "id"], bucket, "place")
    limits = tenants.join(_dataset_counts(datasets), "tenant_id", "left").select(
        "tenant_id", "quota_max_datasets", F.coalesce("n", F.lit(0)).alias("had")
    )
    judged = placed.join(limits.withColumn("known", F.lit(True)), "tenant_id", "left")
    before = F.col("had") + F.col("place") - 1
    over = F.coalesce((F.col("quota_max_datasets") > 0) & (before >= F.col("quota_max_datasets")), F.lit(False))
    decision = F.when(F.col("known").isNull(), "unknown_tenant").when(~over, "admitted").otherwise("admitted_with_warning" if dry_run else "blocked")
    return judged.select("id", "tenant_id", "place", decision.alias("decision"))
