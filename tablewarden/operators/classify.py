"""PII classification of columns, by name and by content, and its reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.exprs import page
from tablewarden.functions.fixed_values import (
    DEFAULT_PII_RULES,
    NAME_MATCH_CONFIDENCE,
    UNKNOWN_CONFIDENCE,
)
from tablewarden.operators.skew import substring_matches

RULE_CONFIG = "patterns array<string>, column_names array<string>"


def default_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as a governance rule table."""
    rows = [
        (i, name, "pii_detection", json.dumps({"patterns": p, "column_names": c}), prio, True)
        for i, name, prio, p, c in DEFAULT_PII_RULES
    ]
    return spark.createDataFrame(
        rows, "id bigint, name string, rule_type string, config string, priority int, is_active boolean"
    )


def rule_hints(rules: DataFrame) -> DataFrame:
    """(rule_id, category, priority, hint) of the active PII rules; rules whose config cannot be read drop out."""
    live = rules.where("rule_type = 'pii_detection' AND is_active")
    parsed = live.withColumn("c", F.from_json("config", RULE_CONFIG))
    return parsed.select(
        F.col("id").alias("rule_id"), F.regexp_replace("name", "_detection$", "").alias("category"), "priority",
        F.explode("c.column_names").alias("hint"),
    ).withColumn("hint", F.lower("hint"))


def classify_by_name(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """One classification per field: the first rule by (priority, id) with a hint inside the lower-case name.

    Names repeat across datasets, so each distinct name is judged once.
    """
    names = fields.select(F.lower("name").alias("lower_name")).distinct()
    hits = substring_matches(names, "lower_name", rule_hints(rules), "hint")
    best = hits.groupBy("lower_name").agg(
        F.min_by(F.struct("rule_id", "category"), F.struct("priority", "rule_id")).alias("r")
    )
    judged = fields.withColumn("lower_name", F.lower("name")).join(best, "lower_name", "left")
    found = F.col("r").isNotNull()
    return judged.select(
        F.col("id").alias("field_id"), "dataset_id", F.col("name").alias("column_name"),
        F.when(found, "pii").otherwise("unknown").alias("classification"),
        F.col("r.category").alias("category"),
        F.when(found, NAME_MATCH_CONFIDENCE).otherwise(UNKNOWN_CONFIDENCE).alias("confidence"),
        F.when(found, "rule").otherwise("auto").alias("source"),
        F.col("r.rule_id").alias("rule_id"),
    )


def _free(pattern: str) -> str:
    return pattern.removeprefix("^").removesuffix("$")


def classify_by_content(df: DataFrame, text_columns: list[str], rules=None, whole_values: bool = True) -> DataFrame:
    """(column_name, rule, matching_values, checked_values): how many values hold each rule's patterns.

    One pass over the data, all rules as literals of one aggregation. ``whole_values`` keeps the
    patterns' anchors; without it they search inside free text. ``rules``: (name, patterns) pairs.
    """
    rules = rules if rules is not None else [(r[1], r[3]) for r in DEFAULT_PII_RULES]
    aggs, rows = [], []
    for i, c in enumerate(text_columns):
        aggs.append(F.count(c).alias(f"_v{i}"))
        for j, (name, patterns) in enumerate(rules):
            hit = F.lit(False)
            for p in patterns:
                hit = hit | F.col(c).rlike(p if whole_values else _free(p))
            aggs.append(F.count_if(hit).alias(f"_m{i}_{j}"))
            rows.append(
                F.struct(
                    F.lit(c).alias("column_name"), F.lit(name).alias("rule"), F.col(f"_m{i}_{j}").alias("matching_values"),
                    F.col(f"_v{i}").alias("checked_values"),
                )
            )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def scan_tables(frames: dict[str, DataFrame], rules: DataFrame, whole_values: bool = False) -> DataFrame:
    """(dataset, column_name, rule, matching_values, checked_values) for every string column of every frame.

    ``rules`` is a governance rule table; the patterns of its active PII rules become literals of the one pass over each frame.
    Without an active rule, or without a string column, there are no rows.
    """
    live = rules.where("rule_type = 'pii_detection' AND is_active").withColumn("c", F.from_json("config", RULE_CONFIG))
    known = [(r["name"], r["patterns"]) for r in live.select("name", "c.patterns").where("size(patterns) > 0").orderBy("name").collect()]
    scans = []
    for name, df in frames.items():
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        if texts and known:
            scans.append(classify_by_content(df, texts, known, whole_values).select(F.lit(name).alias("dataset"), "*"))
    if not scans:
        return rules.sparkSession.createDataFrame([], "dataset string, column_name string, rule string, matching_values bigint, checked_values bigint")
    return reduce(DataFrame.unionByName, scans)


_STORED = ["classification", "category", "confidence", "source"]


def upsert_classifications(stored: DataFrame, scanned: DataFrame, overwrite: bool = False) -> DataFrame:
    """One row per field: scan results over stored rows, which keep ``verified``.

    Verified rows keep their content too unless ``overwrite``.
    """
    old = stored.select("field_id", F.struct(*_STORED, "verified").alias("o"))
    new = scanned.select("field_id", F.struct(*_STORED).alias("n"))
    both = old.join(new, "field_id", "full_outer")
    take_new = F.col("n").isNotNull()
    if not overwrite:
        take_new = take_new & ~F.coalesce(F.col("o.verified"), F.lit(False))
    picked = [F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in _STORED]
    return both.select("field_id", *picked, F.coalesce("o.verified", F.lit(False)).alias("verified"))


def set_manual(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply human decisions (field_id, classification, category): full confidence, verified."""
    manual = decisions.select(
        "field_id", "classification", "category", F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"),
        F.lit(True).alias("verified"),
    )
    kept = stored.join(decisions.select("field_id"), "field_id", "left_anti")
    return kept.select(*manual.columns).unionByName(manual)


def report(fields: DataFrame, classifications: DataFrame) -> DataFrame:
    """Every field with its classification, ``unknown`` when it has none."""
    return fields.select(F.col("id").alias("field_id"), "dataset_id", F.col("name").alias("field_name")).join(
        classifications, "field_id", "left"
    ).select(
        "dataset_id", "field_id", "field_name", F.coalesce("classification", F.lit("unknown")).alias("classification"),
        "category", "confidence", "source", F.coalesce("verified", F.lit(False)).alias("verified"),
    )


def report_counts(report_rows: DataFrame) -> DataFrame:
    return report_rows.groupBy("dataset_id").agg(
        F.count_if(F.col("classification") == "pii").alias("pii_count"),
        F.count_if(F.col("classification") == "unknown").alias("unclassified_count"),
    )


def pii_inventory(classifications: DataFrame, fields: DataFrame, datasets: DataFrame) -> DataFrame:
    """All PII columns with their dataset."""
    f = fields.select(F.col("id").alias("field_id"), "dataset_id", F.col("name").alias("field_name"))
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    pii = classifications.where("classification = 'pii'")
    return (
        pii.join(f, "field_id").join(d, "dataset_id")
        .select("dataset_name", "field_name", "category", "confidence", "verified")
        .orderBy("dataset_name", "field_name")
    )


def pii_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count(F.lit(1)).alias("total_pii_columns"), F.count_if("verified").alias("verified_count"))


def list_rules(rules: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    return page(rules.orderBy("priority", "name"), limit, offset)
