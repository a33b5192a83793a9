"""Dataset and column lineage: recording, traversal, propagation and impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.fixed_values import ANONYMISING_WORDS, MAX_LINEAGE_COLUMN_BYTES
from tablewarden.operators.skew import dense_ids, join_null_safe
from tablewarden.session import release, settle, settle_counted


#: Levels walked by one plan; each is a join and one exchange, and a bit of the depths that a column was reached at.
LEVELS = 12
#: A column with more edges than this is joined in parts of about so many.
HUB_EDGES = 1_000_000
#: Over more edges than this, a plan of ``first_reach`` has few levels, and what finished plans left on disk is released.
MANY_EDGES = 5_000_000
FEW_LEVELS = 2
#: Labels of one bit mask, and the bits of the level within a plan at which each of them came.
MASK = 62
_DEPTH = ["d0", "d1", "d2", "d3"]
_HERE = ["dataset_id", "column_name"]


class _Graph:
    """Edges by the column a step starts from, written once, and the steps of a walk.

    Beside its edges, every column has a step to itself, so that one inner join both keeps what is known of a column and
    hands it on; a plan of many levels is then a chain in which nothing is computed twice. As the join is an inner one,
    adaptive execution broadcasts a small state and no edge moves; else the exchange of the steps is made once and reused.
    """

    def __init__(self, edges: DataFrame, downstream: bool):
        near, far = ("source", "target") if downstream else ("target", "source")
        shaped = edges.select(
            F.col(f"{near}_dataset_id").alias("at_ds"),
            F.col(f"{near}_field_name").alias("at_col"),
            F.col(f"{far}_dataset_id").alias("dataset_id"),
            F.col(f"{far}_field_name").alias("column_name"),
            "transformation_type",
            "expression",
        )
        self.edges, self.count = settle_counted(shaped, "lineage-edges")
        if self.count > MANY_EDGES:
            release(edges.sparkSession)
        ends = self.edges.select("at_ds", "at_col", F.col("dataset_id").alias("to_ds"), F.col("column_name").alias("to_col"))
        ends = ends.where("at_ds IS NOT NULL AND at_col IS NOT NULL AND to_ds IS NOT NULL AND to_col IS NOT NULL")
        at, to = F.struct("at_ds", "at_col"), F.struct(F.col("to_ds").alias("at_ds"), F.col("to_col").alias("at_col"))
        degrees = ends.select(F.posexplode(F.array(at, to)).alias("end", "c")).groupBy("c.at_ds", "c.at_col").agg(F.count_if(F.col("end") == 0).alias("n"))
        degrees = degrees.withColumn("spread", F.greatest(F.lit(1), F.ceil(F.col("n") / HUB_EDGES)).cast("int"))
        columns = settle(degrees.select("at_ds", "at_col", "spread"), "lineage-columns")
        hubs = columns.where("spread > 1")
        stay = columns.select("at_ds", "at_col", F.col("at_ds").alias("to_ds"), F.col("at_col").alias("to_col"), F.lit(True).alias("stays"))
        steps = ends.withColumn("stays", F.lit(False))
        self.hubs = None if hubs.isEmpty() else settle(hubs, "lineage-hubs")
        if self.hubs is not None:
            part = F.pmod(F.xxhash64("to_ds", "to_col"), F.coalesce("spread", F.lit(1))).cast("int")
            steps = steps.join(self.hubs, ["at_ds", "at_col"], "left").withColumn("part", part).drop("spread")
            steps, stay = settle(steps, "lineage-steps"), stay.withColumn("part", F.lit(0))
        self.steps = steps.unionByName(stay)

    def from_columns(self, reached: DataFrame) -> DataFrame:
        """Edges leaving the given columns; the other columns of ``reached`` are carried along."""
        return reached.withColumnsRenamed({"dataset_id": "at_ds", "column_name": "at_col"}).join(self.edges, ["at_ds", "at_col"]).drop("at_ds", "at_col")

    def _placed(self, state: DataFrame) -> tuple[list[str], DataFrame]:
        """The state by the columns that steps start from, repeated for each part of a hub's steps."""
        at = state.withColumnsRenamed({"dataset_id": "at_ds", "column_name": "at_col"})
        if self.hubs is None:
            return ["at_ds", "at_col"], at
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1))
        return ["at_ds", "at_col", "part"], at.join(self.hubs, ["at_ds", "at_col"], "left").withColumn("part", parts)

    def hand_on(self, state: DataFrame, value: str, active: Column, next_value: Column, fold) -> DataFrame:
        """One level: columns where ``active`` holds hand ``next_value`` to those after them; values that meet are folded."""
        labels = [c for c in state.columns if c not in (*_HERE, value)]
        keys, at = self._placed(state)
        moved = at.join(self.steps, keys).where(F.col("stays") | active)
        carried = F.when(F.col("stays"), F.col(value)).otherwise(next_value).alias(value)
        moved = moved.select(*labels, F.col("to_ds").alias("dataset_id"), F.col("to_col").alias("column_name"), carried)
        return moved.groupBy(*labels, *_HERE).agg(fold(value).alias(value))

    def hand_on_masks(self, state: DataFrame, level: int) -> DataFrame:
        """One level of ``first_reach``: labels that are new in a column are handed to those after it."""
        keys, at = self._placed(state)
        moved = at.join(self.steps, keys).where(F.col("stays") | (F.col("new") != 0))
        if_stays = lambda c: F.when(F.col("stays"), F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c)
        came = F.when(F.col("stays"), F.lit(0).cast("bigint")).otherwise(F.col("new")).alias("came")
        moved = moved.select("_group", F.col("to_ds").alias("dataset_id"), F.col("to_col").alias("column_name"), came, *map(if_stays, ("seen", *_DEPTH)))
        folded = moved.groupBy("_group", *_HERE).agg(*[F.bit_or(c).alias(c) for c in ("came", "seen", *_DEPTH)])
        new = F.col("came").bitwiseAND(F.bitwise_not("seen"))
        depths = [F.col(d).bitwiseOR(new).alias(d) if level >> k & 1 else F.col(d) for k, d in enumerate(_DEPTH)]
        return folded.select("_group", *_HERE, new.alias("new"), F.col("seen").bitwiseOR(F.col("came")).alias("seen"), *depths)


def traverse(edges: DataFrame, roots: DataFrame, downstream: bool, max_depth: int | None = None) -> DataFrame:
    """Every edge end reachable from each root, once per depth at which it is reached.

    ``roots`` has (dataset_id, column_name) and any number of label columns, which are carried
    along. The state of the walk is one row for each label and column with the set of depths as bits, so the many paths
    of a dense graph do not multiply, and ``LEVELS`` levels are one plan. Without ``max_depth`` the walk ends with the
    first level that reaches no new column. No step leaves a column whose dataset or name is NULL.
    """
    labels = [c for c in roots.columns if c not in _HERE]
    graph = _Graph(edges, downstream)
    frontier = roots.select(*labels, *_HERE).distinct()
    empty = graph.from_columns(frontier).where("false").withColumn("depth", F.lit(0)).select(*labels, *graph.edges.columns[2:], "depth")
    found, base, known, last = [], 0, None, None
    while max_depth is None or base < max_depth:
        levels = LEVELS if max_depth is None else min(LEVELS, max_depth - base)
        state = frontier.withColumn("bits", F.lit(1).cast("bigint"))
        # The last level of all is only looked up in the edges, so it needs no step of its own.
        ahead = levels if max_depth is None or base + levels < max_depth else levels - 1
        for k in range(ahead):
            state = graph.hand_on(state, "bits", F.getbit("bits", F.lit(k)) == 1, F.lit(1 << (k + 1)).cast("bigint"), F.bit_or)
        depths = F.explode(F.filter(F.sequence(F.lit(0), F.lit(ahead)), lambda k: F.getbit("bits", k) == 1))
        reached = settle(state.select(*labels, *_HERE, depths.alias("_step")), "lineage-level")
        found.append(reached.where(F.col("_step") < levels).withColumn("_from", F.col("_step") + base).drop("_step"))
        if max_depth is None:
            new = reached.where("_step > 0").groupBy(*labels, *_HERE).agg((F.min("_step") + base).alias("first"))
            if known is not None:
                new = known.unionByName(new).groupBy(*labels, *_HERE).agg(F.min("first").alias("first"))
            known = settle(new, "lineage-known")
            last = known.agg(F.max("first")).first()[0] or 0
            if last < base + levels:
                break
        frontier, base = reached.where(F.col("_step") == levels).drop("_step"), base + levels
    if not found:
        return empty
    walked = reduce(DataFrame.unionByName, found)
    walked = walked if last is None else walked.where(F.col("_from") <= last)
    return graph.from_columns(walked).withColumn("depth", F.col("_from") + 1).select(*empty.columns).distinct()


def _named(reached: DataFrame, datasets: DataFrame) -> DataFrame:
    return reached.join(datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name")), "dataset_id")


def _one_root(spark, dataset_id: int, column: str) -> DataFrame:
    return spark.range(1).select(F.lit(dataset_id).cast("bigint").alias("dataset_id"), F.lit(column).alias("column_name"))


def column_closure(
    edges: DataFrame, datasets: DataFrame, dataset_id: int, column: str, downstream: bool, max_depth: int | None = None
) -> DataFrame:
    """Columns up- or downstream of one column, with the edge that reaches them and its depth."""
    reached = traverse(edges, _one_root(edges.sparkSession, dataset_id, column), downstream, max_depth)
    return (
        _named(reached, datasets)
        .select("dataset_id", "dataset_name", "column_name", "transformation_type", "expression", "depth")
        .distinct()
        .orderBy("depth", "dataset_id", "column_name", "transformation_type", "expression")
    )


def may_anonymise(transformation, expression):
    words = F.lit(False)
    for w in ANONYMISING_WORDS:
        words = words | F.coalesce(F.ilike(expression, F.lit(f"%{w}%")), F.lit(False))
    return F.coalesce(F.lower(transformation).isin("aggregate", "window"), F.lit(False)) | words


def pii_propagation(edges: DataFrame, datasets: DataFrame, dataset_id: int, column: str, max_depth: int | None = None) -> DataFrame:
    """Where one sensitive column's values may have gone, and whether the last step may hide them."""
    reached = traverse(edges, _one_root(edges.sparkSession, dataset_id, column), True, max_depth)
    flags = reached.drop("depth").distinct()
    return _named(flags, datasets).select(
        "dataset_id",
        "dataset_name",
        "column_name",
        F.coalesce("transformation_type", F.lit("direct")).alias("transformation_type"),
        "expression",
        may_anonymise(F.col("transformation_type"), F.col("expression")).alias("may_anonymize"),
    )


def impact(edges: DataFrame, datasets: DataFrame, fields: DataFrame, field_id: int, max_depth: int | None = None) -> DataFrame:
    """Columns that a change to one field would touch, with a severity."""
    root = fields.where(F.col("id") == field_id).select("dataset_id", F.col("name").alias("column_name"))
    reached = traverse(edges, root, True, max_depth).drop("expression").distinct()
    kind = F.lower(F.coalesce("transformation_type", F.lit("direct")))
    severity = F.when((F.col("depth") == 1) & (kind == "direct"), "high").when(F.col("depth") == 1, "medium").otherwise("low")
    return (
        _named(reached, datasets)
        .select("dataset_id", "dataset_name", "column_name", kind.alias("transformation_type"), "depth", severity.alias("severity"))
        .orderBy("depth", "dataset_name", "column_name", "transformation_type")
    )


def impact_summary(affected: DataFrame) -> DataFrame:
    direct = F.count_if(F.col("transformation_type") == "direct")
    return affected.agg(
        F.count(F.lit(1)).alias("total_affected_columns"),
        F.countDistinct("dataset_id").alias("affected_datasets"),
        direct.alias("direct_dependencies"),
        (F.count(F.lit(1)) - direct).alias("derived_dependencies"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )


def first_reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(labels, dataset_id, column_name, depth): the shortest distance from each label to each column.

    Labels are numbered and ``MASK`` of them are one bit mask, so the state is one row for each column and group of labels: those that
    came in the level before, those that ever came, and the levels they came at, bit by bit. Only the first are handed on, whatever the
    number of paths, and cycles end by themselves: no depth is needed. ``LEVELS`` levels are one plan, fewer over many edges, as a plan's
    exchanges stay on disk until it ends; the state is written between plans.
    """
    labels = [c for c in roots.columns if c not in _HERE]
    graph = _Graph(edges, True)
    start = roots.select(F.struct(*labels).alias("_label") if labels else F.lit(0).alias("_label"), *_HERE).distinct()
    numbers = settle(dense_ids(start.select("_label").distinct(), "_label", F.lit(-1).cast("bigint"), "_no"), "reach-labels")
    numbered = join_null_safe(start, numbers, ["_label"]).withColumn("_group", F.floor(F.col("_no") / MASK))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(_no, {MASK}) AS INT))")
    came = numbered.groupBy("_group", *_HERE).agg(F.bit_or(bit).alias("new"))
    nothing = F.lit(0).cast("bigint")
    state = came.withColumns({"seen": F.col("new")} | {d: nothing for d in _DEPTH})
    found, base, most = [], 0, LEVELS if graph.count <= MANY_EDGES else FEW_LEVELS
    while max_depth is None or base < max_depth:
        levels = most if max_depth is None else min(most, max_depth - base)
        for level in range(1, levels + 1):
            state = graph.hand_on_masks(state, level)
        state, count = settle_counted(state, "reach")
        found.append(state.withColumn("_base", F.lit(base)))
        base += levels
        if count > MANY_EDGES // 5:
            release(edges.sparkSession)
        if state.where("new <> 0").isEmpty():
            break
        state = state.withColumns({d: nothing for d in _DEPTH})
    if not found:
        return roots.withColumn("depth", F.lit(0)).where("false").select(*labels, *_HERE, "depth")
    each = reduce(DataFrame.unionByName, found).where(reduce(lambda a, b: a | b, [F.col(d) != 0 for d in _DEPTH]))
    on = lambda d, i: F.getbit(d, i).cast("int")
    depth = lambda i: reduce(lambda a, b: a + b, [on(d, i) * (1 << k) for k, d in enumerate(_DEPTH)])
    hits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(MASK - 1)), lambda i: F.struct(i.alias("_i"), depth(i).alias("_d"))), lambda x: x["_d"] > 0)
    apart = each.select("_group", "_base", *_HERE, F.inline(hits)).select((F.col("_group") * MASK + F.col("_i")).alias("_no"), *_HERE, (F.col("_base") + F.col("_d")).alias("depth"))
    if not labels:
        return apart.drop("_no")
    return apart.join(numbers, "_no").select("_label.*", *_HERE, "depth")


def pii_roots(fields: DataFrame, classifications: DataFrame) -> DataFrame:
    """All columns classified as personal data, with their field id and category."""
    pii = classifications.where("classification = 'pii'").select("field_id", "category")
    return pii.join(fields, pii.field_id == fields.id).select(
        "field_id", "category", "dataset_id", F.col("name").alias("column_name")
    )


def neighbors(lineage: DataFrame, datasets: DataFrame) -> DataFrame:
    """Direct neighbours of every dataset, one row each: a dataset may have any number of them."""
    names = datasets.select(F.col("id").alias("neighbor_id"), F.col("name").alias("neighbor_name"))
    both = lineage.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("downstream_dataset_id").alias("dataset_id"),
                    F.lit("upstream").alias("direction"),
                    F.col("upstream_dataset_id").alias("neighbor_id"),
                ),
                F.struct(
                    F.col("upstream_dataset_id").alias("dataset_id"),
                    F.lit("downstream").alias("direction"),
                    F.col("downstream_dataset_id").alias("neighbor_id"),
                ),
            )
        ).alias("n")
    ).select("n.*")
    return both.join(names, "neighbor_id").select("dataset_id", "direction", "neighbor_name")


def upsert_edges(lineage: DataFrame, new: DataFrame) -> DataFrame:
    """Dataset edges with new ones added; pairs already present are kept once."""
    return lineage.unionByName(new).dropDuplicates(["upstream_dataset_id", "downstream_dataset_id"])


def check_edges(edges: DataFrame) -> DataFrame:
    """Column edges with ``reason`` NULL when they may be recorded; types normalised to lower case."""
    names = ("source_field_name", "target_field_name")
    bytes_of = [F.octet_length(F.col(n)) for n in names]
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.col(n), F.lit("")) == "" for n in names])
    long = reduce(lambda a, b: a | b, [n > MAX_LINEAGE_COLUMN_BYTES for n in bytes_of])
    bad_id = ~F.coalesce((F.col("source_dataset_id") > 0) & (F.col("target_dataset_id") > 0), F.lit(False))
    reason = F.when(bad_id, "dataset id not positive").when(blank, "empty column name").when(long, "column name too long")
    return edges.withColumn("transformation_type", F.lower("transformation_type")).withColumn("reason", reason)


def record_edges(existing: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(existing plus valid edges, rejected edges with their reason)."""
    checked = check_edges(edges)
    valid = checked.where("reason IS NULL").drop("reason")
    return existing.unionByName(valid), checked.where("reason IS NOT NULL")


def delete_edges(edges: DataFrame, dataset_ids: DataFrame) -> DataFrame:
    """Column edges without those that end in the given datasets (column ``dataset_id``)."""
    gone = dataset_ids.select(F.col("dataset_id").alias("target_dataset_id"))
    return edges.join(gone, "target_dataset_id", "left_anti").select(*edges.columns)
