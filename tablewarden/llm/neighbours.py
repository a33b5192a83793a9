"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is learnt from a bounded sample (``SAMPLE`` vectors at most): each node's vectors are parted by spherical k-means
into ``BRANCHES`` children until about ``LEAF_ROWS`` rows of the whole table fall to a leaf, or the square root of their number
if that is more. Every row is indexed: it goes down to the nearest child's leaf. A query puts the root into a priority
queue, takes out the nearest node again and again, replaces an inner one by its children and visits a leaf. How many leaves
are visited is calibrated: for ``CALIBRATION`` rows, the true neighbours (by brute force over all rows) must be in the
visited leaves for ``target`` of all; visits go on while the leaves hold fewer rows than asked for.

The index is grouped by leaf and cut into parts of about ``PART`` rows, and so are the queries of a leaf, so that a leaf of
many rows, or one that many queries want, is dealt out over tasks. Scores are exact cosines of the original vectors in
double precision; ties go to the smaller id. The tree, the numbers of rows by leaf and the calibration queries are
all that the driver or a broadcast holds, and each is bounded.

Vectors that are null, empty, zero, or have null or non-finite components take no part, nor those whose length is not the
table's most common one; neither do rows without an id. Of rows with one id the best counts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import keep

SAMPLE = 100_000
BRANCHES = 8
LEAF_ROWS = 128
CALIBRATION = 200
PART = 4096
TARGET = 0.97


@dataclass
class Tree:
    """Nodes with unit centroids; a node has children, or the number of its leaf (else -1)."""

    centroids: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    def parts(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        return self.centroids, self.children, self.leaf

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.zeros(len(unit), np.int64)
        while True:
            open_nodes = [n for n in np.unique(node) if self.leaf[n] < 0]
            if not open_nodes:
                return self.leaf[node]
            for n in open_nodes:
                rows = np.flatnonzero(node == n)
                kids = self.children[n]
                node[rows] = kids[(unit[rows] @ self.centroids[kids].T).argmax(axis=1)]

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, the most promising first."""
        queue = [(-1.0, 0)]
        while queue:
            _, n = heapq.heappop(queue)
            if self.leaf[n] >= 0:
                yield int(self.leaf[n])
                continue
            kids = self.children[n]
            for near, kid in zip((self.centroids[kids] @ query).tolist(), kids.tolist(), strict=True):
                heapq.heappush(queue, (-near, kid))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _parts(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means: the cluster of each row."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(10):
        new = (x @ centres.T).argmax(axis=1)
        if (new == own).all() and _:
            break
        own = new
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return own


def grow(sample: np.ndarray, leaf_sample: float, seed: int = 0) -> Tree:
    """The tree over unit vectors, with about ``leaf_sample`` of them to a leaf."""
    rng = np.random.default_rng(seed)
    centroids, children, leaf = [], [], []

    def add(rows: np.ndarray) -> int:
        n = len(centroids)
        mean = sample[rows].sum(axis=0)
        norm = math.sqrt(float(mean @ mean))
        centroids.append(mean / norm if norm else sample[rows[0]])
        children.append(np.zeros(0, np.int64))
        leaf.append(-1)
        return n

    todo = [(add(np.arange(len(sample))), np.arange(len(sample)))]
    leaves = 0
    while todo:
        n, rows = todo.pop()
        branches = int(min(BRANCHES, max(2, len(rows) // max(1, leaf_sample))))
        own = _parts(sample[rows], branches, rng) if len(rows) > 1.5 * leaf_sample else np.zeros(len(rows), np.int64)
        kinds = np.unique(own)
        if len(kinds) < 2:
            leaf[n], leaves = leaves, leaves + 1
            continue
        parts = [rows[own == k] for k in kinds]
        kids = [add(p) for p in parts]
        children[n] = np.array(kids)
        todo += zip(kids, parts, strict=True)
    return Tree(np.array(centroids), children, np.array(leaf))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, cosine) of each query's k best rows, its own id apart."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    x_norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    out: tuple[list, list, list] = ([], [], [])
    for a in range(0, len(q), 256):
        rough = (q[a : a + 256] @ x.T) / x_norm
        rough /= q_norm[a : a + 256, None]
        rough[query_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(rough):
            last = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            close = np.flatnonzero((row >= last - 1e-9) & (row > -np.inf))
            exact = (x[close] * q[a + i]).sum(axis=1) / (x_norm[close] * q_norm[a + i])  # the same for equal rows, unlike a product of matrices
            order = np.lexsort((ids[close], -exact))[:k]
            out[0].extend([a + i] * len(order))
            out[1].extend(close[order].tolist())
            out[2].extend(exact[order].tolist())
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.float64)


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, whatever their length."""
    e = f"`{embedding}`"
    usable = f"size({e}) > 0 and not exists({e}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({e}, x -> x <> 0)"
    both = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(e).cast("array<double>").alias("embedding"))
    return both.where(F.col("vec_id").isNotNull()).where(F.expr(usable.replace(e, "embedding")))


@dataclass
class Index:
    """``rows``: (vec_id, leaf, v) in the shared folder; ``sizes``: rows by leaf; ``n_visits`` as calibrated, with the recall it gave."""

    dim: int
    tree: Tree | None
    rows: DataFrame | None
    sizes: np.ndarray
    n_visits: int
    recall: float


def build(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", target: float = TARGET, k: int = 5) -> Index:
    spark = vectors.sparkSession
    rows = valid(vectors, vec_id, embedding)
    dims = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return Index(0, None, None, np.zeros(0), 0, 1.0)
    dim, n = dims[0]["d"], dims[0]["n"]
    rows = rows.where(F.size("embedding") == dim)
    leaf_rows = max(LEAF_ROWS, math.isqrt(n))
    wanted = min(SAMPLE, max(4096, 32 * n // leaf_rows))
    chance = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < wanted / n).limit(2 * SAMPLE).select("embedding").toPandas()["embedding"]
    sample = unit_rows(np.stack(sample)) if len(sample) else np.eye(1, dim)
    tree = grow(sample, max(2.0, leaf_rows * len(sample) / n))
    shared = spark.sparkContext.broadcast(tree.parts())  # arrays alone: workers need not find the class to read them

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*shared.value)
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim)
            leaf = tree.assign(unit_rows(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(leaf, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "leaf", "v"])

    placed = keep(rows.mapInArrow(place, "vec_id long, leaf int, v binary"), "vectors")
    sizes = np.zeros(tree.n_leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    trial = placed.where(F.pmod(F.xxhash64("vec_id", F.lit("trial")), F.lit(1 << 30)) / float(1 << 30) < 2 * CALIBRATION / n).limit(CALIBRATION).toPandas()
    if trial.empty:
        return Index(dim, tree, placed, sizes, tree.n_leaves, 1.0)
    truth = brute_force(placed, trial["vec_id"].to_numpy(), np.stack([np.frombuffer(v, "<f8") for v in trial["v"]]), dim, k).toPandas()
    place_of = {}
    for q, v in zip(trial["vec_id"], trial["v"], strict=True):
        order = tree.visits(unit_rows(np.frombuffer(v, "<f8")[None])[0])
        place_of[q] = {leaf: i for i, leaf in enumerate(order)}
    needed = np.sort([place_of[q][leaf] + 1 for q, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
    at = min(len(needed) - 1, math.ceil(target * len(needed)) - 1) if len(needed) else -1
    n_visits = int(needed[at]) if at >= 0 else tree.n_leaves
    return Index(dim, tree, placed, sizes, n_visits, float((needed <= n_visits).mean()) if len(needed) else 1.0)


def brute_force(placed: DataFrame, query_ids: np.ndarray, queries: np.ndarray, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, leaf, score): the true k nearest of a bounded set of queries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            q, row, score = _best(ids, _matrix(batch.column("v"), dim), query_ids, queries, k)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[row]), batch.column("leaf").take(pa.array(row)), pa.array(score)], names=["query_id", "vec_id", "leaf", "score"])

    found = placed.mapInArrow(scan, "query_id long, vec_id long, leaf int, score double")
    return top(found, k)


def top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), *[F.min(c).alias(c) for c in found.columns if c not in ("query_id", "vec_id", "score")])
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(index: Index, query_ids: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the indexed rows whose ids are in ``query_ids`` (column vec_id)."""
    spark = query_ids.sparkSession
    if index.rows is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast((index.tree.parts(), index.sizes))
    n_visits, dim = index.n_visits, index.dim

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes = shared.value
        tree = Tree(*parts)
        for batch in batches:
            rows, leaves = [], []
            raw = batch.column("v").to_pylist()
            for i, v in enumerate(raw):
                held = 0
                for n, leaf in enumerate(tree.visits(unit_rows(np.frombuffer(v, "<f8")[None])[0])):
                    if n >= n_visits and held > k:
                        break
                    if sizes[leaf]:
                        held += int(sizes[leaf])
                        rows.append(i)
                        leaves.append(leaf)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), pa.array(leaves, pa.int32()), batch.column("v").take(at)], names=["query_id", "leaf", "q"])

    queries = index.rows.join(query_ids.select("vec_id").distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    routed = keep(queries.select("vec_id", "v").mapInArrow(route, "query_id long, leaf int, q binary"), "routes")
    wanted = np.zeros(len(index.sizes), np.int64)
    for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        wanted[r["leaf"]] = r["n"]
    parts = spark.createDataFrame(
        pd.DataFrame({"leaf": np.arange(len(wanted), dtype=np.int32), "row_parts": -(-index.sizes // PART), "query_parts": -(-wanted // PART)})[wanted > 0], "leaf int, row_parts long, query_parts long"
    )
    parts = F.broadcast(parts)  # a row for each leaf of the bounded tree
    rows = index.rows.join(parts, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), "row_parts").alias("row_part"), F.explode(F.expr("sequence(0L, query_parts - 1)")).alias("query_part"), "vec_id", "v"
    )
    asked = routed.join(parts, "leaf").select(
        "leaf", F.explode(F.expr("sequence(0L, row_parts - 1)")).alias("row_part"), F.pmod(F.xxhash64("query_id"), "query_parts").alias("query_part"), "query_id", "q"
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        q, row, score = _best(ids, _matrix(left.column("v"), dim), query, _matrix(right.column("q"), dim), k)
        return pa.table({"query_id": query[q], "vec_id": ids[row], "score": score})

    keys = ["leaf", "row_part", "query_part"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    return top(found, k).select("query_id", "rank", "vec_id", "score")
