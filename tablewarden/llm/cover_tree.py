"""Exact search for the highest inner products with cover trees over queries and rows.

The tree: a node's centre is one of its points and also the centre of its first child; the children's centres lie further than
half of the node's radius from one another, and each point is within that of the centre of its child. The covering radius of a
node is the distance of its farthest point from its centre. A node is divided while that parts it into groups: one of
``LEAF_POINTS`` points, of equal points, or whose children would have fewer than ``LEAST_CHILD`` points on average stays whole,
as in high dimensions, where points are about equally far from each other and a radius tells nothing.

Two nodes: with centres c, d and radii r, s no inner product of their points is above c.d + r|d| + s|c| + rs. The search walks
both trees together. It leaves out a pair of nodes whose bound is under the worst kth score that the queries of the query node
have so far, so it misses nothing, ties included. Scores are exact whole numbers; bounds are in double precision and a little widened.

Over a cluster (``search``): the upper part of one tree, over a bounded sample of queries and rows together, gives groups; every
row goes to the nearest centre, the queries to coarser nodes of the same tree, and the real radii are measured over all rows.
Each group of queries is first compared with its most promising groups of rows; of the others only those are read whose
bound reaches the worst kth score of that group of queries. Groups are compared in blocks, each task with the trees of its two
blocks. Nothing is left out by the grouping: it only decides what is compared first.

The driver holds the sample, and some numbers for each of at most ``GROUPS`` groups. See ``vectors`` for odd rows. A query is
not compared with rows of its own id. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import vectors as V
from tablewarden.llm.common import keep

SAMPLE = 20_000
GROUPS = 128
QUERY_BLOCK = 2048
ROW_BLOCK = 8192
LEAF_POINTS = 32
LEAST_CHILD = 4
FIRST_ROWS = 4096
_CELLS = 1 << 21
_WIDER = 1e-9


@dataclass
class CoverTree:
    """``points`` in the order of the nodes: node i has the points from ``low[i]`` to ``high[i]`` of ``order``."""

    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list[np.ndarray]

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.low[node] : self.high[node]]


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """From each row of ``x`` to each of ``centres``."""
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def _cover(x: np.ndarray, reach: float, most: int) -> tuple[list[int], np.ndarray] | None:
    """(centres, which covers each row): greedy centres over ``reach`` apart, the first of them row 0; None beyond ``most``."""
    own = np.full(len(x), -1)
    centres: list[int] = []
    while True:
        left = np.flatnonzero(own < 0)
        if not len(left):
            return centres, own
        trial = left[:64]
        near = distances(x[left], x[trial]) <= reach
        for t in range(len(trial)):
            if own[trial[t]] >= 0:
                continue
            if len(centres) >= most:
                return None
            covered = left[near[:, t] & (own[left] < 0)]
            own[covered] = own[trial[t]] = len(centres)
            centres.append(int(trial[t]))


def build(x: np.ndarray, leaf_points: int = LEAF_POINTS) -> CoverTree:
    """The tree over the rows of ``x``."""
    x = x.astype(np.float64)
    order = np.arange(len(x))
    centre, radius, low, high, children = [], [], [], [], []

    def add(i: int, j: int, head: int) -> int:
        rows = order[i:j]
        at = int(np.flatnonzero(rows == head)[0])
        rows[[0, at]] = rows[[at, 0]]
        far = np.sqrt(((x[rows] - x[head]) ** 2).sum(axis=1).max())
        for kept, value in zip((centre, radius, low, high, children), (head, far, i, j, np.zeros(0, np.int64)), strict=True):
            kept.append(value)
        return len(centre) - 1

    if not len(x):
        return CoverTree(x, order, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    middle = x.mean(axis=0)
    todo = [add(0, len(x), int(((x - middle) ** 2).sum(axis=1).argmin()))]
    while todo:
        n = todo.pop()
        i, j = low[n], high[n]
        if j - i <= leaf_points or radius[n] == 0:
            continue
        rows = order[i:j].copy()
        parts = _cover(x[rows], radius[n] / 2, (j - i) // LEAST_CHILD)
        if parts is None or len(parts[0]) < 2:  # one only where rounding hides the distances
            continue
        heads, own = parts
        by_part = np.argsort(own, kind="stable")
        order[i:j] = rows[by_part]
        cut = i + np.searchsorted(own[by_part], np.arange(len(heads) + 1))
        children[n] = np.array([add(int(a), int(b), int(rows[h])) for a, b, h in zip(cut[:-1], cut[1:], heads, strict=True)])
        todo += children[n].tolist()
    return CoverTree(x, order, np.array(centre), np.array(radius), np.array(low), np.array(high), children)


def bounds(c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What no inner product of points within r of c and within s of d is above, for all pairs."""
    c_norm, d_norm = np.sqrt((c * c).sum(axis=1)), np.sqrt((d * d).sum(axis=1))
    most = c @ d.T + r[:, None] * d_norm[None, :] + s[None, :] * c_norm[:, None] + r[:, None] * s[None, :]
    return most + _WIDER * ((c_norm + r)[:, None] * (d_norm + s)[None, :] + 1)


class Search:
    """The best ``k`` rows of each query so far, while both trees are walked; ``floor`` are kth scores known from elsewhere."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.x, self.query_ids, self.q, self.k, self.floor = ids, x, query_ids, q, k, floor
        self.score = np.full((len(q), k), V.LEAST)
        self.row = np.full((len(q), k), -1)
        self.compared = 0

    def worst(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[queries, -1], self.floor[queries])

    def run(self) -> Search:
        if len(self.x) and len(self.q):
            self.queries, self.rows = build(self.q), build(self.x)
            self._visit(0, np.zeros(1, np.int64))
        return self

    def _promising(self, node: int, nodes: np.ndarray) -> np.ndarray:
        """Of the row nodes those that may hold something for the query node, the best first."""
        a, b = self.queries, self.rows
        most = bounds(a.points[a.centre[[node]]], a.radius[[node]], b.points[b.centre[nodes]], b.radius[nodes])[0]
        nodes, most = nodes[order := np.argsort(-most, kind="stable")], most[order]
        return nodes[most >= self.worst(a.rows(node)).min()]

    def _visit(self, node: int, nodes: np.ndarray) -> None:
        kids = self.queries.children[node]
        if len(kids):
            nodes = self._promising(node, nodes)
            wide = [n for n in nodes.tolist() if self.rows.radius[n] > self.queries.radius[node]]
            if wide:  # the wider node is opened first
                nodes = np.concatenate([[n] if n not in wide or not len(self.rows.children[n]) else self.rows.children[n] for n in nodes.tolist()]).astype(np.int64)
            for kid in kids.tolist():
                self._visit(kid, nodes)
            return
        queries = self.queries.rows(node)
        while len(nodes := self._promising(node, nodes)):
            head, nodes = nodes[:16], nodes[16:]
            leaves = [n for n in head.tolist() if not len(self.rows.children[n])]
            opened = [self.rows.children[n] for n in head.tolist() if len(self.rows.children[n])]
            if leaves:
                self._compare(queries, np.concatenate([self.rows.rows(n) for n in leaves]))
            nodes = np.concatenate([*opened, nodes]) if opened else nodes

    def _compare(self, queries: np.ndarray, rows: np.ndarray) -> None:
        self.compared += len(queries) * len(rows)
        step = max(1, _CELLS // len(queries))
        rows = rows[np.argsort(self.ids[rows])]  # so a later row of an equal score is seldom better
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            score = V.products(self.q[queries], self.x[part])
            least = self.worst(queries)
            full = (self.row[queries, -1] >= 0) & (self.score[queries, -1] == least)
            last = np.where(full, self.ids[self.row[queries, -1]], np.iinfo(np.int64).max)
            wanted = (score > least[:, None]) | ((score == least[:, None]) & (self.ids[part][None, :] <= last[:, None]))
            if wanted.sum() > 4 * self.k * len(queries) and len(part) > self.k + 1:
                kth = np.partition(score, len(part) - self.k - 1, axis=1)[:, len(part) - self.k - 1]  # one more, as a query's own row is among them
                wanted &= score >= kth[:, None]
            i, j = np.nonzero(wanted)
            other = self.ids[part[j]] != self.query_ids[queries[i]]
            i, j = i[other], j[other]
            old_i, old_j = np.nonzero(self.row[queries] >= 0)
            places = np.concatenate([self.row[queries][old_i, old_j], part[j]])
            which = np.concatenate([old_i, i])
            scores = np.concatenate([self.score[queries][old_i, old_j], score[i, j]])
            best = V.best_rows(which, scores, self.ids[places], self.k)
            which = which[best]
            rank = np.arange(len(which)) - np.searchsorted(which, which, side="left")
            self.row[queries[which], rank] = places[best]
            self.score[queries[which], rank] = scores[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, row ids, scores)."""
        i, j = np.nonzero(self.row >= 0)
        return self.query_ids[i], self.ids[self.row[i, j]], self.score[i, j]


@dataclass
class Groups:
    """Centres of the groups of rows, and the coarser group of queries each of them belongs to."""

    centres: np.ndarray
    asking: np.ndarray
    asking_centres: np.ndarray


def grouped(sample: np.ndarray, groups: int, asking_groups: int) -> Groups:
    """The upper nodes of a tree over the sample: the widest are opened first."""
    tree = build(sample, max(LEAF_POINTS, len(sample) // groups))

    def opened(start: list[int], most: int) -> list[int]:
        nodes = list(start)
        while True:
            able = [n for n in nodes if len(tree.children[n]) and len(nodes) - 1 + len(tree.children[n]) <= most]
            if not able:
                return nodes
            widest = max(able, key=lambda n: (tree.radius[n], -n))
            nodes.remove(widest)
            nodes += tree.children[widest].tolist()

    coarse = opened([0], asking_groups)
    fine, of = [], []
    share = max(1, groups // len(coarse))
    for a, n in enumerate(coarse):
        inner = opened([n], share)
        fine += inner
        of += [a] * len(inner)
    return Groups(tree.points[tree.centre[fine]], np.array(of), tree.points[tree.centre[coarse]])


def search(
    vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", groups: int = GROUPS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` (of column ``vec_id``) holds, against all others."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score long"
    rows, dim = V.whole_numbers(vectors, scale, vec_id, embedding)
    rows = keep(rows.withColumn("asks", F.coalesce(is_query, F.lit(False))), "whole-numbers")
    n, n_asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    if not n_asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chance = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = [bytes(r["v"]) for r in rows.where(chance < min(1.0, SAMPLE / n)).select("v").limit(2 * SAMPLE).collect()]
    sample = V.unpacked(pa.array(sample, pa.binary()), dim) if sample else np.zeros((1, dim), np.int64)
    made = grouped(sample, min(groups, max(1, n // 1024)), min(groups, -(-n_asks // query_block)))
    shared = spark.sparkContext.broadcast((made.centres, made.asking, made.asking_centres))

    def place(batches):
        centres, asking, asking_centres = shared.value
        for batch in batches:
            x = V.unpacked(batch.column("v"), dim).astype(np.float64)
            if not len(x):
                continue
            own = np.concatenate([distances(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
            far = np.sqrt(((x - centres[own]) ** 2).sum(axis=1))
            far_asking = np.sqrt(((x - asking_centres[asking[own]]) ** 2).sum(axis=1))
            columns = [pa.array(own, pa.int32()), pa.array(asking[own], pa.int32()), pa.array(far), pa.array(far_asking)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "asks")), *columns], names=["vec_id", "v", "asks", "group", "asking", "far", "far_asking"])

    placed = keep(rows.mapInArrow(place, "vec_id long, v binary, asks boolean, group int, asking int, far double, far_asking double"), "placed")
    sizes, radius = np.zeros(len(made.centres), np.int64), np.zeros(len(made.centres))
    for r in placed.groupBy("group").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
        sizes[r["group"]], radius[r["group"]] = r["n"], r["r"]
    asks, asks_radius = np.zeros(len(made.asking_centres), np.int64), np.zeros(len(made.asking_centres))
    for r in placed.where("asks").groupBy("asking").agg(F.count("*").alias("n"), F.max("far_asking").alias("r")).collect():
        asks[r["asking"]], asks_radius[r["asking"]] = r["n"], r["r"]
    most = bounds(made.asking_centres, asks_radius, made.centres, radius)

    def pairs_table(chosen: np.ndarray) -> DataFrame:
        at = [(int(g), int(a), int(-(-sizes[g] // row_block)), int(-(-asks[a] // query_block))) for a, g in np.argwhere(chosen) if sizes[g] and asks[a]]
        return spark.createDataFrame(at, "group int, asking int, row_parts long, query_parts long")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        done = Search(left.column("vec_id").to_numpy(), V.unpacked(left.column("v"), dim), right.column("query_id_q").to_numpy(), V.unpacked(right.column("q_q"), dim), k, right.column("floor_q").to_numpy())
        query, row, score = done.run().found()
        return pa.table({"query_id": query, "vec_id": row, "score": score})

    row_side = placed.select("vec_id", "v", "group")
    query_side = placed.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "asking")
    first = np.zeros(most.shape, bool)
    for a, line in enumerate(most):
        order = np.argsort(-line, kind="stable")
        before = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
        first[a, order[before < max(FIRST_ROWS, 2 * k)]] = True
    found = keep(V.top(V.in_blocks(row_side, query_side.withColumn("floor", F.lit(int(V.LEAST))), pairs_table(first), compare, out), k, ["query_id"]).drop("rank"), "found")
    kth = keep(found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("query_id", "least"), "kth")
    floors = query_side.join(kth, "query_id", "left").withColumn("floor", F.coalesce("least", F.lit(int(V.LEAST)))).drop("least")
    worst = np.full(len(asks), np.inf)
    for r in floors.groupBy("asking").agg(F.min("floor").alias("w")).collect():
        worst[r["asking"]] = r["w"]
    rest = ~first & (most >= worst[:, None])
    if rest.any():
        found = found.unionByName(V.in_blocks(row_side, floors, pairs_table(rest), compare, out))
    return V.top(found, k, ["query_id"]).select("query_id", "rank", "vec_id", "score")
