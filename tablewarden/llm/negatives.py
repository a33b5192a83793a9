"""Hard negatives: rows of other labels whose score lies in a window below that of an anchor's positives.

Scores are inner products of whole numbers, from tiles of anchors and candidates that are multiplied by Strassen's recursion:
tiles are padded with zeros to even sides and halved, seven products of halves instead of eight are combined by additions of
64-bit whole numbers, down to ``BASE``. All of it is exact: additions that leave 64 bits come back to the right value, as all is
arithmetic modulo 2 ** 64, and a base tile is multiplied in double precision only where no sum can pass 2 ** 53. Where a true
score could leave 64 bits, the tile is of Python's whole numbers, and a score beyond is the nearest 64-bit number.

1. Positives: anchors meet rows of their own label only. Labels are dealt by hash into ``LABEL_GROUPS`` groups, hot ones are cut into
   blocks. Each task keeps the best ``n_positives`` of each anchor over its tiles, and these heaps are merged by a window.
2. Windows: for an anchor and a positive of score p, those negatives count whose score s has low * p <= 100 * s <= high * p. Each task
   keeps the best ``n_negatives`` of each window over its tiles, and these heaps are merged by a window too.

A positive below zero has an empty window, as low is under high. An anchor without positives gives no rows. See ``vectors`` for odd
vectors, repeated ids and rows without a label. Other columns, whatever their names, are not read. Nothing goes to the driver but
the numbers of rows by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import vectors as V
from tablewarden.llm.common import keep

BASE = 32
LABEL_GROUPS = 64
ANCHOR_BLOCK = 4096
ROW_BLOCK = 16384
TILE = (1024, 2048)


def even(x: np.ndarray) -> np.ndarray:
    """``x`` with a line of zeros more where a side is odd."""
    m, n = x.shape
    out = np.zeros((m + m % 2, n + n % 2), x.dtype)
    out[:m, :n] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, base: int = BASE) -> np.ndarray:
    """``a @ b`` of two int64 matrices modulo 2 ** 64, or of matrices of Python's whole numbers."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= base:
        if a.dtype == object:
            return a @ b if k else np.zeros((m, n), object)
        if V.largest(a) * V.largest(b) * k < 1 << 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = even(a), even(b)
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.zeros((2 * i, 2 * l), a.dtype)
    p = strassen(a11 + a22, b11 + b22, base)
    out[:i, :l] += p
    out[i:, l:] += p
    p = strassen(a21 + a22, b11, base)
    out[i:, :l] += p
    out[i:, l:] -= p
    p = strassen(a11, b12 - b22, base)
    out[:i, l:] += p
    out[i:, l:] += p
    p = strassen(a22, b21 - b11, base)
    out[:i, :l] += p
    out[i:, :l] += p
    p = strassen(a11 + a12, b22, base)
    out[:i, :l] -= p
    out[:i, l:] += p
    out[i:, l:] += strassen(a21 - a11, b11 + b12, base)
    out[:i, :l] += strassen(a12 - a22, b21 + b22, base)
    return out[:m, :n]


def tile_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, exact within 64 bits."""
    if V.largest(a) * V.largest(b) * a.shape[1] < 1 << 63:
        return strassen(a, np.ascontiguousarray(b.T))
    wide = strassen(a.astype(object), b.T.astype(object))
    return np.clip(wide, V.LEAST, np.iinfo(np.int64).max).astype(np.int64)


def tiles(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(places of the anchors, places of the rows, their scores), tile by tile."""
    for a in range(0, len(anchors), TILE[0]):
        for b in range(0, len(rows), TILE[1]):
            yield slice(a, min(a + TILE[0], len(anchors))), slice(b, min(b + TILE[1], len(rows))), tile_scores(anchors[a : a + TILE[0]], rows[b : b + TILE[1]])


class Heaps:
    """The ``k`` best rows of each of ``n`` owners so far; heaps of parts of the rows merge into those of all.

    Rows come in order of their ids, so a later row of an equal score is never better; ``bar`` is what a row must reach now.
    """

    def __init__(self, n: int, k: int):
        self.k = k
        self.owner, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bar = np.full(n, V.LEAST)

    def merge(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        self.owner, self.score, self.id = np.concatenate([self.owner, owner]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        best = V.best_rows(self.owner, self.score, self.id, self.k)
        self.owner, self.score, self.id = self.owner[best], self.score[best], self.id[best]
        rank = np.arange(len(best)) - np.searchsorted(self.owner, self.owner, side="left")
        full = rank == self.k - 1
        self.bar[self.owner[full]] = np.minimum(self.score[full], np.iinfo(np.int64).max - 1) + 1


def _narrowed(wanted: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of the wanted cells those that can be among the ``k`` best wanted ones of their line."""
    if wanted.sum() <= 8 * k * len(wanted) or wanted.shape[1] <= k:
        return wanted
    kth = np.partition(np.where(wanted, score, V.LEAST), -k, axis=1)[:, -k]
    return wanted & (score >= kth[:, None])


def positives_of(anchors: tuple[np.ndarray, np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> Heaps:
    """Heaps of the best rows of each anchor's label; both sides are (ids, labels, vectors)."""
    heaps = Heaps(len(anchors[0]), k)
    for a, b, score in tiles(anchors[2], rows[2]):
        wanted = (rows[1][None, b] == anchors[1][a, None]) & (rows[0][None, b] != anchors[0][a, None]) & (score >= heaps.bar[a, None])
        i, j = np.nonzero(_narrowed(wanted, score, k))
        heaps.merge(i + a.start, score[i, j], rows[0][b][j])
    return heaps


def negatives_of(
    anchors: tuple[np.ndarray, np.ndarray], windows: tuple[np.ndarray, np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int
) -> Heaps:
    """Heaps of the best rows of each window (anchor's place, lowest, highest score); anchors are (labels, vectors)."""
    owner, low, high = windows
    heaps = Heaps(len(owner), k)
    n = len(anchors[0])
    lowest, highest = np.full(n, np.iinfo(np.int64).max), np.full(n, V.LEAST)
    np.minimum.at(lowest, owner, low)
    np.maximum.at(highest, owner, high)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(n + 1))
    most = int(np.diff(first).max(initial=0))
    for a, b, score in tiles(anchors[1], rows[2]):
        i, j = np.nonzero((score >= lowest[a, None]) & (score <= highest[a, None]) & (rows[1][None, b] != anchors[0][a, None]))
        found, ids = score[i, j], rows[0][b][j]
        begin, end = first[i + a.start], first[i + a.start + 1]
        owners, hits = [], []
        for t in range(most):  # the windows of an anchor, one after the other
            live = np.flatnonzero(begin + t < end)
            w = order[begin[live] + t]
            inside = (found[live] >= np.maximum(low[w], heaps.bar[w])) & (found[live] <= high[w])
            owners.append(w[inside])
            hits.append(live[inside])
        if owners:
            hit = np.concatenate(hits)
            heaps.merge(np.concatenate(owners), found[hit], ids[hit])
        lowest = _raised(lowest, owner, low, heaps)
    return heaps


def _raised(lowest: np.ndarray, owner: np.ndarray, low: np.ndarray, heaps: Heaps) -> np.ndarray:
    """The lowest score that any window of each anchor still takes."""
    out = np.full(len(lowest), np.iinfo(np.int64).max)
    np.minimum.at(out, owner, np.maximum(low, heaps.bar))
    return out


def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` speaks of column ``vec_id``."""
    spark = vectors.sparkSession
    rows, dim = V.whole_numbers(vectors, scale, vec_id, embedding, label)
    group = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")
    rows = keep(rows.withColumn("anchor", F.coalesce(is_anchor, F.lit(False))).withColumn("group", group), "whole-numbers")
    anchors = rows.where("anchor").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), F.col("v").alias("q"), F.col("group").alias("asking"))
    held = {r["group"]: (r["n"], r["a"]) for r in rows.groupBy("group").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).collect()}
    total, n_anchors = sum(n for n, _ in held.values()), sum(a for _, a in held.values())
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def parts(n: int, most: int) -> int:
        return max(1, -(-n // most))

    pairs = "group int, asking int, row_parts long, query_parts long"
    own = spark.createDataFrame([(g, g, parts(n, row_block), parts(a, anchor_block)) for g, (n, a) in held.items() if a], pairs)

    def block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids)
        return ids[order], table.column("label").to_numpy()[order], V.unpacked(table.column("v"), dim)[order]

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("query_id_q").to_numpy()
        heaps = positives_of((ids, right.column("own_q").to_numpy(), V.unpacked(right.column("q_q"), dim)), block(left), n_positives)
        return pa.table({"anchor_id": ids[heaps.owner], "vec_id": heaps.id, "score": heaps.score})

    side = rows.select("vec_id", "label", "v", "group")
    found = V.in_blocks(side, anchors, own, best_positives, "anchor_id long, vec_id long, score long")
    positives = V.top(found, n_positives, ["anchor_id"]).drop("rank")
    # the window in whole numbers, without products that leave 64 bits: low * p <= 100 * s <= high * p
    bounded = positives.where("score >= 0").select(
        F.col("anchor_id").alias("query_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"{low}L * (score div 100) + ({low}L * (score % 100) + 99) div 100").alias("low"), F.expr(f"{high}L * (score div 100) + {high}L * (score % 100) div 100").alias("high"),
    )
    windows = bounded.groupBy("query_id").agg(F.collect_list(F.struct("positive_id", "positive_score", "low", "high")).alias("w"))  # n_positives at most
    asking = keep(anchors.join(windows, "query_id").select("query_id", "own", "q", "w"), "windows").withColumn("asking", F.lit(0))
    every = spark.createDataFrame([(0, 0, parts(total, max(1024, min(row_block, total // 32))), parts(n_anchors, anchor_block))], pairs)

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, lists = right.column("query_id_q").to_numpy(), right.column("w_q").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
        inner = lists.flatten()
        positive_id, positive_score, least, most = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("positive_id", "positive_score", "low", "high"))
        heaps = negatives_of((right.column("own_q").to_numpy(), V.unpacked(right.column("q_q"), dim)), (owner, least, most), block(left), n_negatives)
        w = heaps.owner
        return pa.table({"anchor_id": ids[owner[w]], "positive_id": positive_id[w], "positive_score": positive_score[w], "negative_id": heaps.id, "negative_score": heaps.score})

    mined = V.in_blocks(side.withColumn("group", F.lit(0)), asking, every, best_negatives, schema)
    best = V.top(mined, n_negatives, ["anchor_id", "positive_id"], "negative_score", "negative_id")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
