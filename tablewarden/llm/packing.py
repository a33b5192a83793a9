"""Packing tokenised documents into sequences of at most ``capacity`` tokens: large items matched, small ones best fit.

A document's tokens are its ids and one end id. Longer documents are cut into full pieces and a rest; nothing else is
cut. Only the numbers of pieces by length matter for the packing, at most ``capacity`` of them, so the plan is made from
that histogram: pieces above a third of the capacity are matched greedily, the largest with the largest that fits, at
most two to a bin; the other pieces, the largest first, go where they leave the smallest gap, and into new bins when none
has room. The plan is a list of runs (so many equal pieces at this offset of these bins) of a length bounded by the
capacity, whatever the number of documents. Pieces then find their place by their rank among those of their length,
counted within salted groups and carried on by the groups' sums, so that no length is gathered in one task.

Null and empty texts are one end id. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm import tokens
from tablewarden.llm import words as W
from tablewarden.llm.common import keep, short_batches

CAPACITY = 2048
ROWS_PER_GROUP = 50_000
LEAST_SALTS = 64


@dataclass
class Bins:
    """``count`` equal bins: runs of (length, how many) from offset 0 on."""

    count: int
    used: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """Bins for ``histogram[length]`` pieces of each length."""
    left = {n: c for n, c in histogram.items() if c}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    done: list[Bins] = []
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= n and m + n <= capacity and left[m] > (m == n)), None)
            if partner is None:
                done.append(Bins(left[n], n, [(n, 1)]))
                left[n] = 0
            elif partner == n:
                pairs = left[n] // 2
                done.append(Bins(pairs, 2 * n, [(n, 2)]))
                left[n] -= 2 * pairs
            else:
                pairs = min(left[n], left[partner])
                done.append(Bins(pairs, n + partner, [(n, 1), (partner, 1)]))
                left[n] -= pairs
                left[partner] -= pairs
    by_gap: dict[int, list[Bins]] = {}
    for b in done:
        by_gap.setdefault(capacity - b.used, []).append(b)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            gap = next((g for g in range(n, capacity + 1) if by_gap.get(g)), None)
            if gap is None:
                per = min(capacity // n, todo)
                bins = max(1, todo // (capacity // n))
                made = Bins(bins, n * per, [(n, per)])
                by_gap.setdefault(capacity - made.used, []).append(made)
                todo -= bins * per
                continue
            b = by_gap[gap].pop()
            per = min(gap // n, todo)  # after one piece its own gap is the smallest, as long as another fits
            bins = min(b.count, max(1, todo // per))
            if bins < b.count:
                by_gap[gap].append(Bins(b.count - bins, b.used, list(b.runs)))
            full = Bins(bins, b.used + per * n, [*b.runs, (n, per)])
            by_gap.setdefault(capacity - full.used, []).append(full)
            todo -= bins * per
    return [b for bins in by_gap.values() for b in bins]


def plan_runs(bins: list[Bins]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces in a bin, first bin, offset), ordered by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    first_bin = 0
    for b in bins:
        offset = 0
        for length, per in b.runs:
            out.setdefault(length, []).append((rank.get(length, 0), per, first_bin, offset))
            rank[length] = rank.get(length, 0) + per * b.count
            offset += length * per
        first_bin += b.count
    return {k: np.array(v, np.int64) for k, v in out.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of each document: ``PIECES``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mem = tokens.memory(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for a, z, block in W.blocks(batch, "text"):
                ids, cut = tokens.encode_block(block, mem)
                raw = ids.astype("<u4")
                rows: list[tuple[int, int, int, int]] = []
                for d in range(z - a):
                    own = np.concatenate([raw[cut[d] : cut[d + 1]], end])
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((a + d, k, at, len(part), zlib.crc32(part.tobytes())))
                table = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, c]) for c in (2, 3, 4))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
            pa.default_memory_pool().release_unused()  # or each worker keeps what its largest batch took

    return short_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(make, PIECES)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` must be kept (it is read three times)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = plan_runs(plan_bins(histogram, capacity))
    salts = max(LEAST_SALTS, max(histogram.values(), default=0) // ROWS_PER_GROUP)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(groups, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[group[0]])
                run = runs[n]
                at = run[np.searchsorted(run[:, 0], rank[group], side="right") - 1]
                inside = rank[group] - at[:, 0]
                sequence[group] = at[:, 2] + inside // at[:, 1]
                offset[group] = at[:, 3] + inside % at[:, 1] * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(find, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return place(keep(cut_pieces(docs, tokenizer, end_id, capacity, text, doc_id), "pieces"), capacity)
