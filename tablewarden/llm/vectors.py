"""Vectors of whole numbers for exact searches: packing, exact products, best rows of each query, and blocks of rows to compare.

A component x becomes floor(scale * x) in double precision; beyond 64 bits it is the nearest 64-bit number. Vectors shorter than
the longest one are filled up with zeros, so an empty one scores zero everywhere. Null vectors, those with null or non-finite
components, and rows without an id take no part. Of rows that share an id one is taken, the same in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = np.iinfo(np.int64).min
_WIDTHS = (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", None))


def whole_numbers(vectors: DataFrame, scale: int, vec_id: str, embedding: str, label: str | None = None) -> tuple[DataFrame, int]:
    """((vec_id, v) or (vec_id, label, v), length of the longest vector); rows without a label take no part where one is asked for."""
    columns = [F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("e")]
    columns += [F.col(f"`{label}`").cast("long").alias("label")] if label else []
    rows = vectors.select(*columns).where("vec_id is not null and e is not null" + (" and label is not null" if label else ""))
    rows = rows.where("not exists(e, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    dim = rows.agg(F.max(F.size("e")).alias("d")).first()["d"] or 0
    names = ["vec_id", "label", "v"] if label else ["vec_id", "v"]

    def pack(batches):
        for batch in batches:
            lists = batch.column("e")
            sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
            x = np.zeros((len(lists), dim))
            x[np.arange(dim)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
            n = np.where(x >= 2.0**63, np.iinfo(np.int64).max, np.where(x < -(2.0**63), LEAST, x).astype(np.int64, casting="unsafe"))
            columns = [batch.column(c) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed(n), pa.binary())], names=names)

    schema = ", ".join(f"{c} {'binary' if c == 'v' else 'long'}" for c in names)
    made = rows.mapInArrow(pack, schema)
    rest = names[1:]
    once = made.groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("s"))
    return once.select("vec_id", *[F.col(f"s.{c}").alias(c) for c in rest]), dim


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 or 8 bytes a component."""
    if not x.shape[1]:
        return [b""] * len(x)
    out: list[bytes] = [b""] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    done = np.zeros(len(x), bool)
    for dtype, limit in _WIDTHS:
        fits = ~done if limit is None else ~done & (low >= -limit) & (high < limit)
        done |= fits
        for i, row in zip(np.flatnonzero(fits).tolist(), x[fits].astype(dtype), strict=True):
            out[i] = row.tobytes()
    return out


def unpacked(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The int64 rows of a packed column."""
    blobs = column.to_pylist()
    out = np.zeros((len(blobs), dim), np.int64)
    if not dim or not blobs:
        return out
    size = np.array([len(b) for b in blobs]) // dim
    for dtype, _ in _WIDTHS:
        at = np.flatnonzero(size == np.dtype(dtype).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join([blobs[i] for i in at.tolist()]), dtype).reshape(-1, dim)
    return out


def largest(x: np.ndarray) -> int:
    """The largest absolute value, as a Python number."""
    return max(-int(x.min()), int(x.max())) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and of ``b``, exact; beyond 64 bits the nearest 64-bit number.

    Doubles are exact as long as no sum passes 2 ** 53.
    """
    bound = largest(a) * largest(b) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, np.iinfo(np.int64).max).astype(np.int64)


def best_rows(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best, the highest score first, ties by smaller id; ordered by query."""
    order = np.lexsort((ids, ~score, query))
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def top(found: DataFrame, k: int, group: list[str], score: str = "score", ids: str = "vec_id") -> DataFrame:
    """The ``k`` best rows of each group with their ``rank``."""
    best = Window.partitionBy(*group).orderBy(F.desc(score), ids)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def in_blocks(rows: DataFrame, queries: DataFrame, pairs: DataFrame, compare, schema: str) -> DataFrame:
    """``compare(rows, queries)`` for blocks of both sides of each pair of groups.

    ``rows`` has the columns group and vec_id, ``queries`` asking and query_id; ``pairs`` (group, asking, row_parts,
    query_parts) is a bounded table. Hot groups are cut by a hash of the id, so a block has a bounded number of rows.
    """
    left = rows.join(F.broadcast(pairs), "group").withColumn("row_part", F.pmod(F.xxhash64("vec_id"), "row_parts"))
    left = left.withColumn("query_part", F.explode(F.expr("sequence(0L, query_parts - 1)"))).drop("row_parts", "query_parts")
    asked = queries.toDF(*queries.columns)  # the same table may be on both sides
    right = asked.join(F.broadcast(pairs.toDF(*pairs.columns)), "asking").withColumn("query_part", F.pmod(F.xxhash64("query_id"), "query_parts"))
    right = right.withColumn("row_part", F.explode(F.expr("sequence(0L, row_parts - 1)"))).drop("row_parts", "query_parts")
    right = right.toDF(*[f"{c}_q" for c in right.columns])
    keys = ["group", "asking", "row_part", "query_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_q" for c in keys])).applyInArrow(compare, schema)
