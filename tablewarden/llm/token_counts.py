"""Token counts of documents in flat token files that have no index, by a scan for the end-of-document id.

A token file is ids as little-endian unsigned 16-bit integers, each document followed by the end id, and nothing else.
Files are read as they are and cut into blocks of ``BLOCK_TOKENS``; every block is searched at once and gives the places
of its end ids. A document may begin blocks (or files) before the one where it ends, so what stands behind the last end
id of each block is carried on: a prefix scan over the blocks of a file, then over the files in the order of their
names, two steps so that no task sees all blocks. A file is one row while it is read, so files must stay under 2 GB; the writer
makes one for each input partition.

Tokens behind the last end id of all are a document of their own (``closed`` false). An empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.llm import tokens
from tablewarden.llm import words as W
from tablewarden.llm.common import keep, scratch

BLOCK_TOKENS = 1 << 18


def write_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, text: str = "text") -> None:
    """One flat file for each partition of ``docs`` under ``path``, by Spark's own writer: it ends every row with the two
    bytes of the end id. Strings that spell special tokens are ordinary text, so the end id marks ends only."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mem = tokens.memory(tokenizer, plain_specials=True)
        for batch in batches:
            for _, _, block in W.blocks(batch, "text"):
                ids, cut = tokens.encode_block(block, mem)
                raw = ids.astype("<u2")
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((cut * 2).astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([rows.cast(pa.binary())], names=["ids"])

    mark = int(end_id).to_bytes(2, "little").decode("latin-1")
    flat = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(make, "ids binary")
    flat.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", mark).text(path)


def scan_blocks(spark: SparkSession, path: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each block: file, block, tokens, the places of its end ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    size = 2 * block_tokens
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("content") / size).cast("int") - 1))
    cut = files.select("path", "content", F.explode(starts).alias("block"))
    cut = cut.select("path", "block", F.expr(f"substring(content, block * {size} + 1, {size})").alias("bytes"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, raws = batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("bytes")
            for i in range(len(batch)):
                ids = np.frombuffer(raws[i].as_buffer(), "<u2")
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i]]), pa.array([numbers[i]], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", "n", "ends"],
                )

    return cut.mapInArrow(make, "file string, block int, n long, ends array<long>")


def count_tokens(spark: SparkSession, path: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) for each document, by the file where it ends.

    ``ordinal`` counts the ends in that file from 0, ``n_tokens`` leaves the end id out, and ``start`` is the document's
    first token in the whole stream of files.
    """
    blocks = keep(scan_blocks(spark, path, end_id, block_tokens), "token-blocks")
    last = F.expr("ends[size(ends) - 1]")
    summary = blocks.select("file", "block", "n", F.size("ends").alias("n_ends"), F.when(F.size("ends") > 0, last).alias("last"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = summary.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    at = at.withColumn("ends_before", F.coalesce(F.sum("n_ends").over(order), F.lit(0)))
    at = at.withColumn("opened", F.max(F.col("before") + F.col("last") + 1).over(order))
    files = at.groupBy("file").agg(F.sum("n").alias("file_n"), F.max(F.col("before") + F.col("last") + 1).alias("file_opened"))
    stream = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("base", F.coalesce(F.sum("file_n").over(stream), F.lit(0)))
    files = files.withColumn("file_carry", F.coalesce(F.max(F.col("base") + F.col("file_opened")).over(stream), F.lit(0)))
    files = keep(files, "token-files")
    carried = at.join(files.select("file", "base", "file_carry"), "file").select(
        "file", "block", "ends_before", (F.col("base") + F.col("before")).alias("base"),
        F.coalesce(F.col("base") + F.col("opened"), F.col("file_carry")).alias("carry"),
    )
    found = blocks.join(carried, ["file", "block"]).where(F.size("ends") > 0)
    previous = "if(i = 0, carry, base + ends[i - 1] + 1)"
    rows = f"transform(ends, (e, i) -> struct(ends_before + i AS ordinal, {previous} AS start, base + e - {previous} AS n_tokens))"
    closed = found.select("file", F.explode(F.expr(rows)).alias("d")).select("file", "d.*", F.lit(True).alias("closed"))
    whole = files.agg(F.max("file").alias("file"), F.max(F.col("base") + F.col("file_n")).alias("stop"), F.coalesce(F.max(F.col("base") + F.col("file_opened")), F.lit(0)).alias("start"))
    rest = whole.where(F.col("stop") > F.col("start")).select(
        "file", F.lit(None).cast("long").alias("ordinal"), "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(rest)


def document_counts(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Flat files of ``docs`` and their scan, the counts given back to the ids: (doc_id, part, ordinal, start, n_tokens).

    ``docs`` must be a scan of stored files: Spark deals those out alike each time, so the k-th end id of file p belongs
    to the k-th row of partition p. That the numbers of both agree for every file is checked.
    """
    spark = docs.sparkSession
    path = scratch(spark, "token-stream")
    write_files(docs, tokenizer, end_id, path, text)
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("part")
    counts = keep(count_tokens(spark, path, end_id).where("closed").select(part, "ordinal", "start", "n_tokens"), "token-counts")
    number = F.monotonically_increasing_id()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND((1 << 33) - 1).alias("ordinal"))
    rows = keep(rows, "token-rows")
    there = rows.groupBy("part").agg(F.count("*").alias("n")).join(counts.groupBy("part").agg(F.count("*").alias("m")), "part", "full")
    if there.where("not (n <=> m)").limit(1).count():
        raise RuntimeError("the input was not dealt out alike twice; store it first")
    return rows.join(counts, ["part", "ordinal"]).select("doc_id", "part", "ordinal", "start", "n_tokens")
