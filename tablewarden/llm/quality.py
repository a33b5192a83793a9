"""Quality rules on documents, with verdicts on whole hosts from the rates at which their documents fail.

Rule failures are counted by host. A host with few documents says little by itself, so its rate is shrunk towards a beta
prior whose mean and strength come from all hosts (method of moments). Hosts whose shrunk rate of failing any rule passes
``host_limit`` are rejected with all their documents. Only the counts of each host are shuffled, never texts.

Null and empty texts have no words and fail; a null host is nobody's host and is judged by documents alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import words as W
from tablewarden.llm.common import keep, short_batches

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_doc(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[cut[1:]] - sums[cut[:-1]]


def _again(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries ordered by owner: whether an owner's key is there twice or more, and whether it is not its first."""
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (owner[order][1:] == owner[order][:-1]) & (key[order][1:] == key[order][:-1])
    twice, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def block_counts(block: W.Block) -> dict[str, np.ndarray]:
    """The counts of each document of a block."""
    n_docs, data, cut = len(block.cut) - 1, block.data, block.cut
    lead = (data & 0xC0) != 0x80
    out = {
        "n_words": block.counts,
        "word_chars": _per_doc(lead & ~W.SPACE[data], cut),
        "n_symbols": _per_doc(_SYMBOL[data], cut),
    }
    breaks = np.flatnonzero(data == 0x0A)
    owner = np.searchsorted(cut, breaks, side="right") - 1
    start = np.concatenate([cut[:-1], breaks + 1])
    end = np.concatenate([breaks, cut[1:]])
    line_doc = np.sort(np.concatenate([np.arange(n_docs), owner]))
    start, end = np.sort(start), np.sort(end)  # lines follow one another, so the k-th start and end belong together
    inked = np.concatenate([[0], np.cumsum(~W.SPACE[data], dtype=np.int64)])
    real = inked[end] > inked[start]
    start, end, line_doc = start[real], end[real], line_doc[real]
    sums = W.prefix_sums(W._BYTE_VALUES[data], W._BASE_BYTES)
    _, later = _again(line_doc, W.span_hashes(sums, W._BASE_BYTES, start, end))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs).astype(np.int64)
    whole = block.run_inside(3)
    word_doc = block.doc_of_word()
    at = np.flatnonzero(whole)
    twice, _ = _again(word_doc[at], block.run_hashes(block.hashes(), 3)[at])
    marks = np.zeros(len(word_doc) + 3, np.int64)
    hit = at[twice]
    for k in range(3):
        marks[hit + k] = 1
    out["n_repeat_words"] = np.bincount(word_doc[marks[: len(word_doc)] > 0], minlength=n_docs).astype(np.int64)
    return out


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns ``__n_words`` ... ``__n_repeat_words`` (long)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, block in W.blocks(batch, text):
                counts = block_counts(block)
                part = batch.slice(a, z - a)
                names = [n for n in part.schema.names if keep_text or n != text]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)],
                    names=[*names, *(f"__{c}" for c in COUNTS)],
                )

    fields = [f for f in docs.schema if keep_text or f.name != text]
    schema = docs.select(*[docs[f"`{f.name}`"] for f in fields]).schema
    for c in COUNTS:
        schema = schema.add(f"__{c}", "long")
    return short_batches(docs).mapInArrow(make, schema)


def rules() -> dict[str, Column]:
    """The document rules, over the columns of ``with_counts``; true where a document fails."""
    return {
        "few_words": F.col("__n_words") < MIN_WORDS,
        "repeated_words": 100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"),
    }


def any_rule() -> Column:
    failed = F.lit(False)
    for rule in rules().values():
        failed = failed | rule
    return failed


def host_rates(counted: DataFrame, host: str = "source") -> DataFrame:
    """Per host: documents, failures of each rule and of any, and the shrunk rate of the latter.

    With n documents, f failures and a prior of mean m and strength s the rate is (f + m s) / (n + s). The strength is
    m (1 - m) / v - 1 for the variance v between hosts beyond what chance gives hosts of their sizes, from 1 to 1,000.
    """
    aggs = [F.count("*").alias("n"), F.sum(any_rule().cast("long")).alias("failed")]
    aggs += [F.sum(rule.cast("long")).alias(name) for name, rule in rules().items()]
    hosts = keep(counted.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(*aggs), "hosts")
    rate = F.col("failed") / F.col("n")
    whole = hosts.agg(
        (F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("chance")
    ).first()
    mean = whole["m"] or 0.0
    spread = max((whole["v"] or 0.0) - mean * (1 - mean) * (whole["chance"] or 0.0), 1e-12)
    strength = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1))
    return hosts.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("n") + strength))


def judge(docs: DataFrame, host: str = "source", text: str = "text", host_limit: float = HOST_LIMIT) -> DataFrame:
    """All columns but the text, the counts, ``__base_failed``, ``__host_rate`` (null without a host) and ``__kept``."""
    counted = keep(with_counts(docs, text, keep_text=False).withColumn("__base_failed", any_rule()), "quality")
    rates = keep(host_rates(counted, host).select(F.col("host").alias("__host"), F.col("rate").alias("__host_rate")), "rates")
    bad = F.coalesce(F.col("__host_rate") > host_limit, F.lit(False))
    joined = counted.join(rates, counted[f"`{host}`"] == rates["__host"], "left").drop("__host")
    return joined.withColumn("__kept", ~F.col("__base_failed") & ~bad)


def filter_documents(docs: DataFrame, host: str = "source", text: str = "text", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{host}`").alias("source"), F.col(f"`{text}`").alias("text"))
    counted = with_counts(whole.select("source", "text"), keep_text=False)
    rejected = keep(host_rates(counted).where(F.col("rate") > host_limit).select(F.col("host").alias("rejected")), "rejected")
    passed = with_counts(whole, keep_text=False).where(~any_rule())
    return passed.join(rejected, passed["source"] == rejected["rejected"], "left_anti").select("doc.*")
