"""Words of whole texts as numpy arrays: positions, 64-bit hashes and hashes of runs of words.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. Texts come as Arrow string columns and are worked on in blocks of
about ``BLOCK_BYTES``; a text is never cut, so one longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE_BYTES = 0x9E3779B97F4A7C15
_BASE_RUNS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2 ** 64, for i from 0 to n."""
    kept = _powers.get(base)
    if kept is not None and len(kept[0]) > n:
        return kept[0][: n + 1], kept[1][: n + 1]
    size = max(n + 1, 1 << 16)
    made = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= 2 * BLOCK_BYTES:
        _powers[base] = (made[0], made[1])
    return made[0][: n + 1], made[1][: n + 1]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of ``values[i] * base ** i`` before each position, modulo 2 ** 64."""
    up, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from ``start`` up to ``end``, the same wherever the span stands."""
    _, down = powers(base, len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


@dataclass
class Block:
    """Some documents: ``data`` holds their bytes, document d those from ``cut[d]`` to ``cut[d + 1]``.

    Word w stands at ``start[w]:end[w]``; document d has the words from ``first[d]`` to ``first[d + 1]``.
    """

    data: np.ndarray
    cut: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        values = (_BYTE_VALUES[LOWER] if lower else _BYTE_VALUES)[self.data]
        return span_hashes(prefix_sums(values, _BASE_BYTES), _BASE_BYTES, self.start, self.end)

    def run_hashes(self, words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """Hash of the ``n`` words from each word on; only where all of them are in the block."""
        if len(words) < n:
            return np.zeros(0, np.uint64)
        at = np.arange(len(words) - n + 1)
        return span_hashes(prefix_sums(words, _BASE_RUNS[which]), _BASE_RUNS[which], at, at + n)

    def run_inside(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each word on belong to one document (as long as ``run_hashes``)."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))
        return left[: max(0, len(left) - n + 1)] >= n


def run_sums(words: np.ndarray, which: int = 0) -> tuple[np.ndarray, int]:
    return prefix_sums(words, _BASE_RUNS[which]), _BASE_RUNS[which]


def split(data: np.ndarray, cut: np.ndarray) -> Block:
    """The words of the documents that ``cut`` marks in ``data``."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    heads = cut[:-1][cut[:-1] < cut[1:]]
    begins[heads] = inside[heads]
    tails = cut[1:][cut[:-1] < cut[1:]] - 1
    stops[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Block(data, cut, start, end, np.searchsorted(start, cut))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, Block]]:
    """(first row, row after the last, their words) for blocks of whole documents of an Arrow batch."""
    texts = batch.column(column)
    if not len(texts):
        return
    data, offsets = buffers(texts)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, split(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
