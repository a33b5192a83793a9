"""Language identification by prediction by partial matching (method C, order 3) with frozen statistics.

For each language a context tree holds how often each byte followed each context of up to three bytes. A byte seen in its
longest known context costs -log2(n / (total + kinds)) bits; otherwise the escape costs -log2(kinds / (total + kinds)) and
the next shorter context is asked, down to all 256 bytes alike. The statistics don't change while a text is coded, so the
cost of a byte depends on it and the three bytes before alone, and texts are coded by table look-ups on whole blocks.
The language with the shortest code wins; the score is its share when every language's chance is 2 ** -bits, per byte
above ``SCORE_BYTES`` so that long texts don't all end at 1.

The trees are learnt from a bounded sample: whole training texts by a hash of their bytes, about ``FIT_BYTES`` in all, in
equal parts for each language. All A-Z are lower-cased. Texts that are null or without a letter are ``und`` with score 0.
Without any training text every text is ``und``. Ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import words as W
from tablewarden.llm.common import fresh_name

ORDER = 3
FIT_BYTES = 8_000_000
SCORE_BYTES = 200


def grams(data: np.ndarray, cut: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, as one number; bytes before a text's start count as line breaks."""
    low = W.LOWER[data].astype(np.uint32)
    place = np.arange(len(data)) - np.repeat(cut[:-1], np.diff(cut))
    out = low.copy()
    for k in range(1, order + 1):
        before = np.full(len(data), 0x0A, np.uint32)
        before[k:] = low[:-k] if k < len(low) else low[:0]
        before[place < k] = 0x0A
        out |= before << np.uint32(8 * k)
    return out


def learn(sample: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, order, gram, n) over the texts of ``sample``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("lang").to_pylist()
            for a, z, block in W.blocks(batch, "text"):
                full = grams(block.data, block.cut, ORDER)
                owner = np.repeat(np.array(codes[a:z], object), np.diff(block.cut))
                for name in sorted(set(codes[a:z])):
                    g, n = np.unique(full[owner == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(make, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Code lengths in bits, one column for each language.

    ``cost[k]`` has those of grams of order k whose keys are in ``key[k]``, escapes included; ``escape[k]`` those of
    leaving a context of k bytes (0 where a language does not know it), for the contexts in ``context[k]``.
    """

    langs: list[str]
    key: list[np.ndarray]
    cost: list[np.ndarray]
    context: list[np.ndarray]
    escape: list[np.ndarray]

    def bits(self, full: np.ndarray) -> np.ndarray:
        """Bits of each byte, given with its context, in each language."""
        return self._bits(full, ORDER)

    def _bits(self, gram: np.ndarray, order: int) -> np.ndarray:
        if order < 0:
            return np.full((len(gram), len(self.langs)), 8.0, np.float32)
        where, known = _find(self.key[order], gram)
        out = np.empty((len(gram), len(self.langs)), np.float32)
        out[known] = self.cost[order][where[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            fewer = gram[rest] & np.uint32((1 << (8 * order)) - 1) if order else gram[rest] & np.uint32(0)
            lower = self._bits(fewer, order - 1)
            at, there = _find(self.context[order], gram[rest] >> np.uint32(8))
            lower[there] += self.escape[order][at[there]]
            out[rest] = lower
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def freeze(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of grams of the highest order and their numbers, by language."""
    model = Model(langs, [], [], [], [])
    for order in range(ORDER + 1):
        own = []
        for lang in langs:
            gram, n = counts[lang]
            key, back = np.unique(gram & np.uint32((1 << (8 * (order + 1))) - 1), return_inverse=True)
            own.append((key, np.bincount(back, weights=n, minlength=len(key))))
        keys = np.unique(np.concatenate([k for k, _ in own]))
        contexts = np.unique(keys >> np.uint32(8))
        cost = np.empty((len(keys), len(langs)), np.float32)
        escape = np.zeros((len(contexts), len(langs)), np.float32)
        shorter = keys & np.uint32((1 << (8 * order)) - 1) if order else keys & np.uint32(0)
        base = model._bits(shorter, order - 1) if order else np.full((len(keys), len(langs)), 8.0, np.float32)
        of_key = np.searchsorted(contexts, keys >> np.uint32(8))
        for j, (key, n) in enumerate(own):
            at = np.searchsorted(contexts, key >> np.uint32(8))
            total, kinds = np.bincount(at, weights=n, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape[:, j] = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0)
                seen = -np.log2(n / (total + kinds)[at])
            cost[:, j] = base[:, j] + escape[of_key, j]
            cost[np.searchsorted(keys, key), j] = seen
        model.key.append(keys.astype(np.uint32))
        model.cost.append(cost)
        model.context.append(contexts.astype(np.uint32))
        model.escape.append(escape)
    return model


def fit(training: DataFrame, lang: str = "lang", text: str = "text", fit_bytes: int = FIT_BYTES) -> Model:
    """A model of the languages of ``training``; its size is bounded by ``fit_bytes``."""
    known = training.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    sizes = {r["lang"]: r["b"] for r in known.groupBy(F.col(f"`{lang}`").alias("lang")).agg(F.sum(F.octet_length(f"`{text}`")).alias("b")).collect()}
    langs = sorted(k for k, b in sizes.items() if b)
    if not langs:
        return Model([], [], [], [], [])
    share = F.lit(0.0)
    for name in langs:
        share = F.when(F.col(f"`{lang}`") == name, fit_bytes / len(langs) / sizes[name]).otherwise(share)
    chance = F.pmod(F.xxhash64(f"`{text}`"), F.lit(1 << 20)) / float(1 << 20)
    found = learn(known.where(chance < share), lang, text).toPandas()
    counts = {}
    for name in langs:
        part = found[found["lang"] == name]
        counts[name] = (part["gram"].to_numpy(np.int64).astype(np.uint32), part["n"].to_numpy(np.float64))
    return freeze(langs, counts)


class Coder:
    """A model with the costs of known grams laid out for quick look-ups by a hash of the gram."""

    def __init__(self, model: Model):
        self.model = model
        key = model.key[ORDER]
        self.shift = np.uint32(32 - max(10, int(2 * max(1, len(key)) - 1).bit_length() + 1))
        slot = self._slot(key)
        self.key = np.zeros(1 << (32 - int(self.shift)), np.uint32)
        self.row = np.full(len(self.key), -1, np.int32)
        self.key[slot], self.row[slot] = key, np.arange(len(key))

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint32(2654435769)) >> self.shift

    def totals(self, data: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        gram = grams(data, cut, ORDER)
        slot = self._slot(gram)
        row = self.row[slot]
        hit = (self.key[slot] == gram) & (row >= 0)
        bits = np.empty((len(gram), len(self.model.langs)), np.float32)
        bits[hit] = self.model.cost[ORDER][row[hit]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            kinds, back = np.unique(gram[rest], return_inverse=True)
            bits[rest] = self.model.bits(kinds)[back]
        sums = np.zeros((len(gram) + 1, bits.shape[1]))
        np.cumsum(bits, axis=0, dtype=np.float64, out=sums[1:])
        return sums[cut[1:]] - sums[cut[:-1]]


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` without the text, with the language found and its score; columns that have these names already are replaced."""
    spark = docs.sparkSession
    # bounded by fit_bytes; lists and arrays alone, so workers need not find the class to read them
    shared = spark.sparkContext.broadcast((model.langs, model.key, model.cost, model.context, model.escape))
    has_langs = bool(model.langs)
    others = [c for c in docs.columns if c.lower() not in (text.lower(), pred.lower(), score.lower())]
    source, has_letter = fresh_name(others, "text"), fresh_name(others, "has_letter")
    letter_of = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    with_letter = docs.select(*[f"`{c}`" for c in others], F.col(f"`{text}`").alias(source), letter_of.alias(has_letter))
    kept: list[Coder] = []

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Coder(Model(*shared.value)) if has_langs else None)
        coder = kept[0]
        for batch in batches:
            for a, z, block in W.blocks(batch, source):
                part = batch.slice(a, z - a)
                letter = part.column(has_letter).to_numpy(zero_copy_only=False)
                names, values = np.full(z - a, "und", object), np.zeros(z - a)
                if coder is not None:
                    bits = coder.totals(block.data, block.cut)
                    size = np.maximum(1, np.diff(block.cut))
                    bits = bits * np.minimum(1.0, SCORE_BYTES / size)[:, None]
                    best = bits.argmin(axis=1)
                    chance = 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1)
                    names = np.where(letter, np.array(coder.model.langs, object)[best], "und")
                    values = np.where(letter, chance, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(names, pa.string()), pa.array(values)], names=[*others, pred, score]
                )

    schema = docs.select(*[f"`{c}`" for c in others]).schema.add(pred, "string").add(score, "double")
    return with_letter.mapInArrow(make, schema)
