"""Distinct word shingles of documents and their segment signatures, block by block in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from tablewarden.llm import words as W

_SCHEME, _SEGMENT, _DROPPED = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xDB4F0B9175AE2165), np.uint64(0xA24BAED4963EE407)
_PARITY = np.uint64(0x9FB21C651E98DF25)


@dataclass
class Sets:
    """Documents' sets: document d has the distinct shingles ``item[cut[d]:cut[d + 1]]``, ascending."""

    item: np.ndarray
    cut: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.cut)


def shingle_sets(block: W.Block, width: int = 4) -> Sets:
    """Distinct ``width``-word shingles, A-Z lower-cased; a shorter document's words together are its one shingle."""
    hashes = block.hashes(lower=True)
    doc = block.doc_of_word()
    whole = block.run_inside(width)
    item, owner = block.run_hashes(hashes, width)[whole], doc[: len(whole)][whole]
    short = np.flatnonzero((block.counts > 0) & (block.counts < width))
    if len(short):
        sums, base = W.run_sums(hashes)
        item = np.concatenate([item, W.span_hashes(sums, base, block.first[short], block.first[short + 1])])
        owner = np.concatenate([owner, short])
    order = np.argsort(item, kind="stable")
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    item, owner = item[order], owner[order]
    fresh = np.ones(len(item), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
    item, owner = item[fresh], owner[fresh]
    return Sets(item, np.searchsorted(owner, np.arange(len(block.first))))


def group_sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums modulo 2 ** 64 of the values in each stretch."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[cut[1:]] - sums[cut[:-1]]


def set_keys(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each whole set."""
    return group_sums(W.mix(sets.item), sets.cut), group_sums(W.mix(sets.item ^ _DROPPED), sets.cut)


def parities(sets: Sets) -> list[bytes]:
    """For each set a row of bits, each the parity of the elements that fall on it; empty for an empty set.

    The bits in which two rows differ are at most the elements that are in one set only. A row has the power of two of
    bits that is next to the set's size, 64 at least, so folding it by halves gives the row of fewer bits (``fold``).
    """
    sizes = sets.sizes
    width = np.where(sizes > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)), 0)
    cut = np.concatenate([[0], np.cumsum(width)])
    at = W.mix(sets.item ^ _PARITY) & np.repeat(np.maximum(width, 1) - 1, sizes).astype(np.uint64)
    odd = np.bincount(at.astype(np.int64) + np.repeat(cut[:-1], sizes), minlength=int(cut[-1])) & 1
    packed = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return [packed[a:z] for a, z in zip((cut[:-1] // 8).tolist(), (cut[1:] // 8).tolist(), strict=True)]


def fold(row: np.ndarray, words: int) -> np.ndarray:
    """A row of parities, as 64-bit words, brought down to ``words`` of them."""
    while len(row) > words:
        row = row[: len(row) // 2] ^ row[len(row) // 2 :]
    return row


def with_partner(sizes: np.ndarray, rows: list[bytes], ids: np.ndarray, percent: int) -> np.ndarray:
    """Whether each set may be linked with one of another id, by sizes and parities: true for all that are, and few others."""
    order = np.argsort(sizes, kind="stable")
    n, ids, bits = sizes[order], ids[order], [np.frombuffer(rows[i], "<u8") for i in order.tolist()]
    words = np.array([len(x) for x in bits], np.int64)
    last = np.searchsorted(n, n * 100 // percent, side="right")
    found = np.zeros(len(n), bool)
    for level in np.unique(words[words > 0]).tolist():
        low, high = np.searchsorted(words, level), np.searchsorted(words, level, side="right")
        folded = np.stack([fold(x, level) for x in bits[low : last[high - 1]]])
        for x in range(low, high):
            # one that has a partner already is only looked for by those that have none
            others = np.arange(x + 1, last[x])
            others = others[~found[others]] if found[x] else others
            if not len(others):
                continue
            apart = np.bitwise_count(folded[others - low] ^ folded[x - low]).sum(axis=1, dtype=np.int64)
            near = ((100 - percent) * (n[x] + n[others]) >= (100 + percent) * np.maximum(apart, n[others] - n[x])) & (ids[others] != ids[x])
            if near.any():
                found[x] = True
                found[others[near]] = True
    out = np.zeros(len(n), bool)
    out[order] = found
    return out


@dataclass(frozen=True)
class Scheme:
    """How sets of a size band, and their larger partners, are cut into segments.

    The first ``deleted`` of the ``segments`` also offer every set that lacks one element.
    ``spare`` empty segments may agree without telling anything.
    """

    number: int
    differences: int
    segments: int
    deleted: int
    spare: int


class Bands:
    """Size bands for ``100 * |x & y| >= percent * |x | y|`` and the allocation chosen for each by its expected cost."""

    def __init__(self, percent: int):
        self.percent = percent

    @lru_cache(maxsize=None)  # noqa: B019
    def edges(self, largest: int) -> np.ndarray:
        out = [1]
        while out[-1] <= largest:
            out.append(out[-1] * 100 // self.percent + 1)
        return np.array(out)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        """Number of each size's band: partners are in the same band or a neighbouring one."""
        edges = self.edges(1 << max(4, int(sizes.max(initial=1)).bit_length()))
        return np.searchsorted(edges, sizes, side="right") - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def scheme(self, number: int) -> Scheme:
        """The cheapest allocation for pairs whose smaller set is in band ``number``.

        Of two linked sets at most ``differences`` elements are in one only. Each spoils one exact segment; a segment
        with deletions is spoilt by two. So exact + 2 * deleted - differences segments agree at least.
        """
        edges = [1]
        while len(edges) < number + 2:
            edges.append(edges[-1] * 100 // self.percent + 1)
        low, high = edges[number], edges[number + 1] - 1
        differences = (100 - self.percent) * (high + high * 100 // self.percent) // (100 + self.percent)
        best: tuple[float, Scheme] | None = None
        for deleted in range(0, min(3, differences) + 1):
            spare, segments = 0, differences + 1 - deleted
            while not deleted:  # room for the empty segments that a set of this size has but for a few in 10,000
                hollow = segments * math.exp(-low / segments)
                if spare >= hollow + 3.5 * math.sqrt(hollow):
                    break
                spare, segments = spare + 1, segments + 1
                if segments > low:
                    break
            if segments > low and not deleted and differences:
                continue
            exact, empty = segments - deleted, math.exp(-low / segments)
            mean = low / segments
            cost = exact + deleted * (1 + mean) + segments * empty * (20 if deleted else 2) + segments * math.exp(-mean / 2)
            if best is None or cost < best[0]:
                best = (cost, Scheme(number, differences, segments, deleted, spare))
        return best[1]


def signature_counts(sizes: np.ndarray, bands: Bands) -> np.ndarray:
    """About how many signatures sets of these sizes offer, with those for the band below."""
    kinds, where = np.unique(sizes, return_inverse=True)
    out = np.zeros(len(kinds), np.int64)
    band = bands.band(kinds)
    for i, size in enumerate(kinds.tolist()):
        for number in (int(band[i]), int(band[i]) - 1):
            if size and number >= 0:
                scheme = bands.scheme(number)
                out[i] += scheme.segments + -(-scheme.deleted * size // scheme.segments) if scheme.differences else 0
    return out[where]


def signatures(sets: Sets, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document, whether it is offered as a larger partner of a smaller band's sets).

    Two linked sets that differ share at least one signature, which one of them at least offers for its own band.
    """
    sizes = sets.sizes
    band = bands.band(sizes)
    keys, docs, larger = [], [], []
    for down in (0, 1):
        number = np.where(sizes > 0, band - down, -1)
        live = np.flatnonzero(number >= 0)
        live = live[[bands.scheme(int(b)).differences > 0 for b in number[live]]] if len(live) else live
        if not len(live):
            continue
        kinds, where = np.unique(number[live], return_inverse=True)
        schemes = [bands.scheme(int(b)) for b in kinds]
        n_seg = np.array([s.segments for s in schemes])[where]
        base = np.concatenate([[0], np.cumsum(n_seg)])
        counts = sizes[live]
        owner = np.repeat(np.arange(len(live)), counts)
        at = np.repeat(sets.cut[live] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        item = sets.item[at]
        segment = ((W.mix(item ^ _SEGMENT) >> np.uint64(32)) * n_seg[owner].astype(np.uint64)) >> np.uint64(32)
        slot = base[owner] + segment.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        filled = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=base[-1]))])
        total = group_sums(W.mix(item)[order], filled)
        slot_doc = np.repeat(np.arange(len(live)), n_seg)
        slot_seg = np.arange(base[-1]) - base[slot_doc]
        tag = W.mix(number[live].astype(np.uint64) * _SCHEME)[slot_doc] + W.mix(slot_seg.astype(np.uint64) + _SEGMENT)
        full = np.diff(filled) > 0
        deleted = np.array([s.deleted for s in schemes])[where]
        keep = full | (deleted[slot_doc] > 0)
        keys.append(W.mix(total + tag)[keep])
        docs.append(live[slot_doc[keep]])
        with_drop = slot_seg < deleted[slot_doc]
        if with_drop.any():
            wide = np.repeat(np.arange(base[-1]), np.diff(filled))
            one = np.flatnonzero(with_drop[wide])
            keys.append(W.mix(total[wide[one]] - W.mix(item)[order][one] + tag[wide[one]]))
            docs.append(live[slot_doc[wide[one]]])
        hollow = np.bincount(slot_doc[~full], minlength=len(live))
        spare = np.array([s.spare for s in schemes])[where]
        for d in np.flatnonzero((hollow > spare) & (deleted == 0)):
            gaps = slot_seg[base[d] : base[d + 1]][~full[base[d] : base[d + 1]]]
            for chosen in combinations(gaps.tolist(), int(spare[d]) + 1):
                x = np.array([hash((int(number[live[d]]), *chosen)) & (2**64 - 1)], np.uint64)
                keys.append(W.mix(x))
                docs.append(live[[d]])
        larger.append(np.full(sum(map(len, docs)) - sum(map(len, larger)), down, np.int8))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(larger)
