"""Token ids of whole texts by the public word tokenizer (lower case, white space dropped, byte-pair codes with word ends).

Its pre-tokenizer never joins characters across white space, nor letters with the punctuation after them, so a text's
ids are those of its words one after the other, and a word's those of its letters and of the signs behind them. Each
distinct piece goes through the library once for a Python worker, which keeps the ids of at most ``MEMORY`` pieces in
flat arrays; beyond that the memory starts anew.
"""

from __future__ import annotations

import os

import numpy as np

from tablewarden.llm import words as W

MEMORY = 1_500_000

_SIGN = np.zeros(256, bool)
_SIGN[list(b".,;:!?*$%&#|")] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN_TAIL = np.zeros(256, bool)  # second bytes of U+00C0 to U+00FF, without the two signs among these letters
_LATIN_TAIL[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of letters from A to Z and U+00C0 to U+00FF."""
    lead = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1] & _LATIN_TAIL[data[1:]]
    lead[:-1] &= tail[1:]
    lead[-1:] = False
    return _ASCII_LETTER[data] | lead | tail


def pieces(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, key, word) of the pieces in their order. Equal keys have equal ids."""
    data, start, end = block.data, block.start, block.end
    plain = np.concatenate([[0], np.cumsum(letters(data))])
    sign = np.concatenate([[0], np.cumsum(_SIGN[data])])
    # a word splits when it is letters, then signs only: count both, and see that the first of the signs stands behind the letters
    n_letters = plain[end] - plain[start]
    core = start + n_letters
    splits = (n_letters > 0) & (sign[end] - sign[start] == end - core) & (plain[core] - plain[start] == n_letters) & (core < end)
    is_core = splits | (n_letters == end - start)
    word = np.repeat(np.arange(len(start)), 1 + splits)
    second = np.zeros(len(word), bool)
    second[1:] = word[1:] == word[:-1]
    at = np.where(second, core[word], start[word])
    to = np.where(splits[word] & ~second, core[word], end[word])
    low = is_core[word] & ~second
    raw = W.prefix_sums(W._BYTE_VALUES[data], W._BASE_BYTES)
    key = W.span_hashes(raw, W._BASE_BYTES, at, to)
    lower = W.prefix_sums(W._BYTE_VALUES[W.LOWER[data]], W._BASE_BYTES)
    key[low] = W.span_hashes(lower, W._BASE_BYTES, at[low], to[low])
    return at, to, key, word


class Memory:
    """Ids of pieces by key: sorted keys, and for each where its ids stand in one array."""

    def __init__(self, path: str, plain_specials: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        small = [*map(chr, range(0x61, 0x7B)), *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]
        self.spelt = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in small}
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Words of small letters are their own normal form, so they can go straight to the model."""
        out: list[list[int] | None] = [None] * len(texts)
        rest, model, spelt = [], self.tokenizer.model, self.spelt
        for i, t in enumerate(texts):
            if spelt.keys() >= set(map(ord, t)):
                out[i] = [x.id for x in model.tokenize(t.translate(spelt))]
            else:
                rest.append(i)
        made = self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, made, strict=True):
            out[i] = e.ids
        return out

    def look_up(self, key: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """(place, length) in ``ids`` for ascending distinct keys; ``text_of(i)`` is the text of key i."""
        where = np.searchsorted(self.key, key)
        known = where < len(self.key)
        known[known] = self.key[where[known]] == key[known]
        if known.all():
            return self.at[where], self.n[where]
        if len(self.key) + int((~known).sum()) > MEMORY:
            self.clear()
            known = np.zeros(len(key), bool)
        new = np.flatnonzero(~known)
        made = self._encode([text_of(i) for i in new.tolist()])
        n = np.array([len(x) for x in made], np.int64)
        flat = np.array([y for x in made for y in x], np.uint16)
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, flat])
        place = np.searchsorted(self.key, key[new])
        self.key = np.insert(self.key, place, key[new])
        self.at, self.n = np.insert(self.at, place, at), np.insert(self.n, place, n)
        where = np.searchsorted(self.key, key)
        return self.at[where], self.n[where]


_memories: dict[tuple[str, bool], Memory] = {}


def memory(path: str, plain_specials: bool = False) -> Memory:
    """One for each Python worker. ``plain_specials``: the strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, plain_specials) not in _memories:
        _memories[path, plain_specials] = Memory(path, plain_specials)
    return _memories[path, plain_specials]


def encode_block(block: W.Block, mem: Memory) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block's documents, and where each document's begin; the vocabulary must fit 16 bits."""
    if not len(block.start):
        return np.zeros(0, np.uint16), np.zeros(len(block.cut), np.int64)
    start, end, key, word = pieces(block)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    low = W.LOWER[block.data]
    inside = letters(block.data)

    def text_of(i: int) -> str:
        a, z = int(start[first[i]]), int(end[first[i]])
        return (low if inside[a:z].all() else block.data)[a:z].tobytes().decode("utf-8", "replace")

    at, n = mem.look_up(ordered[fresh], text_of)
    at, n = at[group], n[group]
    stop = np.cumsum(n)
    ids = mem.ids[np.repeat(at - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
    before = np.concatenate([[0], stop])
    first_piece = np.searchsorted(word, block.first)
    return ids, before[first_piece]
