"""Byte-pair merges of many words at once on flat numpy arrays."""

from __future__ import annotations

import numpy as np

from docsift.llm.common import concatenated_ranges

_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left symbol, right symbol) -> (rank, merged symbol), as an open-addressing hash table of numpy arrays."""

    def __init__(self, left, right, rank, merged):
        keys = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        bits = max(8, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks, self.merged = np.full(1 << bits, _NONE, np.int32), np.zeros(1 << bits, np.int32)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] < 0]
            self.keys[slots[free]] = keys[free]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)
        self.ranks[slots], self.merged[slots] = rank, merged

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (the largest int for no such pair) and merged symbols."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slots(keys)
        there = self.keys[slots]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[todo]]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        found = self.keys[slots] == keys
        return np.where(found, self.ranks[slots], _NONE), self.merged[slots]


def merged_words(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each word after all merges, and how many they are.

    In each round every word finds the lowest rank among its adjacent pairs and merges all pairs of that rank
    at once, from the left and without overlap; words without a mergeable pair leave the arrays. One merge
    after the other gives the same, unless a merge makes a pair of the same or a lower rank while others of the
    round are still to come. Then the word's later merges wait for the next round.
    """
    words = np.arange(len(lengths))
    out_lengths = np.asarray(lengths, np.int64).copy()
    finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    symbols, lengths = np.asarray(symbols, np.int32), out_lengths.copy()
    keep = lengths > 0
    words, lengths = words[keep], lengths[keep]
    ranks = merged = None
    while len(words):
        starts = np.cumsum(lengths) - lengths
        if ranks is None:
            ranks, merged = _pair_ranks(symbols, starts, lengths, table)
        best = np.minimum.reduceat(ranks, starts)
        alive = best < _NONE
        if not alive.all():
            done = np.repeat(~alive, lengths)
            finished.append((words[~alive], lengths[~alive], symbols[done]))
            symbols, ranks, merged = symbols[~done], ranks[~done], merged[~done]
            words, lengths, best = words[alive], lengths[alive], best[alive]
            if not len(words):
                break
        word = np.repeat(np.arange(len(words)), lengths)
        chosen = _leftmost(ranks == best[word])
        chosen = _without_conflicts(chosen, symbols, merged, word, best, table)
        symbols, ranks, merged, lengths = _merge(chosen, symbols, ranks, merged, word, lengths, table)
    for index, length, _ in finished:
        out_lengths[index] = length
    out = np.empty(int(out_lengths.sum()), np.int32)
    out_starts = np.cumsum(out_lengths) - out_lengths
    for index, length, values in finished:
        out[concatenated_ranges(out_starts[index], length)] = values
    return out, out_lengths


def _pair_ranks(symbols, starts, lengths, table):
    ranks, merged = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
    inner = np.ones(len(symbols), bool)
    inner[starts + lengths - 1] = False
    at = np.flatnonzero(inner)
    ranks[at], merged[at] = table.find(symbols[at], symbols[at + 1])
    return ranks, merged


def _leftmost(flags: np.ndarray) -> np.ndarray:
    """Places of the flags, every other one where flags are adjacent."""
    at = np.flatnonzero(flags)
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    if new.all():
        return at
    run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run) % 2 == 0]


def _without_conflicts(chosen, symbols, merged, word, best, table):
    """Drops a word's merges behind the first one that makes a pair of the same or a lower rank."""
    of = word[chosen]
    more = np.zeros(len(chosen), bool)
    more[:-1] = of[1:] == of[:-1]
    if not more.any():
        return chosen
    at = chosen[more]
    product, limit = merged[at], best[word[at]]
    conflict = np.zeros(len(at), bool)
    # to the left: the left neighbour, or the product of a merge just before
    has = (at > 0) & (word[at - 1] == word[at])
    index = np.flatnonzero(has)
    left = symbols[at[index] - 1]
    is_chosen = np.zeros(len(symbols) + 2, bool)
    is_chosen[chosen] = True
    after = (at[index] > 1) & is_chosen[np.maximum(at[index] - 2, 0)]
    left = np.where(after, merged[np.maximum(at[index] - 2, 0)], left)
    conflict[index] = table.find(left, product[index])[0] <= limit[index]
    # to the right there is a symbol of the same word, as another merge follows
    conflict |= table.find(product, symbols[at + 2])[0] <= limit
    if not conflict.any():
        return chosen
    words, first = np.unique(word[at[conflict]], return_index=True)
    last = np.full(int(word[-1]) + 1, len(symbols))
    last[words] = at[conflict][first]
    return chosen[chosen <= last[of]]


def _merge(chosen, symbols, ranks, merged, word, lengths, table):
    symbols[chosen] = merged[chosen]
    keep = np.ones(len(symbols), bool)
    keep[chosen + 1] = False
    lengths = lengths - np.bincount(word[chosen], minlength=len(lengths))
    place = chosen - np.arange(len(chosen))  # of the products in the shorter arrays
    symbols, ranks, merged, word = symbols[keep], ranks[keep], merged[keep], word[keep]
    touched = np.zeros(len(symbols), bool)
    touched[place] = True
    touched[place[place > 0] - 1] = True
    at = np.flatnonzero(touched)
    inner = (at + 1 < len(word)) & (word[np.minimum(at + 1, len(word) - 1)] == word[at])
    ranks[at[~inner]] = _NONE
    at = at[inner]
    ranks[at], merged[at] = table.find(symbols[at], symbols[at + 1])
    return symbols, ranks, merged, lengths


class WordCodes(dict):
    """Word -> number, counting from 0; new words are also appended to ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word):
        code = self[word] = len(self)
        self.fresh.append(word)
        return code


class CachedEncoder:
    """Encodes lists of words, each different word once as long as the memory of ``limit`` words lasts."""

    def __init__(self, encode_words, limit: int = 300_000):
        self.encode_words, self.limit = encode_words, limit
        self.reset()

    def reset(self):
        self.codes = WordCodes()
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def __call__(self, words: list[str], per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each text has; per_text: its words."""
        if len(self.codes) > self.limit:
            self.reset()
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.fresh:
            ids, lengths = self.encode_words(self.codes.fresh)
            self.codes.fresh = []
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids = np.concatenate([self.ids, ids])
            self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        lengths = self.lengths[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return self.ids[concatenated_ranges(self.starts[codes], lengths)], np.diff(ends[bounds])
