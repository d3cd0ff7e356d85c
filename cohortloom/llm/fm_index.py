"""Bidirectional FM-index over word ids, deep enough for phrases of a few words.

Suffixes are sorted by their first `depth` symbols only. For patterns of up to `depth` symbols the intervals of such an order are those of a whole suffix
array, and so is what backward search computes from the symbol before each suffix (the Burrows-Wheeler transform) and its ranks; ties
within longer contexts don't matter. The index of the reversed text extends phrases to the right. Both intervals of a phrase are kept up to date, as the symbols
counted in the one give the place within the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Phrases:
    """words (one row of ids a phrase), where their intervals begin in both orders, and how many times they occur."""

    words: np.ndarray
    start: np.ndarray
    reverse_start: np.ndarray
    count: np.ndarray


def _order(text: np.ndarray, depth: int, symbols: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols (0 behind the end)."""
    columns = [text, *(np.concatenate([text[k:], np.zeros(min(k, len(text)), text.dtype)]) for k in range(1, depth))]
    if symbols**depth < 2**63:
        key = columns[0].astype(np.int64)
        for column in columns[1:]:
            key = key * symbols + column
        return np.argsort(key)
    return np.lexsort(columns[::-1])


class FmIndex:
    """Index of a text of ids from 1 on, in which 0 ends each piece (and begins and ends the text)."""

    def __init__(self, text: np.ndarray, depth: int):
        assert text[0] == text[-1] == 0
        self.length, self.symbols, self.depth = len(text), int(text.max()) + 1, depth
        self.counts = np.bincount(text, minlength=self.symbols)
        self.first = np.cumsum(self.counts) - self.counts
        self.before, self._before_ranks = self._transform(text)
        self.after, self._after_ranks = self._transform(text[::-1])

    def _transform(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before each suffix, and the places of all symbols by (symbol, place), from which ranks are looked up."""
        symbols = text[_order(text, self.depth, self.symbols) - 1].astype(np.int64)
        return symbols, np.sort(symbols * self.length + np.arange(self.length))

    def single_words(self) -> Phrases:
        ids = np.flatnonzero(self.counts[1:]) + 1
        return Phrases(ids[:, None], self.first[ids], self.first[ids], self.counts[ids])

    def left(self, phrases: Phrases) -> Phrases:
        """Each phrase with every word that stands before it in its piece."""
        word, row, start, other, count = self._extended(phrases.start, phrases.reverse_start, phrases.count, self.before, self._before_ranks)
        return Phrases(np.column_stack([word, phrases.words[row]]), start, other, count)

    def right(self, phrases: Phrases) -> Phrases:
        """Each phrase with every word that follows it in its piece."""
        word, row, other, start, count = self._extended(phrases.reverse_start, phrases.start, phrases.count, self.after, self._after_ranks)
        return Phrases(np.column_stack([phrases.words[row], word]), start, other, count)

    def _extended(self, start, other, count, symbols, ranks):
        rows = np.repeat(np.arange(len(start)), count)
        ends = np.cumsum(count)
        places = np.arange(len(rows)) - np.repeat(ends - count, count) + np.repeat(start, count)
        keys = np.sort(rows * self.symbols + symbols[places])
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        found = np.diff(new, append=len(keys))
        row, word = np.divmod(keys[new], self.symbols)
        # Smaller symbols of the same phrase lie before this one in the other order: keys stand in that order.
        shifted = other[row] + new - (ends - count)[row]
        inside = word > 0
        row, word, found, shifted = row[inside], word[inside], found[inside], shifted[inside]
        return word, row, np.searchsorted(ranks, word * self.length + start[row]), shifted, found
