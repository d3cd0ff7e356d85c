"""Encoding of whole texts with a public tokenizer inside Spark tasks.

The tokenizer's ids of a text are those of its units (runs between white space) one after another, as no token spans white
space and white space gives none. Units repeat, so each worker keeps the ids of those it has seen and only encodes new
ones; the ids of a batch are then gathered by numpy.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortloom.llm.shared import give_back, held

# Characters that str.split() takes for white space and the tokenizer's pattern doesn't.
_UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f")
# Units, characters of units and ids a worker remembers before it starts anew (about 250 MB whatever the script; text without spaces makes long units that never
# repeat), and units encoded by one call.
REMEMBERED, REMEMBERED_CHARS, REMEMBERED_IDS, TOGETHER = 1_200_000, 12_000_000, 12_000_000, 512
# Characters of text handled at a time.
SLICE_CHARS = 500_000


class _Units(dict):
    """Numbers units in the order they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class WordEncoder:
    """Ids of texts for a tokenizers file whose pattern drops white space (word_bpe_49k.json does)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self) -> None:
        self.known, self.chars = _Units(), 0
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.counts = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        self.stops = {}  # ids of a comma and a full stop, where they are one each
        for mark in ",.":
            ids = self.tokenizer.encode(mark, add_special_tokens=False).ids
            if len(ids) == 1:
                self.stops[mark] = ids[0]

    def _reserve(self, ids: int) -> None:
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.known) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))

    def _learn(self) -> None:
        """Finds the ids of the units that were asked for and have none yet.

        The tokenizer composes (NFC), lower-cases and takes letters apart from stops: a unit of ASCII characters has the ids of its lower-case form,
        and one that ends with an ASCII letter and a stop those of what stands before the stop and the stop's. Other letters may become ones that
        end in a combining mark (U+0130, U+0958), which is one piece with the stop: behind them the whole unit is encoded.
        """
        new, number = self.known.new, len(self.known) - len(self.known.new)
        plain, alike = [], []  # numbers of units to encode; (number, number of the simpler unit, stop)
        for at, unit in enumerate(new):  # simpler units that are new are appended meanwhile
            simple, stop = unit, -1
            if "<|" in unit:  # may hold a special token, which is never folded
                plain.append(at)
                continue
            if unit.isascii():
                simple = unit.lower()
            if simple[-1] in self.stops and simple[-2:-1].isalpha() and simple[-2:-1].isascii():
                stop = self.stops[simple[-1]]
                simple = simple[:-1]
            if stop < 0 and simple == unit:
                plain.append(at)
            else:
                alike.append((number + at, self.known[simple], stop))
        self.known.new = []
        self.chars += sum(map(len, new))
        self._reserve(0)
        for low in range(0, len(plain), TOGETHER):
            rows = plain[low : low + TOGETHER]
            part = [new[i] for i in rows]
            encoding = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(encoding.ids, np.uint32)
            places = np.cumsum([0, *map(len, part)]) + np.arange(len(part) + 1)
            owner = np.searchsorted(places, [a for a, _ in encoding.offsets], side="right") - 1
            counts = np.bincount(owner, minlength=len(part))[: len(part)]
            self._reserve(len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            rows = np.array(rows) + number
            self.starts[rows], self.counts[rows] = self.used + np.cumsum(counts) - counts, counts
            self.used += len(ids)
        if alike:
            own, simple, stop = np.array(alike, np.int64).T
            order = np.argsort(stop < 0, kind="stable")[::-1]  # units that only differ in case first: stops may follow them
            own, simple, stop = own[order], simple[order], stop[order]
            same = stop < 0
            self.starts[own[same]], self.counts[own[same]] = self.starts[simple[same]], self.counts[simple[same]]
            own, simple, stop = own[~same], simple[~same], stop[~same]
            counts = self.counts[simple]
            ends = np.cumsum(counts + 1)
            self._reserve(int(ends[-1]) if len(ends) else 0)
            first = self.used + ends - counts - 1
            into = np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)
            self.ids[into] = self.ids[np.arange(counts.sum()) + np.repeat(self.starts[simple] - np.cumsum(counts) + counts, counts)]
            self.ids[first + counts] = stop
            self.starts[own], self.counts[own] = first, counts + 1
            self.used += int(ends[-1]) if len(ends) else 0

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS or self.used > REMEMBERED_IDS:
            self._forget()
        unsure = [any(c in t for c in _UNSURE) for t in texts]
        units = [[] if odd else t.split() for t, odd in zip(texts, unsure)]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, int(sizes.sum()))
        if self.known.new:
            self._learn()
        start, lengths = self.starts[index], self.counts[index]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(start - upto[:-1], lengths) + np.arange(upto[-1])]
        out = np.split(ids, upto[np.cumsum(sizes)[:-1]])
        for i in np.flatnonzero(unsure):
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file, made once and kept until another operator keeps something."""
    encoders = held("encoders")
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each has about SLICE_CHARS bytes of text (one text at least); memory is given back behind the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // SLICE_CHARS
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    batch = None
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
