"""Word shingles of texts by numpy, many texts at a time.

Words are the longest runs of letters and digits (by code point, any script) of the lower-cased text. A shingle is five words in a
row; a text of one to four words has one shingle, all of them. A shingle is a 64-bit hash of its words; a bag counts each.
"""

from __future__ import annotations

import sys

import numpy as np

from cohortloom.llm.shared import held

WORDS = 5
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _table(name: str, make) -> np.ndarray:
    tables = held("shingles")
    if name not in tables:
        tables[name] = make()
    return tables[name]


def _powers(name: str, base: int, n: int) -> np.ndarray:
    tables = held("shingles")
    if name not in tables or len(tables[name]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        tables[name] = np.cumprod(steps)  # modulo 2^64
    return tables[name][:n]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    gap = np.zeros(1, np.uint32)  # code point 0 is no letter: it parts the texts
    points = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap[:0]
    inside = _table("letters", _letters)[points]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    weighed = scrambled(points.astype(np.uint64) + np.uint64(_ODD)) * _powers("up", _ODD, len(points))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)])
    hashes = scrambled((sums[ends] - sums[starts]) * _powers("down", pow(_ODD, -1, 1 << 64), len(points))[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(starts, borders), prepend=0) if parts else np.zeros(0, np.int64)
    return hashes, counts


def bags(texts: list[str], words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingles, how often each occurs) of each text; both empty for a text without words."""
    hashes, counts = word_hashes(texts)
    factors = [pow(_ODD, 2 * k + 3, 1 << 64) for k in range(words)]
    n = len(hashes)
    rolled = np.zeros(max(n - words + 1, 0), np.uint64)
    for k, factor in enumerate(factors):
        rolled += hashes[k : k + len(rolled)] * np.uint64(factor)
    rolled = scrambled(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(rolled[at : at + count - words + 1], return_counts=True))
        elif count:
            short = np.array([count], np.uint64)
            for k in range(count):
                short = scrambled(short * np.uint64(3) + hashes[at + k : at + k + 1])
            out.append((short, np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at += count
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of two bags: sum of the smaller counts over sum of the larger; 0 if either is empty."""
    total = int(a[1].sum() + b[1].sum())
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)
