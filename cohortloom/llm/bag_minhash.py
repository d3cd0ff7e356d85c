"""BagMinHash: signatures whose agreement is an unbiased estimate of the weighted Jaccard similarity of two bags.

An element of weight w owns a Poisson process over (0, w] x time. Weights are discretised by the steps 1, 2, 4, 8, ...: each interval
between two steps has one process of its own, the same for every bag that holds the element. Its points come in the order of
time, each with a random signature place and a random height within the interval; a bag of weight w sees those below w. The
signature keeps, for each place, the earliest point seen. Processes stop as soon as their time is past the latest point kept,
so that most elements cost one or two points whatever the number of places.
"""

from __future__ import annotations

import numpy as np

from cohortloom.llm.shingles import scrambled

_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53
# Points drawn at once for a process that has many left to draw, at most (bounds memory).
MOST_AT_ONCE = 512


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and up to 1 of random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * _UNIT


def _intervals(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seed, lower end, width, weight) of every interval that an element's weight reaches into."""
    seeds, lows, widths, tops = [elements], [np.zeros(len(elements))], [np.ones(len(elements))], [weights.astype(float)]
    low = 1
    while (reach := weights > low).any():
        seeds.append(scrambled(elements[reach] + np.uint64(int(_STEP) * low % (1 << 64))))
        lows.append(np.full(reach.sum(), float(low)))
        widths.append(np.full(reach.sum(), float(low)))
        tops.append(weights[reach].astype(float))
        low *= 2
    return tuple(np.concatenate(x) for x in (seeds, lows, widths, tops))


def signature(elements: np.ndarray, weights: np.ndarray, places: int) -> np.ndarray:
    """`places` 64-bit values; for two bags, each place agrees with the probability of their weighted Jaccard similarity.

    elements: distinct 64-bit hashes; weights: whole numbers of 1 or more. An empty bag gives zeros.
    """
    times, values = np.full(places, np.inf), np.zeros(places, np.uint64)
    if not len(elements):
        return values
    seeds, lows, widths, tops = _intervals(elements, weights)
    clock, drawn = np.zeros(len(seeds)), 0
    while len(seeds):
        wanted = places * (np.log(places) + 2) if np.isinf(times).any() else 0
        at_once = int(min(max(1, wanted // len(seeds)), MOST_AT_ONCE))
        bits = scrambled(seeds[:, None] + _STEP * np.arange(3 * drawn + 1, 3 * (drawn + at_once) + 1, dtype=np.uint64)[None, :])
        bits = bits.reshape(len(seeds), at_once, 3)
        when = clock[:, None] + np.cumsum(-np.log(_uniform(bits[:, :, 0])), axis=1) / widths[:, None]
        clock = when[:, -1]
        seen = (when < times.max()) & (lows[:, None] + widths[:, None] * _uniform(bits[:, :, 2]) <= tops[:, None])
        place = (bits[:, :, 1] % np.uint64(places)).astype(np.int64)[seen]
        moment, value = when[seen], scrambled(bits[:, :, 1] ^ bits[:, :, 2])[seen]
        np.minimum.at(times, place, moment)
        first = moment == times[place]
        values[place[first]] = value[first]
        drawn += at_once
        go_on = clock < times.max()
        seeds, lows, widths, tops, clock = (x[go_on] for x in (seeds, lows, widths, tops, clock))
    return values


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each `rows` values."""
    parts = values.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64) * _STEP
    for k in range(rows):
        key = scrambled(key * np.uint64(31) + parts[:, k])
    return key.view(np.int64)
