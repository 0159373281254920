"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240607)
BYTE_VALUES = _random.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
PLACES = _random.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n + 1], _powers[1][:n + 1]


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values * BASE**i, and INVERSE**i: (sums[e] - sums[s]) * inverse[s] hashes values[s:e]."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs where is_word holds; a run never crosses texts."""
    n = len(data)
    change = np.zeros(n + 1, bool)
    change[offsets] = True
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = is_word[:-1]
        before &= ~change[:-1]
        after[:-1] = is_word[1:]
        after &= ~change[1:]
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased, parted by white space) and the number of its text."""
    starts, ends, owner = word_bounds(data, offsets, ~SEPARATOR[data])
    sums, down = prefix_hash(BYTE_VALUES[LOWER[data]])
    return mix((sums[ends] - sums[starts]) * down[starts]), owner


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words; of all its words where it has fewer."""
    words, owner = word_hashes(data, offsets)
    count = max(0, len(words) - width + 1)
    sums = np.zeros(count, np.uint64)
    for place in range(width):
        sums += words[place:place + count] * PLACES[place]
    hashes = mix(sums + np.uint64(width))
    first = np.searchsorted(owner, np.arange(len(offsets)))
    for start, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - start >= width:
            yield np.unique(hashes[start:end - width + 1])
        elif end > start:
            yield mix(np.array([(words[start:end] * PLACES[:end - start]).sum(dtype=np.uint64) + np.uint64(end - start)]))
        else:
            yield np.empty(0, np.uint64)
