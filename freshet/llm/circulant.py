"""Circulant MinHash signatures of word-shingle sets, in numpy."""

from __future__ import annotations

import functools

import numpy as np

#: Shingles are mapped into a circle of 2^20 places; the two permutations are of this circle.
PLACES = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain): a bijection that scatters close values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A random number for each byte, with A-Z as a-z; white space is 0. Words are sums of these times powers of _M.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mix(np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint64) + np.uint64(0xC0FFEE))
BLOCK = 1 << 18


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_M and its inverse modulo 2^64, each to the powers below n."""
    inverse = pow(int(_M), -1, 1 << 64)
    up, down = np.full(n, _M), np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


def _block_words(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    edges = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = powers(max(BLOCK, 1 << (len(raw) - 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * up[:len(raw)])))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text, A-Z lower-cased, in blocks of bounded size."""
    data, at, out = np.frombuffer(raw, np.uint8), 0, []
    while len(data) - at > BLOCK:
        gaps = np.flatnonzero(_SPACE[data[at:at + BLOCK]])
        end = at + int(gaps[-1]) + 1 if len(gaps) else 0
        if not end:  # one word longer than a block
            gaps = np.flatnonzero(_SPACE[data[at:]])
            end = at + int(gaps[0]) + 1 if len(gaps) else len(data)
        out.append(_block_words(data[at:end]))
        at = end
    if at < len(data):
        out.append(_block_words(data[at:]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted different hashes of the text's runs of `size` words; of the whole text if it has fewer words."""
    ids = word_hashes(raw)
    n = len(ids)
    if n == 0:
        return ids
    width = min(n, size)
    runs = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            runs = runs * _M + ids[i:n - width + 1 + i]
        return np.unique(mix(runs + np.uint64(width)))


@functools.cache
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and all circular shifts of the second as rows of one view."""
    with np.errstate(over="ignore"):
        order = np.arange(PLACES, dtype=np.uint64)
        first = np.argsort(mix(order + np.uint64(0xA5A5A5A5)), kind="stable").astype(np.uint32)
        second = np.argsort(mix(order + np.uint64(0x5A5A5A5A00000000)), kind="stable").astype(np.uint32)
    circle = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least value, among the set's places, of the second permutation shifted by k."""
    first, shifted = permutations(coordinates)
    places = first[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
    low = np.full(coordinates, PLACES, np.uint32)
    for at in range(0, len(places), 256):
        np.minimum(low, shifted[places[at:at + 256]].min(axis=0), out=low)
    return low
