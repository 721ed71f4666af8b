"""Numpy kernels over flat text: word bounds and 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: A random number for each value of a byte, by the rule of splitmix64.
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but ASCII letters and digits and the bytes of other characters.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


#: Positions that one table of sums covers; a longer text is hashed in several steps.
SEGMENT = 1 << 20


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    have = max(_powers, default=0)
    if have < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for b in (_BASE, _INVERSE):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
        return _powers[size]
    return _powers[have]


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of a few values, from sums of values times powers; a random 64-bit number stands for each."""
    power, inverse = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M2)


def range_hashes(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of ``data`` that come one after the other; equal ranges have equal hashes wherever they
    stand.  ``table`` has a random number for each symbol.  Memory is bounded by ``SEGMENT``, not by the text."""
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + SEGMENT, side="right")))
        if int(ends[i]) - at > SEGMENT:  # one range, longer than a segment: a hash of the hashes of its parts
            for a in range(at, int(ends[i]), SEGMENT):
                part = table[data[a : min(a + SEGMENT, int(ends[i]))]]
                out[i] = mix(out[i : i + 1] * _BASE + _hashes(part, np.array([0]), np.array([len(part)])))[0]
        else:
            out[i:j] = _hashes(table[data[at : int(ends[j - 1])]], starts[i:j] - at, ends[i:j] - at)
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``space`` (by default the words ``[^\\x20\\x09-\\x0D]+``), and for
    each text the number of words before it."""
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z lower-cased first, if asked), and for each text the number of words before it."""
    data = LOWER[data] if lower else data
    starts, ends, first = words(data, offsets, space)
    return range_hashes(BYTE, data, starts, ends), first


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter sequence is one run; no word, none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out += mix(hashes[i : n - k + 1 + i] + np.uint64((i + 1) * int(_M1) % (1 << 64)))
    return mix(out + np.uint64(k))
