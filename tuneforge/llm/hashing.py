"""Vectorised 64-bit hashes of words and word windows over a block of texts.

A word's hash is the sum of a mixed value of each byte times a power of an odd constant
(modulo 2**64), taken from running sums over the block, so that no Python object is made for
a word. Words are maximal runs of bytes outside space and 0x09-0x0D; A-Z may be folded.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C55
_Q = 0xC2B2AE3D27D4EB4F
_SLICE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values (splitmix64)."""
    x = (x + _U(0x9E3779B97F4A7C15)) & _U(_M)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        step = _U(pow(base, k, 1 << 64))
        m = min(k, n - k)
        out[k : k + m] = out[:m] * step
        k += m
    return out


_POW = _powers(_P, _SLICE)
_INV = _powers(pow(_P, -1, 1 << 64), _SLICE)
_BYTES = mix(np.arange(256, dtype=np.uint64) + _U(1))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words of a block, and each row's range in them."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[offsets < len(buf)]
    first[at] = word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    at = offsets[offsets > 0] - 1
    last[at] = word[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word. Works in slices, so memory does not grow with a text."""
    table = _FOLDED if fold else _BYTES
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = starts[i]
        j = int(np.searchsorted(ends, base + _SLICE, side="right"))
        if j <= i:  # one word longer than a slice
            out[i] = _long_word(table[buf[base : ends[i]]])
            i += 1
            continue
        part = buf[base : ends[j - 1]]
        run = np.empty(len(part) + 1, np.uint64)
        run[0] = 0
        np.cumsum(table[part] * _POW[: len(part)], out=run[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (run[b] - run[a]) * _INV[a]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def _long_word(values: np.ndarray) -> int:
    total, scale = 0, 1
    step = pow(_P, _SLICE, 1 << 64)
    for k in range(0, len(values), _SLICE):
        part = values[k : k + _SLICE]
        total = (total + int(np.sum(part * _POW[: len(part)], dtype=np.uint64)) * scale) & _M
        scale = scale * step & _M
    return total


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive word hashes (one fewer than k for each text end)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _U(_Q) + words[j : j + n]
    return mix(out + _U(k))
