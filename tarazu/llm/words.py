"""Words as maximal runs of letters, marks and digits, hashed for vector work."""

from __future__ import annotations

import unicodedata

import numpy as np
import xxhash


class _Fold(dict):
    """For str.translate: lower case, nothing for signs that draw nothing, a blank for what parts words."""

    def __missing__(self, c: int):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cf" or c == 0x34F or 0xFE00 <= c <= 0xFE0F or 0x180B <= c <= 0x180F or 0xE0100 <= c <= 0xE01EF:
            out = None
        elif kind[0] in "LM" or kind == "Nd":
            out = ch.lower()
        else:
            out = " "
        self[c] = out
        return out


_FOLD = _Fold()


def words(text: str) -> list[str]:
    return text.translate(_FOLD).split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets everything when it grows beyond ``most`` words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, listed: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, listed), np.uint64, len(listed))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, so that minima are fair."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x100000001B3)
        out ^= h[i : i + n]
    return mix(out)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` numbers, in log2(width) passes."""
    if width > len(a):
        return a[:0]
    done = 1
    while done < width:
        step = min(done, width - done)
        a = np.minimum(a[:-step], a[step:])
        done += step
    return a
