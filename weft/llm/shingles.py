"""Word shingles as sets of 64-bit hashes, on numpy arrays.

A word is a maximal run of ASCII letters and digits, lower-cased; a shingle is ``width`` words in a
row. Shingles are represented by 64-bit hashes, so a set comparison is exact up to a chance of about
2^-64 for each pair of different shingles compared.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(rb"[a-z0-9]+")
_REMEMBERED = 400_000
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class _WordHashes(dict):
    """Hash of each word, kept for words that come again; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str, width: int = 3) -> np.ndarray:
    """The distinct shingles of a text as sorted uint64 hashes; empty for texts of fewer words."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += ids[j : j + n] * np.uint64(_SALTS[j % len(_SALTS)] + 2 * (j // len(_SALTS)))
    return np.unique(_mix(h))


def grouped(sets: list[np.ndarray], most: int = 60_000):
    """Index ranges of sets with about ``most`` shingles together: a range's arrays stay in cache."""
    begin = total = 0
    for i, s in enumerate(sets):
        total += len(s)
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sets):
        yield begin, len(sets)


def digest(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two sorted sets."""
    if not len(a) or not len(b):
        return 0, len(a) + len(b)
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both, len(a) + len(b) - both
