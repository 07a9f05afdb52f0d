"""Vectorised splitting of many texts into words and hashing of these words, over UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z alone: other letters keep their case

#: `[^\x20\x09-\x0D]+`: anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_P = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 64), _P, np.uint64)]), dtype=np.uint64)
    return _POWERS[:n]


@dataclass
class Words:
    """Words of a run of texts: byte ranges in `data` (lower-cased), text number and hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    #: word range of text i: first[i]:first[i + 1]
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashed: bool = True) -> Words:
    """Maximal runs of bytes of `kind`; runs end with their text. Words are hashed by their lower-cased bytes."""
    n_docs = len(offsets) - 1
    data = LOWER[data]
    inside = kind[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    opens = inside & ~before
    start = np.flatnonzero(opens)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    cut = cut[cut > 0]
    after[cut - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    first[-1] = len(start)
    if not hashed:
        return Words(data, start, end, doc, np.zeros(0, np.uint64), first)
    size = end - start
    at = np.flatnonzero(inside)
    if not len(at):
        return Words(data, start, end, doc, np.zeros(0, np.uint64), first)
    base = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(base, size)
    with np.errstate(over="ignore"):
        value = (data[at].astype(np.uint64) + _U(1)) * powers(int(size.max()))[place]
        got = np.add.reduceat(value, base)
        got = mix(got + mix(size.astype(np.uint64)))
    assert n_docs >= 0
    return Words(data, start, end, doc, got, first)


def grams(hashes: np.ndarray, doc: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, at the position of the first; the second array tells which lie in one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        out = np.full(n, _U(seed * 2 + 1))
        for i in range(k):
            out = mix(out * _U(_P) + hashes[i : i + n])
    return out, doc[:n] == doc[k - 1 :]
