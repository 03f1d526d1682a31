"""Vectorised word and shingle hashing over batches of texts, used by the operators that run numpy inside tasks.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased. Words get a 64-bit polynomial hash over random
byte values; shingles mix the hashes of consecutive words. Equal words have equal hashes on every machine and in every run.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_POWERS = np.ones(1 << 12, _U)
with np.errstate(over="ignore"):
    _POWERS[1:] = np.cumprod(np.full(len(_POWERS) - 1, _BASE, _U))


def _powers(longest: int) -> np.ndarray:
    if longest <= len(_POWERS):
        return _POWERS
    out = np.ones(longest, _U)
    out[1:] = np.cumprod(np.full(longest - 1, _BASE, _U))
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    blobs = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    ends_of_texts = np.cumsum([len(b) + 1 for b in blobs])
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(space & np.concatenate(([False], inside[:-1])))
    lengths = ends - starts
    places = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(len(places)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        values = _BYTE[data[places]] * _powers(int(lengths.max()))[within]
        hashes = _mix(np.add.reduceat(values, first) + lengths.astype(_U))
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends_of_texts))))
    return hashes, counts


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; fewer words make one shingle; none make an empty set."""
    words, counts = word_hashes(texts)
    stops = np.cumsum(counts)
    padded = np.concatenate((words, np.zeros(width, _U)))
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(words), _U)
        for k in range(width):
            mixed = _mix(mixed * _U(3) + padded[k:k + len(words)] + _U(k + 1))
        out = []
        for count, stop in zip(counts.tolist(), stops.tolist(), strict=True):
            start = stop - count
            if count >= width:
                out.append(np.unique(mixed[start:stop - width + 1]))
            elif count:
                part = np.zeros(1, _U)
                for k in range(count):
                    part = _mix(part * _U(3) + words[start + k] + _U(k + 1))
                out.append(_mix(part + _U(count)))
            else:
                out.append(np.zeros(0, _U))
    return out
