"""Two Bloom filters that tell which 64-bit hashes were seen more than once, merged over all tasks.

The first filter holds what was seen, the second what was seen again. Both have a fixed number of bits: a corpus too large for them makes more
false suspects, never a missed repeat, so whatever reads the second filter confirms its suspects exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.shared import summed_tables

#: Bits of each filter: 2**26 bits (8 MB) hold about seven million different hashes with under 2 % false suspects.
FILTER_BITS = 1 << 26
PROBES = 4


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The ``PROBES`` bit numbers of each hash, one column each."""
    with np.errstate(over="ignore"):
        step = (hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        cols = [((hashes + np.uint64(k) * step) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)) & np.uint64(bits - 1) for k in range(PROBES)]
    return np.stack(cols, axis=1).astype(np.int64)


def held(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of a row of bit numbers are set."""
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def put(words: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(words, (at >> 6).ravel(), np.uint64(1) << (at & 63).astype(np.uint64).ravel())


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells alternate between the two filters: seen by either, and seen again by either or seen by both."""
    out = a | b
    out[1::2] |= a[0::2] & b[0::2]
    return out


def repeat_filter(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = FILTER_BITS) -> np.ndarray:
    """The filter of what was seen again. ``hashes_of`` gives arrays of hashes without repeats inside an array: one for each row, or so."""
    if bits & (bits - 1) or bits < 64:
        raise ValueError("bits must be a power of two, 64 at least")

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(bits // 32, np.uint64)
        once, twice = table[0::2], table[1::2]
        for b in batches:
            parts = [h for h in hashes_of(b) if len(h)]
            if not parts:
                continue
            new, counts = np.unique(np.concatenate(parts), return_counts=True)
            at = places(new, bits)
            put(twice, at[(counts > 1) | held(once, at)])
            put(once, at)
        return table

    return np.ascontiguousarray(summed_tables(df, fill, bits // 32, "<u8", _merge)[1::2])


def seen_filter(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = FILTER_BITS) -> np.ndarray:
    """A plain filter of what was seen at all."""

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        words = np.zeros(bits // 64, np.uint64)
        for b in batches:
            for h in hashes_of(b):
                put(words, places(h, bits))
        return words

    return summed_tables(df, fill, bits // 64, "<u8", np.bitwise_or)
