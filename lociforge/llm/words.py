"""Words of whole texts as integer codes, for Arrow batches.

A word is a run of characters other than space and the control characters 9 to 13. A batch is
worked off in slices of bounded text, so long texts don't multiply the memory of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts as one string array; null becomes the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows with about ``limit`` bytes of text each; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    group = (np.cumsum(sizes) + 64 * np.arange(len(sizes))) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *cuts.tolist(), len(sizes)]
    return ((a, b) for a, b in zip(bounds, bounds[1:]) if b > a)


def give_back() -> None:
    """Freed memory goes back to the system: Arrow's and, where the C library can, numpy's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@dataclass
class Words:
    """``codes`` of all words in order; document i has those from ``starts[i]`` to ``starts[i + 1]``."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each document."""
        return sums(values, self.starts)

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (without nulls) and the start of each document among them."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    real = np.asarray(pc.binary_length(flat)) > 0
    before = np.zeros(len(real) + 1, np.int64)
    np.cumsum(real, out=before[1:])
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return flat.filter(pa.array(real)), before[offsets - offsets[0]]


def words(texts: pa.Array) -> Words:
    flat, starts = split(texts)
    coded = flat.dictionary_encode()
    return Words(np.asarray(coded.indices, dtype=np.int64), starts, coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection, so different values stay different."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Odd multipliers of the range hashes and seeds of the word hashes; two of them give independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class RangeHash:
    """64-bit hashes of any range of a sequence of 64-bit values.

    Stretches of 2, 4, 8, ... values are named by mixing the names of their halves; a range is named by
    the longest such stretches at its two ends, which cover it, and its length. Mixing isn't linear, so no
    regular sequence cancels out.
    """

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        self.base = np.uint64(base)
        self.levels = [mix(values ^ self.base)]

    def join(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return mix(one * self.base + mix(two + self.base))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        if not len(size):
            return np.zeros(0, np.uint64)
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        out = np.zeros(len(size), np.uint64)
        for k in np.unique(level).tolist():
            while len(self.levels) <= k:
                half, last = 1 << (len(self.levels) - 1), self.levels[-1]
                self.levels.append(self.join(last[: max(0, len(last) - half)], last[half:]))
            row = np.flatnonzero((level == k) & (size > 0))
            out[row] = self.join(self.levels[k][begin[row]], self.levels[k][end[row] - (1 << k)])
        return mix(out + size.astype(np.uint64))


def string_hashes(strings: pa.Array, *bases: int) -> list[np.ndarray]:
    """XXH64 of the UTF-8 bytes of each string, for each seed."""
    known, digest = strings.cast(pa.binary()).to_pylist(), xxhash.xxh64_intdigest
    return [np.fromiter((digest(word, base) for word in known), np.uint64, len(known)) for base in bases]


def wide_hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of XXH3-128 of the UTF-8 bytes of each string, in one pass over the strings."""
    if not len(strings):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    data = strings.buffers()[2].to_pybytes()
    made = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(ends, ends[1:])])
    halves = np.frombuffer(made, np.uint64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def names(flat: pa.Array, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each string, the same in every batch."""
    coded = flat.dictionary_encode()
    return string_hashes(coded.dictionary, base)[0][np.asarray(coded.indices, dtype=np.int64)]
