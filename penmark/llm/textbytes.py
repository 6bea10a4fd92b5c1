"""Texts of a batch as one numpy array of UTF-8 bytes, A-Z lower-cased, and
the words in it as byte ranges; work per word is then array work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes (one text at least)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): every text followed by a line feed; text ``i`` is at
    ``offsets[i]`` to ``offsets[i + 1] - 1``. Null texts are empty."""
    large = [pa.scalar(x, pa.large_string()) for x in ("", "\n")]
    whole = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), large[0]), *large)
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return _LOWER[data], offsets - offsets[0]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    return edges[::2], edges[1::2]


def spans(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one behind the other."""
    ends = np.cumsum(size)
    return np.repeat(starts - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings of the ranges."""
    size = ends - starts
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[spans(starts, size)])])


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(entry of each range, distinct byte strings)."""
    found = words(data, starts, ends).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary
