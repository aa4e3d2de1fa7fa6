"""Words and rolling hashes of whole texts, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so the rolling hash loses no bits
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

#: Text handled at once; a longer document is handled alone.
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word, and where each text's words begin.

    Words are runs of anything but the six ASCII white-space characters. Null has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(full)])[ends].astype(np.int64)
    if not full.all():
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets


def word_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of every run of ``width`` items."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, width):
        acc *= _BASE
        acc += hashes[j : j + n]
    return mix(acc)


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, first word) of every window that lies within one text."""
    rolled = rolling(hashes, width)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[: len(rolled)]
    start = np.flatnonzero(np.arange(len(rolled)) + width <= offsets[owner + 1])
    return rolled[start], owner[start], start


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes and under 60,000 texts."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (held + size > limit or i - first >= 60_000):
            yield first, i
            first, held = i, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes)


def pack(values: np.ndarray) -> bytes:
    """64-bit integers as eight byte planes: planes that are alike compress well in a shuffle."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
