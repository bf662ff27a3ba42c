"""Byte-level helpers for operators that scan whole texts in Arrow batches.

A batch's texts are cut into slices of whole documents of about SLICE_BYTES (one
longer document is a slice of its own), so the working arrays stay small
whatever the batch holds; no text is shortened.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_DOCS = 512
NEWLINE = 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true in the given inclusive byte ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


# words of ASCII digits and letters (after lower-casing) and anything beyond ASCII
ALNUM_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
# words of anything but ASCII white space
SPACE_WORD = ~byte_class((0x09, 0x0D), (0x20, 0x20))


class Slice(NamedTuple):
    """Documents first..first+n of a batch; document i is data[starts[i]:ends[i]], a newline follows each."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def slices(texts: pa.Array, lower: bool = True) -> Iterator[Slice]:
    """Cut a string column into slices; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n, at = len(size), 0
    total = np.concatenate([[0], np.cumsum(size)])
    while at < n:
        end = int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), at + SLICE_DOCS, n)
        blob = "\n".join(texts.slice(at, end - at).to_pylist()).encode() + b"\n"
        data = np.frombuffer(blob, np.uint8)
        data = _LOWER[data] if lower else data
        starts = total[at:end] - total[at] + np.arange(end - at)
        yield Slice(at, data, starts, starts + size[at:end])
        at = end


class Words(NamedTuple):
    """Word k of a slice is data[starts[k]:ends[k]]; document i has words first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(piece: Slice, table: np.ndarray) -> Words:
    inside = table[piece.data]
    inside[piece.ends] = False  # the newline after each document
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, np.append(piece.starts, len(piece.data)))
    return Words(starts, ends, first)


# an odd multiplier has an inverse modulo 2^64, so the hash of any span comes from two prefix sums
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + SLICE_DOCS + 64)
        back = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64)
                     for b in (base, back))
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each values[start:end], the same wherever the span stands."""
    up, back = _power(_BASES[which], len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts])
