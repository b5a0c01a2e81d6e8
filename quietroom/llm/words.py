"""Vectorised word hashes of UTF-8 texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
SPACES = [0x20, *range(0x09, 0x0E)]
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on each element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[SPACES] = True
# Everything in ASCII but letters and digits.
NOT_ALPHANUMERIC = np.zeros(256, bool)
NOT_ALPHANUMERIC[[c for c in range(128) if not chr(c).isalnum()]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))[_FOLD]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK * 2
    while size < n + 1:
        size *= 2
    if size not in _powers:
        if size > CHUNK * 4:  # only a single giant word needs such a table; it isn't kept
            return _make_tables(size)
        _powers[size] = _make_tables(size)
    return _powers[size]


def _make_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(size, base, _U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _hash_piece(
    data: np.ndarray, starts_at: np.ndarray, between: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of ``data``; a text starts at each ``starts_at``."""
    solid = ~between[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = starts_at[(starts_at > 0) & (starts_at < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(first):
        return first, np.empty(0, _U)
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_CODES[data] * up[: len(data)], out=total[1:])
    value = (total[last] - total[first]) * down[first]
    return first, mix(value + (last - first).astype(_U) * _U(0xA0761D6478BD642F))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return data, offsets


def _cuts(
    data: np.ndarray, start: int, end: int, between: np.ndarray
) -> Iterator[tuple[int, int]]:
    """Cut one long text between words into pieces of about CHUNK bytes."""
    while end - start > CHUNK:
        at = start + CHUNK
        while at < end:
            found = np.flatnonzero(between[data[at : at + CHUNK]])
            if len(found):
                at += int(found[0]) + 1
                break
            at = min(end, at + CHUNK)
        yield start, at
        start = at
    if end > start:
        yield start, end


def word_hashes(
    column: pa.Array, between: np.ndarray = _IS_SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, with A-Z lower-cased.

    ``between`` marks the bytes that separate words, if others than white space. Returns all
    hashes and the n + 1 offsets of the texts in them. Works through about CHUNK bytes at a time, so
    memory beyond the hashes does not grow with the batch or with a text.
    """
    data, offsets = utf8(column)
    n = len(offsets) - 1
    counts = np.zeros(n, np.int64)
    parts = []
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1
        if stop > row:
            lo, hi = offsets[row], offsets[stop]
            starts = offsets[row:stop] - lo
            first, hashes = _hash_piece(data[lo:hi], starts, between)
            owner = np.searchsorted(starts, first, "right") - 1
            counts[row:stop] = np.bincount(owner, minlength=stop - row)
            parts.append(hashes)
            row = stop
        else:
            for lo, hi in _cuts(data, int(offsets[row]), int(offsets[row + 1]), between):
                _, hashes = _hash_piece(data[lo:hi], np.zeros(1, np.int64), between)
                counts[row] += len(hashes)
                parts.append(hashes)
            row += 1
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    return (np.concatenate(parts) if parts else np.empty(0, _U)), ends


_TURN = [_U(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` words, in order; fewer words give one for all of them."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, _U(width))
    for i in range(width):
        out = mix(out * _TURN[0] + hashes[i : n - width + 1 + i] * _TURN[1] + _U(i + 1) * _TURN[2])
    return out
