"""Vectorised word and shingle hashing over Arrow string columns.

Everything works on the concatenated UTF-8 bytes of a column, a bounded chunk of documents at a time,
so the cost is a few numpy passes over the bytes and no Python object is made per word.

A word is a maximal run of ASCII letters, ASCII digits or bytes of non-ASCII characters; ASCII letters
are compared in lower case.  Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
BLOCK_BYTES = 1 << 18
KEPT_POWERS = 1 << 20

_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _WORD[_c] = True
_WORD[128:] = True
PLAIN = np.arange(256, dtype=np.uint64) + 1
_LOWER = PLAIN.copy()
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LOWER[_c] = _c + 33

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for the worker's life only up to KEPT_POWERS of them."""
    if "up" in _POWERS and len(_POWERS["up"]) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    made = []
    for base in (_BASE, _BASE_INV):
        steps = np.full(max(n, KEPT_POWERS), base, dtype=np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= KEPT_POWERS:
        _POWERS["up"], _POWERS["down"] = made
    return made[0][:n], made[1][:n]


def span_hashes(data: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes, not yet mixed, of ordered spans of bytes that don't overlap; `values` has a number for each byte.

    Computed a bounded number of bytes at a time, so that a long text takes no more memory than a short one."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + BLOCK_BYTES, side="right"))
        if j <= i:  # a span longer than a block
            total, factor = np.uint64(0), np.uint64(1)
            up, _ = _powers(BLOCK_BYTES + 1)
            with np.errstate(over="ignore"):
                for at in range(lo, int(ends[i]), BLOCK_BYTES):
                    part = values[data[at : min(at + BLOCK_BYTES, int(ends[i]))]]
                    total = total + (part * up[: len(part)]).sum(dtype=np.uint64) * factor
                    factor = factor * up[BLOCK_BYTES]
            out[i] = total
            i += 1
            continue
        hi = int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        a = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[a]) * down[a]
        i = j
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on a fresh array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    item = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=item)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and per row the index of its first word (rows + 1 values)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and per row the index of its first word."""
    starts, ends, of_row = word_spans(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), of_row
    return mix64(span_hashes(data, _LOWER, starts, ends)), of_row


def shingle_hashes(words: np.ndarray, of_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of a row, and per row the index of its first one.

    A row of fewer than k words, but at least one, has one shingle of all its words."""
    counts = np.diff(of_row)
    each = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    at = np.zeros(len(of_row), dtype=np.int64)
    np.cumsum(each, out=at[1:])
    if at[-1] == 0:
        return np.zeros(0, np.uint64), at
    padded = np.concatenate([words, np.zeros(k - 1, np.uint64)])
    total = np.zeros(len(words), dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += padded[j : j + len(words)] * factor
            factor = factor * _STEP
    place = np.arange(at[-1]) + np.repeat(of_row[:-1] - at[:-1], each)
    out = total[place]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        value, factor = np.uint64(0), np.uint64(1)
        with np.errstate(over="ignore"):
            for w in words[of_row[row] : of_row[row + 1]]:
                value = value + w * factor
                factor = factor * _STEP
        out[at[row]] = value
    return mix64(out), at
