"""Vectorised helpers over Arrow text columns: byte views, words, hashes.

All helpers work on one bounded slice of a batch at a time; Spark deals the
rows to tasks.  Hashes are 64-bit polynomial hashes with wrap-around and a
final mix, so equal byte strings hash alike in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 2 << 20

# ASCII white space of the contracts: space and \t \n \v \f \r
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on an array of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))


BYTE_VALUE = _byte_values()
_powers = {"p": np.ones(1, dtype=U64), "q": np.ones(1, dtype=U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["p"]) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("p", BASE), ("q", inverse)):
            steps = np.full(m, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["p"][:n], _powers["q"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i; one longer than values."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * p, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of each span [start, end) of what prefix_hash() was built on."""
    _, q = powers(len(prefix))
    raw = (prefix[ends] - prefix[starts]) * q[starts]
    return mix(raw + (ends - starts).astype(U64))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into slices of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        own = offsets[row : end + 1]
        yield row, end, data[own[0] : own[-1]], own - own[0]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``, or of each run of bytes not in ``between``; words do not cross rows."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~between[data]
    begin = inside[1:] & ~inside[:-1]
    stop = inside[:-1] & ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    cut = cut[inside[cut] & inside[cut + 1]]
    begin[cut] = True
    stop[cut] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)
