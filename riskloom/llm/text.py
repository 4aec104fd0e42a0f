"""Words, bytes and hashes of whole Arrow text columns as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered. Hashes are
64-bit: a polynomial over random byte values, mixed at the end. Batches are handled in
slices of half a MB of text, never cutting a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below ``n``."""
    if _powers.get("n") is None or len(_powers["n"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("n", _BASE), ("inverse", _BASE_INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[key] = np.multiply.accumulate(factors)
    return _powers["n"][:n], _powers["inverse"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit hashes (splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray, lowered: bool = False) -> np.ndarray:
    """Running hash: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWERED if lowered else _VALUES)[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the hashed bytes."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets (rows + 1) of runs of documents; null counts as empty.

    A run holds about ``limit`` bytes, more only where one document does.
    """
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(raw_offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word."""
    space = _SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lowered word in order, and for each document the index of its first word."""
    starts, ends, first = words(data, offsets)
    return span_hash(prefix_hash(data, lowered=True), starts, ends), first


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal ``key`` from a stream sorted by it, each run as one table."""
    held: list[pa.RecordBatch] = []
    last, begun = None, False
    for batch in batches:
        low = 0
        for i, value in enumerate(batch.column(key).to_pylist()):
            if begun and value != last:
                if i > low:
                    held.append(batch.slice(low, i - low))
                yield pa.Table.from_batches(held)
                held, low = [], i
            last, begun = value, True
        if low < batch.num_rows:
            held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)
