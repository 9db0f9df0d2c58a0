"""Vectorised text hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes hashed at once; a longer document is hashed alone.
CHUNK = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


_CODES = {True: _byte_codes(True), False: _byte_codes(False)}
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK) + 1
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[where[0] : where[-1]], where - where[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK`` bytes."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, end
        at = end


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts pass about ``most`` bytes (eight times ``CHUNK`` if not given), so that what is made of them stays small."""
    for batch in batches:
        sizes = np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64))
        group = (np.cumsum(sizes) // (most or 8 * CHUNK)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(group)) + 1
        for begin, end in zip(np.append(0, cuts), np.append(cuts, len(sizes))):
            yield batch.slice(int(begin), int(end - begin))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) and, per row, where its words begin."""
    n = len(raw)
    space = _SPACE[raw]
    edge = np.ones(n + 1, dtype=bool)  # a word cannot go on over this position
    edge[1:n] = space[:-1]
    edge[offsets] = True
    begins = np.flatnonzero(~space & edge[:-1])
    edge[:n] |= space
    edge[0] = False
    stops = np.zeros(n + 1, dtype=bool)
    stops[1:] = ~space
    stops &= edge
    ends = np.flatnonzero(stops)
    return run_hashes(raw, begins, ends, lower), np.searchsorted(begins, offsets)


def run_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the byte runs from ``begins`` to ``ends``."""
    up, down = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_CODES[lower][raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins])


_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words; entry i starts at word i."""
    count = max(0, len(hashes) - size + 1)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        out += hashes[k : k + count] * _PLACES[k]
    return mix(out + np.uint64(size))


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles: with fewer words the whole
    sequence is one shingle, without words the set is empty."""
    raw, offsets = column_bytes(column)
    for first, last in chunks(offsets):
        part = offsets[first : last + 1]
        hashes, starts = words(raw[part[0] : part[-1]], part - part[0])
        grams = ngrams(hashes, size)
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield ngrams(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_key(values: np.ndarray) -> np.uint64:
    """A 64-bit key of a set of hashes."""
    total = np.add.reduce(mix(values + np.uint64(0xA0761D6478BD642F)), dtype=np.uint64, keepdims=True)
    return mix(total + np.array([len(values)], dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))[0]


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary Arrow column over the bytes of ``values``, cut at byte ``offsets``."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of the arrays in ``parts``."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def gathered(table: pa.Array, places: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of a large binary array at ``places``, one after another, and where each begins and the last ends."""
    if not len(places):
        return memoryview(b""), np.zeros(1, dtype=np.int64)
    _, offsets, data = table.take(pa.array(places)).buffers()
    return memoryview(data) if data is not None else memoryview(b""), np.frombuffer(offsets, dtype=np.int64)[: len(places) + 1]
