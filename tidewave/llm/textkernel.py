"""Vectorised text kernels shared by the Arrow-based operators.

All functions work on one flat byte buffer that holds many texts, so that no
Python code runs per word or per character.  Words are ``[^\\x20\\x09-\\x0D]+``
of the text with A-Z lower-cased; a word is known by a 64-bit hash.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; bounds the memory of a task whatever the batch holds.
SLICE_BYTES = 2_000_000

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_COEF = _rng.integers(1, 2**63, 16, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C17  # odd, and base - 1 is 2 mod 4
_BASE_INV = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 200_000)
        tables = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(size, base, U64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts; null counts as empty.

    Only ``rows`` rows of the column are copied at once.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for start in range(0, len(column), rows):
        part = pc.fill_null(column.slice(start, rows).cast(pa.large_string()), "")
        n = len(part)
        _, offsets, data = part.buffers()
        off = np.frombuffer(offsets, np.int64, n + 1, part.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(n, max(to, at + 1))
            yield start + at, start + to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and the first word's index of every text (one more entry than texts)."""
    low = _LOWER[data]
    n = len(low)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(_BYTE[low] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; fewer words make one shingle of them all, none make none."""
    n = len(hashes)
    full = np.zeros(max(n - k + 1, 0), U64)
    for j in range(k):
        if len(full):
            full += hashes[j : j + len(full)] * _COEF[j]
    full = mix(full + U64(k))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        m = b - a
        if m >= k:
            h = np.sort(full[a : b - k + 1])
            out.append(h if m == k else h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif m:
            total = sum(int(hashes[a + j]) * int(_COEF[j]) for j in range(m)) + m
            out.append(mix(np.array([total % 2**64], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def text_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) by slices of a text column."""
    for at, _, data, offsets in text_slices(column):
        _, _, h, first = words(data, offsets)
        yield at, shingles(h, first, k)


def fingerprint(h: np.ndarray) -> int:
    """A 63-bit fingerprint of a set of hashes."""
    if not len(h):
        return 0
    total = int(np.add.reduce(mix(h ^ U64(0x5851F42D4C957F2D)))) + 0x9E3779B97F4A7C15 * len(h)
    return int(mix(np.array([total % 2**64], U64))[0] >> U64(1))


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker, which other tasks use after it, gives freed memory back to the system at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(ctypes.util.find_library("c"))
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped
