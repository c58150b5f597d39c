"""Arrow text columns as flat numpy byte buffers, so that whole batches are scanned at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass works on, unless a single text is longer.
PASS_BYTES = 2 << 20


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library than glibc
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system, Arrow's too: a Python worker outlives its task, and several may be idle on an
    executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def passes(batch: pa.RecordBatch, column: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in ``column``, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n + 1 offsets of the texts; a null is an empty text."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def tiles(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The pieces of ``raw`` between neighbouring offsets, which cover it, as an Arrow binary array without a copy."""
    off = np.ascontiguousarray(offsets, dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(raw))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def words_at(raw: np.ndarray, is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes within each text, and the number of the text of each.

    ``is_word`` is a table of 256 booleans."""
    mask = is_word[raw]
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    starts = mask.copy()
    starts[1:] &= ~mask[:-1] | first[1:-1]
    stops = mask.copy()
    stops[:-1] &= ~mask[1:] | first[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(stops) + 1, np.searchsorted(offsets, s, side="right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``raw``, from one running sum over the whole buffer; equal slices agree."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_ODD, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(_INV, n + 1)[starts] ^ (ends - starts).astype(np.uint64))
