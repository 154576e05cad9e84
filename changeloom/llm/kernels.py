"""Vectorised text kernels over Arrow buffers.

The operators of this subpackage look at every byte of the corpus, so the per-byte work is done with NumPy on
the buffers that Arrow hands over: no Python string is made for a document. All functions here take a batch's
concatenated UTF-8 bytes and the row offsets.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
SPACE, WORD, SYMBOL = 0, 1, 2
#: Bytes that are worked on at once: keeps the temporaries in cache and the worker small.
SLICE = 1 << 19


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _IPOW = np.empty(0, U64), np.empty(0, U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        _POW, _IPOW = _powers(_P, n), _powers(_INV, n)
    return _POW, _IPOW


_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(U64) | U64(1)
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[:33] = SPACE
_CLASS[127] = SPACE
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task holds next to nothing."""
    global _POW, _IPOW
    _POW, _IPOW = np.empty(0, U64), np.empty(0, U64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # other C libraries have no such call
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that releases its memory after its last batch."""

    @functools.wraps(run)
    def wrapped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def text_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, len + 1) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if lower:
        column = pc.utf8_lower(column)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `size` bytes; a longer row is a range of its own."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def cut_rows(data: np.ndarray, off: np.ndarray, stop: Callable[[np.ndarray], np.ndarray], size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in which rows longer than `size` are cut after bytes where stop() is true, and the row of each part.

    A part is longer than `size` only where no byte in it is such a stop.
    """
    long = np.flatnonzero(np.diff(off) > size)
    if not len(long):
        return off, np.arange(len(off) - 1)
    cuts = [off]
    for r in long:
        at, end = int(off[r]), int(off[r + 1])
        while end - at > size:
            ahead, where = at + size, np.flatnonzero(stop(data[at : at + size]))
            if len(where):
                ahead = at + int(where[-1]) + 1
            else:  # the next stop, wherever it is
                while ahead < end:
                    where = np.flatnonzero(stop(data[ahead : min(end, ahead + size)]))
                    if len(where):
                        ahead += int(where[0]) + 1
                        break
                    ahead = min(end, ahead + size)
            if ahead >= end:
                break
            cuts.append(np.array([ahead]))
            at = ahead
    out = np.sort(np.concatenate(cuts), kind="stable")
    return out, np.maximum(0, np.searchsorted(off, out[:-1], "right") - 1) if len(off) > 1 else np.empty(0, np.int64)


def lower_same_length(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte Latin letters; byte positions stay."""
    out = _LOWER[data]
    if len(data) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        if len(lead):
            v = data[lead]
            up = (v >= 0x80) & (v <= 0x9E) & (v != 0x97)
            out[lead[up]] += 32
    return out


def classes(data: np.ndarray) -> np.ndarray:
    """SPACE, WORD or SYMBOL of each byte. Non-ASCII letters are words; no-break space and general punctuation aren't."""
    cls = _CLASS[data]
    if len(data) > 2:
        at = np.flatnonzero(data[:-2] == 0xE2)
        at = at[(data[at + 1] == 0x80) | (data[at + 1] == 0x81)]
        if len(at):
            blank = (data[at + 1] == 0x80) & ((data[at + 2] <= 0x8B) | (data[at + 2] == 0xA8) | (data[at + 2] == 0xA9) | (data[at + 2] == 0xAF))
            for k in range(3):
                cls[at + k] = np.where(blank, SPACE, SYMBOL)
    if len(data) > 1:
        at = np.flatnonzero(data[:-1] == 0xC2)
        if len(at):
            kind = np.where((data[at + 1] == 0xA0) | (data[at + 1] == 0x85), SPACE, SYMBOL)
            cls[at] = kind
            cls[at + 1] = kind
    return cls


class Runs:
    """Maximal runs of one class within a row: 64-bit hash, byte start and end, row, class."""

    __slots__ = ("cls", "end", "hash", "row", "start")

    def __init__(self, data: np.ndarray, off: np.ndarray, words_only: bool = False, cls: np.ndarray | None = None) -> None:
        n = len(data)
        if n == 0:
            self.hash, self.start, self.end, self.row, self.cls = np.empty(0, U64), *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint8)
            return
        cls = classes(data) if cls is None else cls
        change = np.empty(n, bool)
        change[0] = True
        np.not_equal(cls[1:], cls[:-1], out=change[1:])
        change[off[:-1][off[:-1] < n]] = True
        at = np.flatnonzero(change)
        kind = cls[at]
        end = np.append(at[1:], n)
        keep = kind == WORD if words_only else kind != SPACE
        start, end, kind = at[keep], end[keep], kind[keep]
        self.start, self.end, self.cls = start, end, kind
        self.hash = span_hashes(data, start, end)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Content hashes of sorted byte spans that don't overlap, from a running polynomial sum."""
    out = np.empty(len(start), U64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        if end[lo] - base > block:  # one long span: its blocks' sums are added up
            power, _ = _tables(block)
            h, step, scale = 0, pow(_P, block, 1 << 64), 1
            for a in range(base, int(end[lo]), block):
                part = data[a : min(a + block, int(end[lo]))]
                h = (h + int((_BYTE[part] * power[: len(part)]).sum(dtype=U64)) * scale) % (1 << 64)
                scale = scale * step % (1 << 64)
            out[lo : lo + 1] = mix(np.array([h], U64))
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(end, base + block, "right")))
        part = data[base : int(end[hi - 1])]
        power, inverse = _tables(len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((total[e] - total[s]) * inverse[s])
        lo = hi
    return out


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive tokens of a row, and their rows. Position i is where the n-gram starts."""
    if n == 1 or len(h) < n:
        return (h, row) if n == 1 else (np.empty(0, U64), np.empty(0, np.int64))
    m = len(h) - n + 1
    g = h[:m] * U64(_P)
    for k in range(1, n):
        g = (g ^ (g >> U64(29))) * U64(0xBF58476D1CE4E5B9) + h[k : m + k]
    same = row[:m] == row[n - 1 :]
    return mix(g[same]), row[:m][same]


def row_starts(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets (rows + 1) of each row's entries in a sorted row vector."""
    return np.searchsorted(row, np.arange(rows + 1))


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums by row; rows without entries get 0."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0, dtype=np.float64)
    return out


def row_mins(values: np.ndarray, starts: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(starts) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.minimum.reduceat(values, starts[:-1][full])
    return out
