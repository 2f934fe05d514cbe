"""Vectorised word, line and hash work on Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` (the class is
ASCII, so bytes of UTF-8 text can be scanned without decoding). All helpers
take whole texts; a batch is cut between documents only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on; one longer document makes a batch of its own.
BATCH_BYTES = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_ROLL = U(0xD1342543DE82EF95)

NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table is kept and grows by doubling."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, dtype=U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have, dtype=U)
        _pow[base] = have
    return have[:n]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (works in place on a fresh array)."""
    z = z ^ (z >> U(30))
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[offs[0] : offs[-1]] if buf is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
    return data, offs - offs[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Give memory that is free in this worker back to the system: it may stay idle beside others for long."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows into parts of about ``limit`` bytes of text."""
    _, offs = raw(batch.column(batch.schema.get_field_index(column)))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b
    release()


class Words:
    """Word spans of a string array: byte starts ``ws``, ends ``we``, and ``ptr`` (n+1) from documents to words."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offs = raw(column)
        data, offs = self.data, self.offs
        if lower:
            data = data.copy()
            up = (data >= 65) & (data <= 90)
            data[up] += 32
            self.data = data
        inside = NONSPACE[data]
        start, end = inside.copy(), inside.copy()
        if len(data):
            start[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            some = offs[:-1] < offs[1:]
            start[offs[:-1][some]] = inside[offs[:-1][some]]
            last = offs[1:][some] - 1
            end[last] = inside[last]
        self.ws, self.we = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.ptr = np.searchsorted(self.ws, offs)
        self.n = np.diff(self.ptr)
        self.inside = inside

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return range_hashes(self.data, self.ws, self.we)

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of document i (those marked in ``keep``) joined by one space."""
        a, b = self.ptr[i], self.ptr[i + 1]
        ws, we = self.ws[a:b], self.we[a:b]
        if keep is not None:
            ws, we = ws[keep], we[keep]
        if not len(ws):
            return b""
        text = self.data[self.offs[i] : self.offs[i + 1]]
        o = self.offs[i]
        mark = np.zeros(len(text) + 1, np.int8)
        np.add.at(mark, ws - o, 1)
        np.add.at(mark, we - o, -1)
        on = np.cumsum(mark[:-1]).astype(bool)
        ends = we[:-1] - o  # the byte after each word but the last becomes the space
        out = text.copy()
        out[ends] = 0x20
        on[ends] = True
        return out[on].tobytes()


def range_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[a:b] for each pair of ends, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        c = np.empty(len(data) + 1, dtype=U)
        c[0] = 0
        np.cumsum((data.astype(U) + U(1)) * powers(_BASE, len(data)), dtype=U, out=c[1:])
        h = (c[b] - c[a]) * powers(_INV, len(data) + 1)[a]
        return mix(h ^ ((b - a).astype(U) * _ROLL))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] at each i; shorter than h by k-1 (empty if h is shorter than k). Built by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    with np.errstate(over="ignore"):
        cur, size = h, 1
        while size * 2 <= k:
            cur = mix(cur[:-size] * _ROLL + cur[size:])
            size *= 2
        if size < k:
            cur = mix(cur[: len(cur) - (k - size)] * _ROLL + cur[k - size :])
        return cur[:n]


def gram_starts(ptr: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which positions begin a k-gram inside one document."""
    ok = np.zeros(max(0, total - k + 1), dtype=bool)
    if len(ok):
        n = np.diff(ptr)
        a = ptr[:-1][n >= k]
        b = ptr[1:][n >= k] - k + 1
        mark = np.zeros(len(ok) + 1, np.int64)
        np.add.at(mark, a, 1)
        np.add.at(mark, b, -1)
        ok = np.cumsum(mark[:-1]) > 0
    return ok


def per_doc(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i]:ptr[i+1]]."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[ptr[1:]] - c[ptr[:-1]]
