"""Vectorised word handling over Arrow text columns.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes outside
space and 0x09-0x0D, i.e. the pattern ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit,
the same on every machine, and computed without a Python object per word.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_LONG = 64


def release() -> None:
    """Give memory of finished work back to the system: Python workers live on between tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row slices of about max_bytes of text; a longer text stands alone."""
    i = batch.schema.get_field_index(column)
    _, off = text_buffer(batch.column(i))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _blocks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on, as one number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span: its blocks of eight bytes are mixed in one after the other, so texts built against sums of powers do no harm.

    Spans of over 64 bytes, few in any text, are digested one by one.
    """
    size = ends - starts
    blocks = _blocks(buf)
    out = mix(size.astype(U64) * U64(_BASE) + U64(1))
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (blocks[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of ``buf`` has the bytes of the span beside it of ``other``."""
    size = ends - starts
    same = size == other_ends - other_starts
    mine, theirs = _blocks(buf), _blocks(other)
    live = np.flatnonzero(same & (size <= _LONG) & (size > 0))
    a, b, left = starts[live], other_starts[live], size[live]
    while len(live):
        ok = (mine[a] ^ theirs[b]) & _MASK[np.minimum(left, 8)] == 0
        same[live[~ok]] = False
        more = ok & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    for i in np.flatnonzero(same & (size > _LONG)).tolist():
        same[i] = np.array_equal(buf[starts[i] : ends[i]], other[other_starts[i] : other_ends[i]])
    return same


class Words:
    """Words of a slice of texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, hashes: bool = True):
        self.buf, self.off = buf, off
        n = len(buf)
        solid = ~_SPACE[buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.word_off = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.word_off)
        self.hashes = self._hash() if hashes else None

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def _hash(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, whether those n words lie in one text)."""
        h = self.hashes
        m = len(h)
        valid = np.zeros(m, dtype=bool)
        out = np.zeros(m, dtype=U64)
        if m >= n:
            acc = h[: m - n + 1].copy()
            for k in range(1, n):
                acc *= U64(_BASE)
                acc ^= acc >> U64(29)
                acc += h[k : m - n + 1 + k]
            out[: m - n + 1] = mix(acc)
            end = np.repeat(self.word_off[1:], self.counts)
            valid[: m - n + 1] = np.arange(n, m + 1) <= end[: m - n + 1]
        return out, valid
