"""Runs of bytes of any class in a buffer of texts, and their exact local names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strandloom.llm.textblocks import U64, mix, pieces, same_spans, span_hashes


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 truth values: whether a byte lies in one of the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def find_runs(buf: np.ndarray, off: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of ``solid`` bytes; none goes over the border of a text."""
    if not len(buf):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = solid[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def name_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each span, a span of each code): spans of one group with the same bytes share a code.

    Spans meet by hash and are compared byte by byte with the span that stands for their
    code; should two differ, the codes are made from the bytes themselves.
    """
    h = mix(span_hashes(buf, starts, ends) ^ mix(group.astype(U64) + U64(1)))
    _, kept, code = np.unique(h, return_index=True, return_inverse=True)
    stands = kept[code]
    if len(code) and not (same_spans(buf, starts, ends, buf, starts[stands], ends[stands]) & (group == group[stands])).all():
        found: dict[tuple[int, bytes], int] = {}
        data = buf.tobytes()
        keys = [(g, data[a:b]) for g, a, b in zip(group.tolist(), starts.tolist(), ends.tolist())]
        code = np.array([found.setdefault(k, len(found)) for k in keys], dtype=np.int64)
        _, kept = np.unique(code, return_index=True)
    return code, kept


def span_strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column, copied without a Python object each."""
    size = ends - starts
    off = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=off[1:])
    at = np.arange(off[-1], dtype=np.int64) + np.repeat(starts - off[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[at])))


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in chunks of about ``max_bytes`` of text, over the borders of its batches; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch, column, max_bytes):
            n = part.column(part.schema.get_field_index(column)).nbytes
            if held and size + n > max_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += n
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
