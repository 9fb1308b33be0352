"""k-mers of reads as numbers: tallies and reads that hold some of them, without a row for each occurrence.

Reads are put into chunks of some megabytes of letters. A chunk turns its k-mers into numbers of two bits a
base, mixed by a bijection, sorts them and sends each distinct one once, with its occurrences and neighbour
symbols, as delta-coded arrays to buckets cut by leading bits. A bucket adds up what all chunks sent; where
reads are asked for, it answers each chunk with a bit for each of its k-mers. A frequent k-mer is one entry a chunk,
so none gathers in one place; chunks and buckets grow in number with the reads, not in size. Numbers are exact, never hashes.
What chunks send are rows for each chunk and bucket that meet. Tallies have large chunks and buckets, worked on by pieces, so that these rows
are few, and a chunk sends to ``2 ** FAN_BITS`` buckets at most: where there are more, units of one such bucket's rows are added up and sent on to its
parts. So rows grow in number with the reads there; those of ``stars`` and ``repeats`` do with their square.

k is ``MOST`` at most. k-mers that hold another letter than A, C, G, T are left out; ``kmers`` adds those as rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import checkpoint, ship_package

#: Letters in a chunk, chunks in a file, and k-mers sent to a bucket (those of several chunks count each time).
CHUNK_LETTERS, CHUNKS_A_FILE, BUCKET_KEYS = 3 << 20, 4, 1 << 20
#: Chunks and buckets of ``tally`` and ``holders``, which take less memory a letter, are so many times larger (buckets of long k-mers too).
CHUNK_TIMES, BUCKET_TIMES = 4, 2
#: Chunks of ``stars``, ``meeting`` and ``repeats``.
LONG_TIMES = 2
#: Buckets that a chunk, or a unit of a bucket's rows, sends to at most, as a power of two.
FAN_BITS = 12
#: Places of a chunk, or sorted values, that are worked on at once.
PIECE = 1 << 18
#: The longest k: a k-mer and seven bits for its neighbours and strand are one number of 64 bits.
MOST = 28
#: The longest k of ``stars``, whose k-mers are two numbers.
LONGEST = MOST + 32
U64 = np.uint64
#: 0 to 3 for the bytes A, C, G, T, 4 for all others.
CODE = np.full(256, 4, dtype=np.uint8)
CODE[list(b"ACGT")] = range(4)
_CODE = CODE
#: A neighbour symbol ($, A, C, G, T, other) on the other strand, and its bit.
_TURNED, _BIT = np.array([0, 4, 3, 2, 1, 5], dtype=np.uint8), (1 << np.arange(8)).astype(np.uint8)
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: The eight letters of each number of 16 bits, as bytes of one word.
_EIGHT = np.frombuffer(b"ACGT", dtype=np.uint8)[np.arange(1 << 16)[:, None] >> np.arange(14, -1, -2) & 3].view(U64).reshape(-1)

#: Whether k-mers are kept, from n, m (occurrences of each strand's form), nexts, prevs (forward) or the next symbols of both forms, and own (is its own reverse complement).
Keep = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def maximal(mask: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the symbols of a mask make k-mers maximal: two of them, or an end and two occurrences."""
    return (_ONES[mask] >= 2) | ((n >= 2) & (mask & 1 == 1))


def maximal_either(n: np.ndarray, m: np.ndarray, nexts: np.ndarray, turned: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether one of the two forms occurs and is right-maximal."""
    return ((n > 0) & maximal(nexts, n + m)) | (~own & (m > 0) & maximal(turned, n + m))


def release() -> None:
    """Give memory of finished work back: Python workers live on and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def _planes(*arrays: np.ndarray) -> np.ndarray:
    """The bytes of arrays of one length, a row for each place of a byte in its number."""
    out, i = np.zeros((sum(x.itemsize for x in arrays), len(arrays[0])), dtype=np.uint8), 0
    for x in arrays:
        x = np.ascontiguousarray(x).view(f"<u{x.itemsize}")
        most, cells = int(x.max(initial=0)), x.view(np.uint8).reshape(len(x), x.itemsize)
        for j in range(x.itemsize):
            if most >> 8 * j:  # most high bytes are zero
                out[i + j] = cells[:, j]
        i += x.itemsize
    return out


def _packed(planes: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes."""
    return _packed(_planes(*arrays))


def unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    return unpack_all([blob], [n], *kinds)


def unpack_all(blobs: list[bytes], sizes: list[int], *kinds: str) -> list[np.ndarray]:
    """The arrays of several blobs, one after the other; put together from bytes at once, as blobs may be small."""
    widths = [np.dtype(k).itemsize for k in kinds]
    parts = [np.frombuffer(pa.decompress(blob, n * sum(widths), codec="zstd"), dtype=np.uint8).reshape(sum(widths), n) for blob, n in zip(blobs, sizes)]
    planes = parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)
    out, end = [], 0
    for kind, width in zip(kinds, widths):
        cells = np.empty((planes.shape[1], width), dtype=np.uint8)
        for j in range(width):
            cells[:, j] = planes[end + j]
        out.append(cells.reshape(-1).view(kind))
        end += width
    return out


def _pieces(batches: Iterator[pa.RecordBatch], more: int = 0, times: int = 1) -> Iterator[pa.Table]:
    """Reads of a task in chunks of about ``times`` ``CHUNK_LETTERS``; a longer read stands alone. A read counts for ``more`` letters than it has."""
    held, size, most = [], 0, times * CHUNK_LETTERS
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column("seq"))).astype(np.int64) + more
        cut = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            n = int(sizes[a:b].sum())
            if held and size + n > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += n
    if size:
        yield pa.Table.from_batches(held)


@dataclass
class Chunks:
    """A row for each chunk of reads: part, reads, n (letters), others (than A, C, G, T), letters, sizes, ids (of the column ``key``, a long)."""

    rows: DataFrame
    total: int
    others: int


def chunked(reads: DataFrame, key: str | None = None, empty: bool = False, times: int = 1) -> Chunks:
    """Null reads are left out, and empty ones unless ``empty``. Chunks have ``times`` the usual size."""
    ship_package(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _pieces(batches, 32 if empty else 0, times):
            text = chunk.column("seq").cast(pa.large_string()).combine_chunks()
            text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
            off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            codes = CODE[np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]]
            ids = np.asarray(chunk.column(key)).astype(np.int64) if key else np.zeros(0, dtype=np.int64)
            row = {"reads": len(text), "n": len(codes), "others": int((codes > 3).sum()), "letters": pack(codes), "sizes": pack(np.diff(off).astype(np.uint32)), "ids": pack(np.diff(ids, prepend=0))}
            release()
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("reads", pa.int32()), ("n", pa.int64()), ("others", pa.int64()), ("letters", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())]))

    rows = reads.where("seq IS NOT NULL" if empty else "seq <> ''").select("seq", *([key] if key else [])).mapInArrow(run, "reads int, n long, others long, letters binary, sizes binary, ids binary")
    rows = checkpoint(rows.withColumn("part", F.monotonically_increasing_id()), max(1, CHUNKS_A_FILE // times))
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n", "others"))).first()
    return Chunks(rows, sums["n"], sums["others"])


def numbers(codes: np.ndarray, k: int, turned: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The k letters from each place on as a number, and their reverse complement. Pieces of 1, 2, 4 ... letters are put together."""
    fwd = (codes & 3).astype(U64)
    rev = U64(3) - fwd if turned else None
    step, have, own, back = 1, 0, None, None
    while True:
        if k & step:
            n = len(codes) - have - step + 1
            add = fwd[have : have + n]
            own = add if own is None else own[:n] << U64(2 * step) | add
            if turned:
                back = rev[have : have + n] if back is None else rev[have : have + n] << U64(2 * have) | back[:n]
            have += step
        if have == k:
            return own, back
        n = len(codes) - 2 * step + 1
        fwd = fwd[:n] << U64(2 * step) | fwd[step : step + n]
        rev = rev[step : step + n] << U64(2 * step) | rev[:n] if turned else None
        step *= 2


def turn(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of reverse complements."""
    x = ~x
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = (x >> U64(shift)) & U64(mask) | (x & U64(mask)) << U64(shift)
    return (x >> U64(32) | x << U64(32)) >> U64(64 - 2 * k)


_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """A bijection of the numbers of k letters, so that buckets by leading bits are even."""
    mask = U64((1 << 2 * k) - 1)
    x = (x ^ x >> U64(k)) * U64(_A) & mask
    return (x ^ x >> U64(k)) * U64(_B) & mask


def unmixed(x: np.ndarray, k: int) -> np.ndarray:
    mask = U64((1 << 2 * k) - 1)
    x = x * U64(pow(_B, -1, 1 << 64)) & mask
    x = (x ^ x >> U64(k)) * U64(pow(_A, -1, 1 << 64)) & mask
    return x ^ x >> U64(k)


def letters(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` letters of numbers, as rows of bytes."""
    words = -(-k // 8)
    x, out = x << U64(2 * (8 * words - k)), np.empty((len(x), words), dtype=U64)
    for j in range(words):
        out[:, j] = _EIGHT[(x >> U64(16 * (words - 1 - j))).astype(np.uint16)]
    return np.ascontiguousarray(out.view(np.uint8).reshape(len(x), 8 * words)[:, :k])


def strings(x: np.ndarray, k: int) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(x), pa.py_buffer((np.arange(len(x) + 1) * k).astype(np.int32)), pa.py_buffer(letters(x, k)))


def _heads(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]]))


class _Chunk:
    """The k-mers of a chunk. ``good`` tells the places where one begins."""

    def __init__(self, row: dict, k: int, strands: bool) -> None:
        (self.codes,), (sizes,) = unpack(row["letters"], row["n"], "u1"), unpack(row["sizes"], row["reads"], "<u4")
        self.k, self.strands, self.sizes = k, strands, sizes
        ends = np.cumsum(sizes, dtype=np.int64)
        long = sizes >= k
        self.starts, self.stops = (ends - sizes)[long], ends[long] - k + 1
        edge = np.zeros(len(self.codes) + 1, dtype=np.int8)
        edge[self.starts] += 1
        edge[self.stops] -= 1
        self.good = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        if len(self.codes) >= k and self.codes.max() > 3:
            before = np.concatenate([[0], np.cumsum(self.codes > 3, dtype=np.int32)])
            self.good[: len(self.codes) - k + 1] &= before[k:] == before[:-k]

    def keys(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(first place, good, mixed numbers, whether the smaller form is on the other strand) of each piece."""
        for p in range(0, len(self.codes) - self.k + 1, PIECE):
            good = self.good[p : min(p + PIECE, len(self.codes) - self.k + 1)]
            key, back = (x if x is None else x[good] for x in numbers(self.codes[p : p + len(good) + self.k - 1], self.k, self.strands))
            yield p, good, mixed(np.minimum(key, back) if self.strands else key, self.k), back < key if self.strands else None

    def values(self, masks: bool) -> np.ndarray:
        """Sorted: the mixed number, two neighbour symbols and the strand of each k-mer."""
        out, n = np.empty(np.count_nonzero(self.good), dtype=U64), 0
        if masks:  # 0 at an end, else the neighbour's code and 1
            after, before = np.zeros(len(self.codes), dtype=np.uint8), np.zeros(len(self.codes), dtype=np.uint8)
            after[: max(0, len(self.codes) - self.k)] = self.codes[self.k :] + 1
            before[1:] = self.codes[:-1] + 1
            after[self.stops - 1] = before[self.starts] = 0
        for p, good, key, side in self.keys():
            value = key << U64(7)
            if side is not None:
                value |= side.astype(U64)
            if masks:
                a, b = after[p : p + len(good)][good], before[p : p + len(good)][good]
                if side is not None:
                    b = _TURNED[b]
                    a, b = np.where(side, b, a), np.where(side, a, b)
                value |= (a << np.uint8(4) | b << np.uint8(1)).astype(U64)
            out[n : n + len(key)] = value
            n += len(key)
        out.sort()
        return out

    def holding(self, flags: np.ndarray) -> np.ndarray:
        """Numbers of the reads that hold a flagged k-mer; a flag for each distinct one in their order."""
        read = np.repeat(np.arange(len(self.sizes), dtype=np.uint32), self.sizes)
        bits = U64(len(self.sizes).bit_length())
        if 2 * self.k + int(bits) <= 64:
            value, n = np.empty(np.count_nonzero(self.good), dtype=U64), 0
            for p, good, key, _ in self.keys():
                value[n : n + len(key)] = key << bits | read[p : p + len(good)][good]
                n += len(key)
            value.sort()
            key, read = value >> bits, value & ((U64(1) << bits) - U64(1))
        else:
            key = np.concatenate([key for _, _, key, _ in self.keys()])
            order = np.argsort(key, kind="stable")
            key, read = key[order], read[self.good][order]
        held = np.zeros(len(self.sizes), dtype=bool)
        held[read[np.repeat(flags, np.diff(_heads(key), append=len(key)))]] = True
        return np.flatnonzero(held)


def _kinds(k: int, bits: int, strands: bool, masks: bool, wide: bool = False) -> list[str]:
    """Of what is sent for a k-mer: the bits that its bucket does not tell, occurrences of each strand's form (``wide``: of several chunks), masks."""
    count = "<i8" if wide else "<u4"
    return ["<u4" if 2 * k - bits <= 32 else "<u8", count, *([count] if strands else []), *(["u1", "u1"] if masks else [])]


_SENT = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])


def _rows(key: np.ndarray, arrays: list[np.ndarray], kinds: list[str], first: int, last: int, low: U64) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, n, blob) for each of the buckets ``first`` to ``last`` that distinct sorted k-mers lie in; ``low`` bits are not told by a bucket."""
    cuts = np.append(np.searchsorted(key, np.arange(first, last, dtype=U64) << low), len(key))
    own = np.diff(key, prepend=U64(0))
    begins = cuts[:-1][cuts[:-1] < cuts[1:]]
    own[begins] = key[begins] & ((U64(1) << low) - U64(1))
    planes = _planes(*(x.astype(kind) for x, kind in zip([own, *arrays], kinds)))
    for j, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if a < b:
            yield first + j, b - a, _packed(planes[:, a:b])


def _blobs(value: np.ndarray, k: int, bits: int, strands: bool, masks: bool) -> dict[str, list]:
    """What a chunk sends, from its sorted values: a row for each bucket."""
    low, kinds = U64(2 * k - bits), _kinds(k, bits, strands, masks)
    edges = np.concatenate([[0], np.searchsorted(value, np.arange(1, 1 << bits, dtype=U64) << low + U64(7)), [len(value)]])
    found: list[tuple[int, int, bytes]] = []
    first = 0
    while first < 1 << bits:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + PIECE, "right")) - 1)
        part = value[edges[first] : edges[last]]
        key = part >> U64(7)
        head = _heads(key)
        key, n = key[head], np.diff(head, append=len(part))
        if len(head):
            arrays = [n]
            if strands:
                m = np.add.reduceat(part & U64(1), head)
                arrays = [n - m.astype(np.int64), m]
            if masks:
                arrays += [np.bitwise_or.reduceat(_BIT[(part >> U64(shift)).astype(np.uint8) & 7], head) for shift in (4, 1)]
            found += _rows(key, arrays, kinds, first, last, low)
        first = last
    return dict(zip(("bucket", "n", "blob"), map(list, zip(*found)))) if found else {"bucket": [], "n": [], "blob": []}


def _goal(chunks: Chunks, k: int) -> int:
    """Leading bits of the last buckets."""
    return min((max(1, chunks.total // (BUCKET_TIMES * BUCKET_KEYS)) - 1).bit_length(), 2 * k)


def _sent(chunks: Chunks, k: int, strands: bool, masks: bool) -> tuple[DataFrame, int]:
    bits = min(_goal(chunks, k), FAN_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                out = _blobs(_Chunk(row, k, strands).values(masks), k, bits, strands, masks)
                release()
                out["part"] = [row["part"]] * len(out["n"])
                yield pa.record_batch([pa.array(out[f.name], f.type) for f in _SENT], schema=_SENT)

    return chunks.rows.select("part", "reads", "n", "letters", "sizes").mapInArrow(run, "bucket long, part long, n int, blob binary"), bits


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of so many bits sorted, and their order; sorted together as one number where that has room."""
    place = U64(len(key).bit_length())
    if bits + int(place) > 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = key << place | np.arange(len(key), dtype=U64)
    both.sort()
    return both >> place, (both & ((U64(1) << place) - U64(1))).astype(np.int64)


def _added(group: pa.Table, k: int, bits: int, strands: bool, masks: bool, wide: bool = False) -> tuple:
    """(sizes of what was sent, order of the sent k-mers, times that each distinct one was sent; numbers, n, m, nexts and prevs)."""
    sizes = group.column("n").to_pylist()
    own, *rest = unpack_all(group.column("blob").to_pylist(), sizes, *_kinds(k, bits, strands, masks, wide))
    key, ends = np.empty(len(own), dtype=U64), np.cumsum([0, *sizes]).tolist()
    for a, b in zip(ends[:-1], ends[1:]):
        np.cumsum(own[a:b], dtype=U64, out=key[a:b])
    key, order = _ordered(key, 2 * k - bits)
    head = _heads(key)
    number = unmixed(key[head] | U64(group.column("bucket")[0].as_py()) << U64(2 * k - bits), k)
    sums = [np.add.reduceat(x[order], head, dtype=np.int64) for x in rest[: 2 if strands else 1]]
    ors = [np.bitwise_or.reduceat(x[order], head) for x in (rest[-2:] if masks else ())]
    sums += [np.zeros(len(head), dtype=np.int64)] * (2 - len(sums))
    ors += [np.zeros(len(head), dtype=np.uint8)] * (2 - len(ors))
    return sizes, order, np.diff(head, append=len(key)), number, *sums, *ors


@dataclass
class _Sending:
    """What goes to ``2 ** bits`` buckets: bucket, part (who sent it), n (k-mers), blob. ``goal``: the bits of the last buckets. ``wide``: see ``_kinds``."""

    rows: DataFrame
    bits: int
    total: int
    k: int
    strands: bool
    masks: bool
    goal: int
    wide: bool = False

    @property
    def step(self) -> int:
        """Bits by which buckets get smaller in the next sending, 0 after the last."""
        return min(FAN_BITS, self.goal - self.bits)

    def units(self) -> DataFrame:
        """Rows with ``unit``: those of a bucket and unit hold about as many k-mers as one of the last buckets."""
        n = max(1, -(-(self.total >> self.bits) // (BUCKET_TIMES * BUCKET_KEYS)))
        return self.rows.withColumn("unit", F.expr(f"pmod(xxhash64(part), {n}L)"))

    def adder(self) -> Callable[[pa.Table], tuple]:
        """``_added`` for these rows; it holds no DataFrame, so it can go to executors."""
        k, bits, strands, masks, wide = self.k, self.bits, self.strands, self.masks, self.wide
        return lambda group: _added(group, k, bits, strands, masks, wide)

    def sent_on(self) -> _Sending:
        """Each unit's k-mers added up and sent to the parts of its bucket."""
        k, strands, masks, before, bits = self.k, self.strands, self.masks, self.bits, self.bits + self.step
        added, kinds = self.adder(), _kinds(self.k, bits, self.strands, self.masks, wide=True)

        def run(group: pa.Table) -> pa.Table:
            bucket = group.column("bucket")[0].as_py()
            _, _, _, number, n, m, nexts, prevs = added(group)
            arrays = [n, *([m] if strands else []), *([nexts, prevs] if masks else [])]
            rows = _rows(mixed(number, k), arrays, kinds, bucket << (bits - before), (bucket + 1) << (bits - before), U64(2 * k - bits))
            buckets, sizes, blobs = zip(*rows)
            release()
            return pa.table([buckets, [group.column("unit")[0].as_py()] * len(buckets), sizes, blobs], schema=_SENT)

        rows = self.units().groupBy("bucket", "unit").applyInArrow(run, "bucket long, part long, n int, blob binary")
        return _Sending(rows, bits, self.total, k, strands, masks, self.goal, wide=True)


def _own(number: np.ndarray, k: int, strands: bool, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, masks): a k-mer that is its own reverse complement has the symbols of both sides under one form."""
    own = number == turn(number, k) if strands else np.zeros(len(number), dtype=bool)
    return own, np.where(own, first | second, first), np.where(own, 0, second).astype(np.uint8)


def tally(chunks: Chunks, k: int, strands: bool = False, masks: bool = True, keep: Keep | None = None, turned: bool = False) -> DataFrame:
    """kmer, n, with ``strands`` m and own, with ``masks`` first and second, with ``turned`` rc (the reverse complement) of the k-mers that ``keep`` keeps.

    Forward: n occurrences, masks of next and previous symbols. With ``strands`` a k-mer and its
    reverse complement share the smaller form: n and m are occurrences of the smaller and the larger,
    the masks the next symbols of each on both strands.
    """
    sent = _Sending(*_sent(chunks, k, strands, masks), chunks.total, k, strands, masks, _goal(chunks, k))
    while sent.step:
        sent = sent.sent_on()
    added = sent.adder()
    names = {"kmer": "string", "n": "long"} | ({"m": "long", "own": "boolean"} if strands else {}) | ({"first": "int", "second": "int"} if masks else {}) | ({"rc": "string"} if turned else {})

    def add(group: pa.Table) -> pa.Table:
        _, _, _, number, n, m, first, second = added(group)
        own, first, second = _own(number, k, strands, first, second)
        kept = np.flatnonzero(keep(n, m, first, second, own)) if keep else np.arange(len(n))
        batches = []
        for a in range(0, max(1, len(kept)), PIECE):  # a batch is held whole by the JVM
            at = kept[a : a + PIECE]
            out = {"kmer": strings(number[at], k), "n": n[at], "m": m[at], "own": own[at], "first": first[at].astype(np.int32), "second": second[at].astype(np.int32)}
            if turned:
                out["rc"] = strings(turn(number[at], k), k)
            batches.append(pa.record_batch({c: out[c] for c in names}))
        release()
        return pa.Table.from_batches(batches)

    return sent.rows.groupBy("bucket").applyInArrow(add, ", ".join(f"{c} {t}" for c, t in names.items()))


_TOLD = "part long, bucket long, n int, flags binary"


def _told(group: pa.Table, flag: np.ndarray, sizes: list[int], order: np.ndarray, times: np.ndarray) -> pa.Table:
    """What a group's k-mers were found to be, from a flag for each distinct one: a row for each of its rows."""
    flags = np.empty(len(order), dtype=bool)
    flags[order] = np.repeat(flag, times)
    ends = np.cumsum([0, *sizes])
    out = pa.table({"part": group.column("part"), "bucket": group.column("bucket"), "n": group.column("n"), "flags": pa.array([pa.compress(np.packbits(flags[a:b]).tobytes(), codec="zstd", asbytes=True) for a, b in zip(ends[:-1], ends[1:])], pa.binary())})
    release()
    return out


def _flags(answer: pa.Table) -> np.ndarray:
    """The flags of rows of ``_TOLD`` in the order of their buckets."""
    rows = sorted(zip(*(answer.column(c).to_pylist() for c in ("bucket", "n", "flags"))))
    return np.concatenate([np.unpackbits(np.frombuffer(pa.decompress(f, -(-n // 8), codec="zstd", asbytes=True), dtype=np.uint8), count=n) for _, n, f in rows]).astype(bool)


def holders(chunks: Chunks, k: int, keep: Keep, strands: bool = False, masks: bool = True) -> DataFrame:
    """read_id of the reads that hold a k-mer that ``keep`` keeps; ``chunks`` have ids."""

    def judge(group: pa.Table, added: Callable[[pa.Table], tuple]) -> pa.Table:
        sizes, order, times, number, n, m, first, second = added(group)
        own, first, second = _own(number, k, strands, first, second)
        return _told(group, keep(n, m, first, second, own), sizes, order, times)

    def answered(sent: _Sending) -> DataFrame:
        """part, bucket, n, flags: a bit for each k-mer of ``sent``."""
        added, step = sent.adder(), sent.step
        if not step:
            return checkpoint(sent.rows.groupBy("bucket").applyInArrow(lambda group: judge(group, added), _TOLD))  # what was sent goes from the disk here

        def back(group: pa.Table, answer: pa.Table) -> pa.Table:
            sizes, order, times = added(group)[:3]
            return _told(group, _flags(answer), sizes, order, times)

        sent.rows = checkpoint(sent.rows, 1 << FAN_BITS)  # units are made twice
        answers = answered(sent.sent_on()).select(F.expr(f"shiftright(bucket, {step})").alias("above"), F.col("part").alias("unit"), "bucket", "n", "flags")
        return checkpoint(sent.units().groupBy("bucket", "unit").cogroup(answers.groupBy("above", "unit")).applyInArrow(back, _TOLD))

    def find(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        if not (chunk.num_rows and answer.num_rows):
            return pa.table({"read_id": pa.array([], pa.int64())})
        row = chunk.to_pylist()[0]
        ids = np.cumsum(unpack(row["ids"], row["reads"], "<i8")[0])[_Chunk(row, k, strands).holding(_flags(answer))]
        release()
        return pa.table({"read_id": ids})

    answers = answered(_Sending(*_sent(chunks, k, strands, masks), chunks.total, k, strands, masks, _goal(chunks, k)))
    return chunks.rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(find, "read_id long")


def _pair_order(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """The order of pairs by ``low`` (of so many bits) and ``high``; equal ones keep their order.

    Leading bits are sorted with the places as one number; pairs are compared only where those tie and the pairs differ.
    """
    n = len(low)
    place = n.bit_length()
    value = low >> U64(max(0, bits + place - 64)) << U64(place) | np.arange(n, dtype=U64)
    value.sort()
    order, key = (value & U64((1 << place) - 1)).astype(np.int64), value >> U64(place)
    first, second = low[order], high[order]
    tied = np.concatenate([[False], key[1:] == key[:-1]])[:n]
    differ = tied[1:] & ((first[1:] != first[:-1]) | (second[1:] != second[:-1]))
    if differ.any():
        group = np.cumsum(~tied)
        torn = np.zeros(int(group[-1]) + 1, dtype=bool)
        torn[group[1:][differ]] = True
        some = np.flatnonzero(torn[group])
        order[some] = order[some][np.lexsort((second[some], first[some], group[some]))]
    return order


class _Long:
    """k-mers of a chunk in two numbers, ``low`` the mixed last letters (``MOST`` at most) and ``high`` those before; sorted.

    ``at`` are the places of all occurrences in this order, ``head`` those among them where a k-mer begins, ``read`` the read (its number in the chunk) of each place, ``ids`` the reads'
    ids; with ``strands`` ``side`` tells whether the smaller form is on the other strand.
    """

    def __init__(self, row: dict, k: int, strands: bool) -> None:
        made, tail = _Chunk(row, k, strands), min(k, MOST)
        self.k, self.codes, self.ids = k, made.codes, np.cumsum(unpack(row["ids"], row["reads"], "<i8")[0])
        self.ends, self.read = np.cumsum(made.sizes, dtype=np.int64), np.repeat(np.arange(len(made.sizes), dtype=np.int32), made.sizes)
        at = np.flatnonzero(made.good)
        low, high, side, n = np.empty(len(at), dtype=U64), np.zeros(len(at), dtype=U64), np.zeros(len(at) if strands else 0, dtype=bool), 0
        for p in range(0, len(made.codes) - k + 1, PIECE):
            good = made.good[p : min(p + PIECE, len(made.codes) - k + 1)]
            part, size = made.codes[p : p + len(good) + k - 1], len(good)
            own, back = numbers(part, tail, strands)
            some = own[k - tail : k - tail + size][good]
            until = n + len(some)
            if k > tail:
                more, more_back = numbers(part, k - tail, strands)
                high[n:until] = more[:size][good]
            if strands:
                turned = back[:size][good]
                turned_high = more_back[tail : tail + size][good] if k > tail else high[n:until]
                other = (turned_high < high[n:until]) | ((turned_high == high[n:until]) & (turned < some))
                some, high[n:until], side[n:until] = np.where(other, turned, some), np.where(other, turned_high, high[n:until]), other
            low[n:until] = mixed(some, tail)
            n = until
        order = _pair_order(low, high, 2 * tail)
        low, high, self.at = low[order], high[order], at[order]
        self.side = side[order] if strands else side
        self.head = _runs(low, high)
        self.low, self.high = low[self.head], high[self.head]

    def after(self) -> np.ndarray:
        """The next symbol of each occurrence, 0 at an end of a read, else the letter's code and 1."""
        at = self.at + self.k
        return np.where(at < self.ends[self.read[self.at]], np.append(self.codes, 0)[np.minimum(at, len(self.codes))] + 1, 0).astype(np.uint8)

    def before(self) -> np.ndarray:
        """The symbol before each occurrence, in the same codes."""
        at = np.maximum(self.at - 1, 0)
        return np.where((self.at > 0) & (self.read[at] == self.read[self.at]), self.codes[at] + 1, 0).astype(np.uint8)

    def blobs(self, low_bits: U64, *arrays: np.ndarray) -> dict[str, list]:
        """bucket, n, blob of what is sent: the k-mers with arrays of one value each."""
        own, begins = np.diff(self.low, prepend=U64(0)), _heads(self.low >> low_bits)
        own[begins] = self.low[begins] & ((U64(1) << low_bits) - U64(1))
        planes = _planes(own, self.high, *arrays) if len(own) else None
        ends = np.append(begins, len(own)).tolist()
        return {
            "bucket": (self.low[begins] >> low_bits).astype(np.int64).tolist(), "n": np.diff(ends).tolist(),
            "blob": [_packed(planes[:, a:b]) for a, b in zip(ends[:-1], ends[1:])],
        }


def _runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(low)), dtype=bool), (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))


def _long_bits(chunks: Chunks, k: int) -> tuple[int, U64]:
    """Leading bits of the buckets of long k-mers, and the bits of ``low`` that a bucket does not tell."""
    tail = min(k, MOST)
    bits = min((max(1, chunks.total // (BUCKET_TIMES * BUCKET_KEYS)) - 1).bit_length(), 2 * tail)
    return bits, U64(2 * tail - bits)


_SENT_LONG = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("base", pa.int64()), ("blob", pa.binary())])


def _sent_long(chunks: Chunks, k: int, strands: bool, told: Callable[[_Long], tuple[int, list[np.ndarray]]]) -> DataFrame:
    """bucket, part, n, base, blob: what ``told`` tells of the distinct k-mers of each chunk, a number for the whole chunk and arrays."""
    low_bits = _long_bits(chunks, k)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                made = _Long(row, k, strands)
                base, arrays = told(made) if len(made.head) else (0, [])
                out = made.blobs(low_bits, *arrays)
                del made, arrays
                release()
                out["part"], out["base"] = [row["part"]] * len(out["n"]), [base] * len(out["n"])
                yield pa.record_batch([pa.array(out[f.name], f.type) for f in _SENT_LONG], schema=_SENT_LONG)

    return chunks.rows.select("part", "reads", "n", "letters", "sizes", "ids").mapInArrow(run, "bucket long, part long, n int, base long, blob binary")


def _joined(group: pa.Table, bits: int, *kinds: str) -> tuple:
    """(sizes of what was sent, bases, order of the sent k-mers, where distinct ones begin in it; low, high and arrays as they were sent)."""
    sizes = group.column("n").to_pylist()
    low, *rest = unpack_all(group.column("blob").to_pylist(), sizes, "<u8", "<u8", *kinds)
    ends = np.cumsum([0, *sizes]).tolist()
    for a, b in zip(ends[:-1], ends[1:]):
        np.cumsum(low[a:b], dtype=U64, out=low[a:b])
    order = _pair_order(low, rest[0], bits)
    return sizes, np.repeat(group.column("base").to_numpy(), sizes), order, _runs(low[order], rest[0][order]), low, *rest


def stars(chunks: Chunks, k: int, strands: bool = False) -> DataFrame:
    """(rep, read_id): each read of a k-mer with the smallest read that holds it, each pair once. k is ``LONGEST`` at most, and a read_id has one read.

    A chunk sends each of its k-mers with its smallest read; buckets answer with the smallest of all where another read holds the k-mer.
    """
    low_bits = int(_long_bits(chunks, k)[1])

    def told(made: _Long) -> tuple[int, list[np.ndarray]]:
        ids = made.ids[made.read[made.at]]
        least, most = np.minimum.reduceat(ids, made.head), np.maximum.reduceat(ids, made.head)
        base = int(least.min())
        return base, [least - base, (most > least).astype(np.uint8)]

    def judge(group: pa.Table) -> pa.Table:
        sizes, base, order, head, _, _, least, more = _joined(group, low_bits, "<i8", "u1")
        least = (least + base)[order]
        rep = np.minimum.reduceat(least, head)
        shared = np.maximum.reduceat(more[order], head).astype(bool) | (np.maximum.reduceat(least, head) > rep)
        times = np.diff(head, append=len(order))
        reps, flags = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=bool)
        reps[order], flags[order] = np.repeat(rep, times), np.repeat(shared, times)
        ends = np.cumsum([0, *sizes])
        pairs = list(zip(ends[:-1], ends[1:]))
        out = {
            "part": group.column("part"), "bucket": group.column("bucket"), "n": group.column("n"),
            "flags": pa.array([pa.compress(np.packbits(flags[a:b]).tobytes(), codec="zstd", asbytes=True) for a, b in pairs], pa.binary()),
            "reps": pa.array([pack(reps[a:b][flags[a:b]]) for a, b in pairs], pa.binary()),
        }
        release()
        return pa.table(out)

    def find(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        none = pa.table({"rep": pa.array([], pa.int64()), "read_id": pa.array([], pa.int64())})
        if not (chunk.num_rows and answer.num_rows):
            return none
        made = _Long(chunk.to_pylist()[0], k, strands)
        rows = sorted(zip(*(answer.column(c).to_pylist() for c in ("bucket", "n", "flags", "reps"))))
        flags = [np.unpackbits(np.frombuffer(pa.decompress(f, -(-n // 8), codec="zstd", asbytes=True), dtype=np.uint8), count=n).astype(bool) for _, n, f, _ in rows]
        reps = unpack_all([r for *_, r in rows], [int(f.sum()) for f in flags], "<i8")[0]
        flags, times = np.concatenate(flags), np.diff(made.head, append=len(made.at))
        rep, read = np.repeat(reps, times[flags]), made.read[made.at[np.repeat(flags, times)]]
        other = rep != made.ids[read]
        rep, read = rep[other], read[other]
        if not len(rep):
            return none
        base, bits = int(rep.min()), len(made.ids).bit_length()
        if (int(rep.max()) - base).bit_length() + bits <= 64:  # both are one number
            value = (rep - base).astype(U64) << U64(bits) | read.astype(U64)
            value.sort()
            value = value[_heads(value)]
            rep, read = (value >> U64(bits)).astype(np.int64) + base, (value & U64((1 << bits) - 1)).astype(np.int64)
        else:
            order = np.lexsort((read, rep))
            rep, read = rep[order], read[order]
            kept = _runs(rep, read)
            rep, read = rep[kept], read[kept]
        out = pa.table({"rep": rep, "read_id": made.ids[read]})
        release()
        return out

    answers = checkpoint(_sent_long(chunks, k, strands, told).groupBy("bucket").applyInArrow(judge, "part long, bucket long, n int, flags binary, reps binary"))  # what was sent goes from the disk here
    return chunks.rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(find, "rep long, read_id long")


def meeting(chunks: Chunks, k: int) -> DataFrame:
    """kmer, r, r2 of k-mers that are smaller than their reverse complement, where both forms occur and are right-maximal on both strands: the smallest read of each form.

    k is ``LONGEST`` at most. A chunk sends each of its k-mers once, with occurrences, next symbols and smallest reads of both forms.
    """
    tail, (bits, low_bits) = min(k, MOST), _long_bits(chunks, k)

    def told(made: _Long) -> tuple[int, list[np.ndarray]]:
        ids, after, before = made.ids[made.read[made.at]], made.after(), _TURNED[made.before()]
        base, far = int(ids.min()), int(ids.max()) - int(ids.min()) + 1  # ``far``: no read
        nexts = np.bitwise_or.reduceat(_BIT[np.where(made.side, before, after)], made.head)
        turned = np.bitwise_or.reduceat(_BIT[np.where(made.side, after, before)], made.head)
        own, other = (np.minimum.reduceat(np.where(made.side == side, ids - base, far), made.head) for side in (False, True))
        return base, [nexts, turned, np.diff(made.head, append=len(made.at)).astype("<u4"), np.where(own == far, 0, own + 1), np.where(other == far, 0, other + 1)]

    def judge(group: pa.Table) -> pa.Table:
        _, base, order, head, low, high, nexts, turned, times, own, other = _joined(group, int(low_bits), "u1", "u1", "<u4", "<i8", "<i8")
        n = np.add.reduceat(times[order].astype(np.int64), head)
        nexts, turned = (np.bitwise_or.reduceat(x[order], head) for x in (nexts, turned))
        none = np.iinfo(np.int64).max
        r, r2 = (np.minimum.reduceat(np.where(x > 0, x - 1 + base, none)[order], head) for x in (own, other))
        kept = np.flatnonzero((r < none) & (r2 < none) & maximal(nexts, n) & maximal(turned, n))
        low = low[order][head][kept] | U64(group.column("bucket")[0].as_py()) << low_bits
        out = pa.table({"low": low.view(np.int64), "high": high[order][head][kept].view(np.int64), "r": r[kept], "r2": r2[kept]})
        release()
        return out

    found = _sent_long(chunks, k, True, told).groupBy("bucket").applyInArrow(judge, "low long, high long, r long, r2 long")
    return named(found, k, "r", "r2")


def repeats(chunks: Chunks, k: int, places: bool = False) -> DataFrame:
    """low, high (the k-mer as two numbers, see ``named``), read_id, between of each occurrence of a right-maximal k-mer that occurs twice or more.

    ``between`` are the letters from the nearest such occurrence before it in its read, null where there is none; with ``places`` there is pos, its place in the read, instead. k is
    ``LONGEST`` at most. A chunk sends each of its k-mers once, with its occurrences and next symbols; a bucket answers with a bit.
    """
    last = ("pos", pa.int64(), "long") if places else ("between", pa.string(), "string")

    def find(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        names = {"low": pa.int64(), "high": pa.int64(), "read_id": pa.int64(), last[0]: last[1]}
        if not (chunk.num_rows and answer.num_rows):
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        made = _Long(chunk.to_pylist()[0], k, False)
        flags = _flags(answer)
        times = np.diff(made.head, append=len(made.at))
        which = np.repeat(np.flatnonzero(flags), times[flags])
        at = made.at[np.repeat(flags, times)]
        order = np.argsort(at)
        at, which = at[order], which[order]
        read = made.read[at]
        out = {"low": made.low[which].view(np.int64), "high": made.high[which].view(np.int64), "read_id": made.ids[read]}
        if places:
            out["pos"] = at - np.concatenate([[0], made.ends])[read]
        else:
            first = np.diff(read, prepend=-1) != 0
            size = np.where(first, 0, np.diff(at, prepend=0))
            inside = np.zeros(len(made.codes) + 1, dtype=np.int32)
            inside[(at - size)[~first]] += 1  # a stretch begins where the one before ends
            inside[at[~first]] -= 1
            text = np.frombuffer(b"ACGT", dtype=np.uint8)[made.codes[np.flatnonzero(np.cumsum(inside)[:-1])] & 3]
            valid = np.packbits(~first, bitorder="little")
            out["between"] = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.cumsum([0, *size]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text)), pa.py_buffer(valid))
        release()
        return pa.table(out)

    return _answered(chunks, _repeated(chunks, k), find, f"low long, high long, read_id long, {last[0]} {last[2]}")


def _answered(chunks: Chunks, answers: DataFrame, find: Callable[[pa.Table, pa.Table], pa.Table], sql: str) -> DataFrame:
    rows = chunks.rows.select("part", "reads", "n", "letters", "sizes", "ids")
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(find, sql)


def _repeated(chunks: Chunks, k: int) -> DataFrame:
    """Which k-mers of each chunk are right-maximal and occur twice or more, as ``_TOLD``."""
    low_bits = int(_long_bits(chunks, k)[1])

    def told(made: _Long) -> tuple[int, list[np.ndarray]]:
        return 0, [np.diff(made.head, append=len(made.at)).astype("<u4"), np.bitwise_or.reduceat(_BIT[made.after()], made.head)]

    def judge(group: pa.Table) -> pa.Table:
        sizes, _, order, head, _, _, times, nexts = _joined(group, low_bits, "<u4", "u1")
        n = np.add.reduceat(times[order].astype(np.int64), head)
        nexts = np.bitwise_or.reduceat(nexts[order], head)
        return _told(group, (n >= 2) & maximal(nexts, n), sizes, order, np.diff(head, append=len(order)))

    return checkpoint(_sent_long(chunks, k, False, told).groupBy("bucket").applyInArrow(judge, _TOLD))  # what was sent goes from the disk here


#: Of the letters between an occurrence and the one before, as a number: their count above 56 bits of letters, or, where they are more than ``MOST``, the count and this bit.
_FAR = 1 << 62


def _between(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` letters from each ``start`` on (rising) as such a number."""
    out, codes = np.empty(len(start), dtype=U64), np.append(codes, np.zeros(MOST, dtype=np.uint8))
    for p in range(0, len(codes) - MOST, PIECE):
        a, b = np.searchsorted(start, [p, p + PIECE])
        if a < b:
            near = np.minimum(size[a:b], MOST)
            letters = numbers(codes[p : p + PIECE + MOST - 1], MOST, False)[0][start[a:b] - p] >> (2 * (MOST - near)).astype(U64)
            out[a:b] = np.where(size[a:b] > MOST, size[a:b].astype(U64) | U64(_FAR), size[a:b].astype(U64) << U64(56) | letters)
    return out


def uncovered(chunks: Chunks, k: int) -> DataFrame:
    """low, high, n of the k-mers of ``repeats`` that do not always have the same letters between them and the nearest occurrence before in the read.

    A chunk tells of each k-mer once whether it is free (one of its occurrences has none before, or two differ), else what lies between: as a number (``_between``), and the letters where
    that does not hold them.
    """
    low_bits = _long_bits(chunks, k)[1]

    def find(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        names = {"bucket": pa.int64(), "n": pa.int32(), "base": pa.int64(), "blob": pa.binary(), "texts": pa.binary()}
        flags = _flags(answer) if chunk.num_rows and answer.num_rows else np.zeros(0, dtype=bool)
        if not flags.any():
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        made = _Long(chunk.to_pylist()[0], k, False)
        times = np.diff(made.head, append=len(made.at))
        at, times = made.at[np.repeat(flags, times)], times[flags]
        order = np.argsort(at)
        place = at[order]
        first = np.diff(made.read[place], prepend=-1) != 0
        size = np.where(first, 0, np.diff(place, prepend=0))
        code = np.empty(len(at), dtype=U64)
        code[order] = np.where(first, U64(0), _between(made.codes, place - size, size))
        head = np.cumsum(times) - times
        least, most = np.minimum.reduceat(code, head), np.maximum.reduceat(code, head)
        free = (least == 0) | (least != most)
        texts, letters = [], made.codes.tobytes()
        for i in np.flatnonzero(~free & (least >= _FAR)).tolist():  # letters at such distances are compared one by one
            d = int(least[i]) - _FAR
            found = {letters[p - d : p] for p in at[head[i] : head[i] + times[i]].tolist()}
            free[i] = len(found) > 1
            texts += found if len(found) == 1 else ()
        least[free] = 0
        made.low, made.high = made.low[flags], made.high[flags]
        out = made.blobs(low_bits, times.astype("<u4"), least)
        ends = np.append(0, np.cumsum(least >= _FAR))[np.cumsum([0, *out["n"]])].tolist()
        out["texts"] = [pa.compress(b"\xff".join(texts[a:b]), codec="zstd", asbytes=True) if a < b else None for a, b in zip(ends[:-1], ends[1:])]
        # the size of the text before compression
        out["base"] = [sum(map(len, texts[a:b])) + max(0, b - a - 1) for a, b in zip(ends[:-1], ends[1:])]
        out = pa.table([pa.array(out[c], t) for c, t in names.items()], names=list(names))
        release()
        return out

    def judge(group: pa.Table) -> pa.Table:
        _, _, order, head, low, high, times, code = _joined(group, int(low_bits), "<u4", "<u8")
        n, sent = np.add.reduceat(times[order].astype(np.int64), head), np.diff(head, append=len(order))
        least, most = np.minimum.reduceat(code[order], head), np.maximum.reduceat(code[order], head)
        kept = (least == 0) | (least != most)
        number, texts = np.cumsum(code >= _FAR) - 1, []
        for text, size in zip(group.column("texts").to_pylist(), group.column("base").to_pylist()):
            texts += pa.decompress(text, size, codec="zstd", asbytes=True).split(b"\xff") if text is not None else ()
        for i in np.flatnonzero(~kept & (least >= _FAR) & (sent > 1)).tolist():
            kept[i] = len({texts[number[j]] for j in order[head[i] : head[i] + sent[i]]}) > 1
        at = order[head[kept]]
        low = low[at] | U64(group.column("bucket")[0].as_py()) << low_bits
        out = pa.table({"low": low.view(np.int64), "high": high[at].view(np.int64), "n": n[kept]})
        release()
        return out

    sent = _answered(chunks, _repeated(chunks, k), find, "bucket long, n int, base long, blob binary, texts binary")
    return sent.groupBy("bucket").applyInArrow(judge, "low long, high long, n long")


def named(rows: DataFrame, k: int, *more: str) -> DataFrame:
    """kmer and n (or the columns ``more``) of ``rows`` with k-mers of ``repeats`` (low, high)."""
    tail, more = min(k, MOST), more or ("n",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (np.asarray(batch.column(c)).view(U64) for c in (0, 1))
            kmer = strings(unmixed(low, tail), tail)
            yield pa.record_batch([pc.binary_join_element_wise(strings(high, k - tail), kmer, "") if k > tail else kmer, *batch.columns[2:]], names=["kmer", *more])

    return rows.select("low", "high", *more).mapInArrow(run, f"kmer string, {', '.join(f'{c} long' for c in more)}")
