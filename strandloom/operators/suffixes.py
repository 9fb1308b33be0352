"""The Burrows-Wheeler transform of short reads over A, C, G, T as blocks of packed symbols.

Suffixes are words of two bits a letter, 32 letters a word. Chunks of reads (``packed.chunked``) send theirs
in the order of reads to buckets cut by whole suffixes with their read_ids from a sample, so that no repeat, however
frequent, makes a bucket large; buckets sort them. Buckets are made in ``PHASES`` rounds over the chunks: only a round's suffixes are
on disk at a time, and of a finished bucket only what is made of it (its symbols, say) stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import packed
from strandloom.runtime import checkpoint, scratch, written

#: Rounds over the chunks, suffixes in a bucket, suffixes sampled from a chunk, and buckets in a file.
PHASES, BUCKET, SAMPLES, BLOCKS_A_FILE = 8, 1 << 20, 192, 4
#: Rows of a batch of the result.
BATCH = 1 << 16
#: The longest read: lengths are sent as bytes.
LONGEST = 255
U64 = np.uint64
#: Symbols by code, as the letters of ``packed`` with the end before them.
SYMBOLS = "$ACGT"
#: Bits of a word that hold so many letters.
_LETTERS = np.array([0, *((1 << 64) - (1 << (64 - 2 * n)) for n in range(1, 33))], dtype=U64)


def _bits(words: list[np.ndarray], at: np.ndarray, offset: int, width: int) -> np.ndarray:
    """So many bits of suffixes from ``offset`` on, as numbers; zero beyond their words."""
    j, shift = divmod(offset, 64)
    if j >= len(words) or not width:
        return np.zeros(len(at), dtype=U64)
    x = words[j][at] << U64(shift)
    if shift and j + 1 < len(words):
        x |= words[j + 1][at] >> U64(64 - shift)
    return x >> U64(64 - width)


def _order(words: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """The order of suffixes by letters, then length (a suffix that ends is before all that go on), then place.

    As many leading bits as fit are sorted with the places as one number; suffixes that tie are sorted by their next bits, and so on.
    """
    n = len(size)
    if not n:
        return np.zeros(0, dtype=np.int64)
    place, span = n.bit_length(), int(words[0].min() ^ words[0].max()).bit_length()
    drop = max(0, span + place - 64)
    value = (words[0] & U64((1 << span) - 1)) >> U64(drop) << U64(place) | np.arange(n, dtype=U64)
    value.sort()
    order = (value & U64((1 << place) - 1)).astype(np.int64)
    key, offset, ended = value >> U64(place), 64 - drop, -1
    at, who = np.arange(n), order
    whole = np.zeros(n, dtype=bool)
    while True:
        head = np.concatenate([[True], key[1:] != key[:-1]])
        kept = ~(head & np.append(head[1:], True)) & ~whole
        if not kept.any():
            return order
        at, who, group = at[kept], who[kept], np.cumsum(head[kept]) - 1
        letters = offset // 2  # so many are known to be equal in a group, or one of the two has ended before
        ends = np.minimum(size[who].astype(np.int64), letters + 1) - ended
        place, more = len(who).bit_length(), (letters + 1 - ended).bit_length()
        width = max(0, min(64 - place - more - int(group[-1]).bit_length(), 64 * len(words) - offset))
        value = (group.astype(U64) << U64(more) | ends.astype(U64)) << U64(width) | _bits(words, who, offset, width)
        value = value << U64(place) | np.arange(len(who), dtype=U64)
        value.sort()
        who, key = who[(value & U64((1 << place) - 1)).astype(np.int64)], value >> U64(place)
        order[at] = who
        whole, ended, offset = size[who] <= letters, letters, offset + width


class _Reads:
    """The reads of a chunk with a place for each suffix: one for each letter and one for the end of the read."""

    def __init__(self, row: dict, count: int) -> None:
        (codes,), (sizes,) = packed.unpack(row["letters"], row["n"], "u1"), packed.unpack(row["sizes"], row["reads"], "<u4")
        self.ids, sizes = np.cumsum(packed.unpack(row["ids"], row["reads"], "<i8")[0]), sizes.astype(np.int64)
        self.count, stops = count, np.cumsum(sizes + 1) - 1
        self.read = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        letter = np.ones(len(self.read), dtype=bool)
        letter[stops] = False
        self.symbols = np.zeros(len(self.read) + 32, dtype=np.uint8)  # as ``SYMBOLS``
        self.symbols[: len(letter)][letter] = codes + 1
        self.left = np.zeros(len(self.read), dtype=np.uint8)  # letters of the suffix
        self.windows = np.empty(len(self.read), dtype=U64)  # the 32 letters from each place on, over ends of reads too
        for a in range(0, len(self.read), packed.PIECE):
            b = min(a + packed.PIECE, len(self.read))
            self.left[a:b] = stops[self.read[a:b]] - np.arange(a, b)
            x = (np.maximum(self.symbols[a : b + 31], 1) - 1).astype(U64)
            for step in (1, 2, 4, 8, 16):
                x = x[:-step] << U64(2 * step) | x[step:]
            self.windows[a:b] = x

    def word(self, at: np.ndarray | slice, j: int) -> np.ndarray:
        left = self.left[at].astype(np.int64)
        if not j:
            return self.windows[at] & _LETTERS[np.minimum(left, 32)]
        return self.windows[np.minimum(at + 32 * j, len(self.read) - 1)] & _LETTERS[np.clip(left - 32 * j, 0, 32)]

    def suffixes(self, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        return [self.word(at, j) for j in range(self.count)], self.left[at], self.ids[self.read[at]]

    def within(self, least: np.uint64, most: np.uint64) -> np.ndarray:
        """Places of the suffixes whose first word is within bounds."""
        found = []
        for a in range(0, len(self.read), packed.PIECE):
            head = self.word(slice(a, a + packed.PIECE), 0)
            found.append(np.flatnonzero((head >= least) & (head <= most)) + a)
        return np.concatenate(found)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _borders(rows: DataFrame, count: int, total: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The suffixes that the buckets but the first begin with: words, lengths, read_ids."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            reads = _Reads(row, count)
            at = np.random.default_rng(row["part"]).integers(0, len(reads.read), SAMPLES)
            words, size, read = reads.suffixes(at)
            yield pa.record_batch([pa.array([packed.pack(*words, size, read)], pa.binary())], names=["blob"])

    kinds = ["<u8"] * count + ["u1", "<i8"]
    parts = [packed.unpack(r["blob"], SAMPLES, *kinds) for r in rows.mapInArrow(sample, "blob binary").collect()]  # some numbers of each chunk
    *words, size, read = (np.concatenate([p[i] for p in parts]) for i in range(count + 2))
    buckets = max(1, total // BUCKET)
    at = np.lexsort([read, size, *reversed(words)])[np.arange(1, buckets) * len(read) // buckets]
    return [w[at] for w in words], size[at], read[at]


def _dealt(made: _Reads, at: np.ndarray, cuts: tuple[list[np.ndarray], np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted suffixes ``cuts`` are not behind each suffix."""
    key = made.word(at, 0)
    bucket = np.searchsorted(cuts[0][0], key, "right")
    some = np.flatnonzero(np.searchsorted(cuts[0][0], key, "left") != bucket)  # a cut begins with the same letters
    if len(some):
        words, size, read = made.suffixes(at[some])
        joined = [np.concatenate(x) for x in zip([*cuts[0], cuts[1], cuts[2]], [*words, size, read])]
        order = np.lexsort([*reversed(joined)])
        is_cut = order < len(cuts[1])
        bucket[some[order[~is_cut] - len(cuts[1])]] = np.cumsum(is_cut)[~is_cut]
    return bucket


def sorted_buckets(reads: DataFrame, longest: int, made_of: Callable[[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray], dict], schema: pa.Schema, sql: str) -> DataFrame | None:
    """A row for each bucket of sorted suffixes, ``made_of`` its number, words, lengths, read_ids and symbols before them. None where there is no suffix.

    ``schema`` and ``sql`` are the types of such a row. ``reads`` as for ``blocks``.
    """
    count = longest // 32 + 1
    chunks = packed.chunked(reads, "read_id", empty=True, times=packed.CHUNK_TIMES)
    rows = chunks.rows.select("part", "reads", "n", "letters", "sizes", "ids")
    path = scratch(reads.sparkSession, "blocks")
    sums = rows.agg(F.coalesce(F.sum(F.col("n") + F.col("reads")), F.lit(0)).alias("n")).first()
    if not sums["n"]:
        return None
    words, size, read = _borders(rows, count, sums["n"])
    buckets, kinds = len(read) + 1, ["<u8"] * count + ["u1", "<u8", "u1"]
    edges = sorted({i * buckets // PHASES for i in range(PHASES + 1)})

    def phase(first: int, until: int) -> DataFrame:
        low, high = max(0, first - 1), min(until, buckets - 1)
        cuts = [w[low:high] for w in words], size[low:high], read[low:high]
        least, most = U64(words[0][first - 1] if first else 0), U64(words[0][until - 1] if until < buckets else (1 << 64) - 1)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                made = _Reads(row, count)
                at = made.within(least, most)
                bucket = _dealt(made, at, cuts) + low - first
                inside = (bucket >= 0) & (bucket < until - first)
                at, bucket = at[inside], bucket[inside]
                order = np.argsort(bucket.astype(np.uint16 if until - first < 1 << 16 else np.int64), kind="stable")
                at, bucket = at[order], bucket[order]
                own, own_size, own_read = made.suffixes(at)
                begins = np.flatnonzero(np.diff(bucket, prepend=-1))
                ids = np.diff(own_read, prepend=0)
                ids[begins] = own_read[begins]
                planes = packed._planes(*own, own_size, ids.astype(U64), np.where(at > 0, made.symbols[at - 1], 0).astype(np.uint8))
                base = int(made.ids.min())
                out: dict[str, list] = {"bucket": [], "n": [], "base": [], "blob": []}
                for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(at)]):
                    for c, v in (("bucket", int(bucket[i]) + first), ("n", j - i), ("base", base), ("blob", packed._packed(planes[:, i:j]))):
                        out[c].append(v)
                del made, own, planes
                packed.release()
                names = {"bucket": pa.int64(), "n": pa.int32(), "base": pa.int64(), "blob": pa.binary()}
                yield pa.record_batch([pa.array(out[c], t) for c, t in names.items()], names=list(names))

        def merge(group: pa.Table) -> pa.Table:
            group = group.sort_by("base")
            n = group.column("n").to_pylist()
            *all_words, sizes, all_read, codes = packed.unpack_all(group.column("blob").to_pylist(), n, *kinds)
            ends = np.cumsum([0, *n]).tolist()
            for i, j in zip(ends[:-1], ends[1:]):
                np.cumsum(all_read[i:j], dtype=U64, out=all_read[i:j])
            all_read = all_read.astype(np.int64)
            if (all_read[1:] < all_read[:-1]).any():  # chunks that are not in the order of reads
                order = np.argsort(all_read, kind="stable")
                all_words, sizes, all_read, codes = [w[order] for w in all_words], sizes[order], all_read[order], codes[order]
            order = _order(all_words, sizes)
            row = made_of(group.column("bucket")[0].as_py(), [w[order] for w in all_words], sizes[order], all_read[order], codes[order])
            packed.release()
            return pa.Table.from_pylist([row], schema=schema)

        return rows.mapInArrow(send, "bucket long, n int, base long, blob binary").groupBy("bucket").applyInArrow(merge, sql)

    paths = [f"{path}/{first}" for first in edges[:-1]]
    for p, first, until in zip(paths, edges, edges[1:]):
        written(phase(first, until), p, BLOCKS_A_FILE)
    return reads.sparkSession.read.schema(sql).parquet(*paths)


def blocks(reads: DataFrame, longest: int, ids: bool = True) -> DataFrame:
    """at, n, counts, before, letters, reads: the transform from position ``at`` on, as codes of ``SYMBOLS``, how often each is in the block and before it, and its read_ids if ``ids``.

    ``reads`` has distinct read_ids (longs) and seq over A, C, G, T, ``longest`` letters at most and ``LONGEST`` too; an empty one has the suffix $ alone.
    """

    def made_of(bucket: int, words: list[np.ndarray], size: np.ndarray, read: np.ndarray, codes: np.ndarray) -> dict:
        return {"bucket": bucket, "n": len(codes), "counts": np.bincount(codes, minlength=len(SYMBOLS)).tolist(), "letters": packed.pack(codes), "reads": packed.pack(read) if ids else None}

    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("counts", pa.list_(pa.int64())), ("letters", pa.binary()), ("reads", pa.binary())])
    found = sorted_buckets(reads, longest, made_of, schema, "bucket long, n long, counts array<long>, letters binary, reads binary")
    if found is None:
        return reads.sparkSession.createDataFrame([], "at long, n long, counts array<long>, before array<long>, letters binary, reads binary")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    sums = [F.coalesce(F.sum(x).over(earlier), F.lit(0)) for x in (F.col("n"), *(F.get("counts", F.lit(i)) for i in range(len(SYMBOLS))))]
    places = checkpoint(found.select("bucket", sums[0].alias("at"), F.array(*sums[1:]).alias("before")))
    return found.join(F.broadcast(places), "bucket").select("at", "n", "counts", "before", "letters", "reads")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """The rows of blocks with their codes."""
    for row in _rows(batches):
        yield row, packed.unpack(row["letters"], row["n"], "u1")[0]


def names(codes: np.ndarray) -> pa.Array:
    """Symbols of codes."""
    return pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int8)), pa.array(list(SYMBOLS))).cast(pa.string())


def rows_of(found: DataFrame) -> DataFrame:
    """pos, ch, read_id of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, codes in each_block(batches):
            ids = packed.unpack(row["reads"], row["n"], "<i8")[0] if row["reads"] is not None else None
            for a in range(0, row["n"], BATCH):
                part = codes[a : a + BATCH]
                pos = pa.array(np.arange(row["at"] + a, row["at"] + a + len(part)))
                yield pa.record_batch([pos, names(part), pa.array(ids[a : a + BATCH]) if ids is not None else pa.nulls(len(part), pa.int64())], names=["pos", "ch", "read_id"])

    return found.select("at", "n", "letters", "reads").mapInArrow(run, "pos long, ch string, read_id long")


def ranks_of(found: DataFrame) -> DataFrame:
    """pos, ch, rank of blocks: how often the symbol stands before this position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, codes in each_block(batches):
            rank = np.empty(len(codes), dtype=np.int64)
            for c, before in enumerate(row["before"]):
                at = np.flatnonzero(codes == c)
                rank[at] = before + np.arange(len(at))
            for a in range(0, row["n"], BATCH):
                part = codes[a : a + BATCH]
                yield pa.record_batch([pa.array(np.arange(row["at"] + a, row["at"] + a + len(part))), names(part), pa.array(rank[a : a + BATCH])], names=["pos", "ch", "rank"])

    return found.select("at", "n", "before", "letters").mapInArrow(run, "pos long, ch string, rank long")


def _runs(row: dict, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(codes.astype(np.int8), prepend=-1, append=-1))
    return row["at"] + edges[:-1], codes[edges[:-1]], np.diff(edges)


def runs_of(found: DataFrame) -> DataFrame:
    """start, ch, length of the runs of blocks, in order where the blocks are. A run over borders is given where it starts."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, codes in each_block(batches):
            start, code, length = (x[[0, -1]] for x in _runs(row, codes))
            yield pa.record_batch([pa.array(start), pa.array(code.astype(np.int32)), pa.array(length)], names=["start", "code", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, codes in each_block(batches):
            start, code, length = _runs(row, codes)
            for i in {0, len(start) - 1}:
                length[i] = whole.get(int(start[i]), 0)
            kept = length > 0
            start, code, length = start[kept], code[kept], length[kept]
            for a in range(0, len(start), BATCH):
                yield pa.record_batch([pa.array(start[a : a + BATCH]), names(code[a : a + BATCH]), pa.array(length[a : a + BATCH])], names=["start", "ch", "length"])

    rows = found.select("at", "n", "letters")
    whole: dict[int, int] = {}
    last: tuple[int, int, int] | None = None  # start, end and code of the run before
    for start, code, length in sorted({tuple(r) for r in rows.mapInArrow(ends, "start long, code int, length long").collect()}):  # two rows a block
        if last is not None and last[1:] == (start, code):
            last = (last[0], start + length, code)
        else:
            last = (start, start + length, code)
        whole[last[0]] = last[1] - last[0]
    return rows.mapInArrow(run, "start long, ch string, length long")


def index_of(found: DataFrame, block: int) -> DataFrame:
    """block, letters, before, smaller as ``bwt.searchable``; ``before`` and ``smaller`` are for all symbols of ``bwt.SYMBOLS``."""
    total = found.agg(*(F.coalesce(F.sum(F.get("counts", F.lit(i))), F.lit(0)).alias(c) for i, c in enumerate(SYMBOLS))).first().asDict()
    order = "$ACGNT"
    smaller = [sum(total.get(d, 0) for d in order[:i]) for i in range(len(order))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, codes in each_block(batches):
            first = -(-row["at"] // block) * block
            at = np.unique(np.concatenate([[row["at"]], np.arange(first, row["at"] + row["n"], block)])) - row["at"]
            inside = np.array([np.bincount(x, minlength=len(SYMBOLS)) for x in np.split(codes, at[1:])])
            before = np.array(row["before"]) + np.cumsum(inside, axis=0) - inside
            before = np.insert(before, order.index("N"), 0, axis=1)
            letters = np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)[codes].tobytes().decode()
            texts = [letters[a:b] for a, b in zip(at, [*at[1:], len(letters)])]
            yield pa.record_batch([pa.array((at + row["at"]) // block), pa.array(at + row["at"]), pa.array(texts), pa.array(before.tolist(), pa.list_(pa.int64()))], names=["block", "at", "letters", "before"])

    pieces = found.select("at", "n", "before", "letters").mapInArrow(cut, "block long, at long, letters string, before array<long>")
    rows = pieces.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "letters", "before"))).alias("v"))
    return rows.select("block", F.array_join(F.col("v.letters"), "").alias("letters"), F.get("v", F.lit(0))["before"].alias("before"), F.array(*(F.lit(n).cast("long") for n in smaller)).alias("smaller"))
