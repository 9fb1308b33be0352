"""All right-maximal strings of a set of reads, of every length: the inner nodes of its suffix tree.

Sorted suffixes that share a prefix lie together, and a string is right-maximal just where the common prefixes of
neighbours in its stretch reach its length and nowhere fall below it. So suffixes are dealt by range and sorted
once, and a task finds the stretches that begin and end within its range with a stack no deeper than a
read is long. Of those that touch a border a task only tells how the common prefixes fall from its first suffix on and
towards its last one, at most a number for each length. Such stretches are then followed over the ranges
by the least common prefix of each, three numbers a range, and end by a lookup in the range where they do.
A string that a third of all suffixes begin with is spread over as many ranges as it needs.

The ends of reads are all different, as everywhere here: a string that ends two reads is right-maximal.
Suffixes of reads of up to ``suffixes.LONGEST`` letters over A, C, G, T are sorted as packed words (``suffixes``), and a range is worked on as arrays.
Others, and few suffixes, are sorted as strings, which grows with the square of a read's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import bwt, packed, suffixes
from strandloom.runtime import checkpoint, scratch, ship_package, written

#: Letters compared at once: rows of a batch times the longest of them.
CELLS = 1 << 24
#: Rounds of sorting, and suffixes from which on there are more than one.
PHASES, PHASE_SUFFIXES = 8, 1 << 21
#: Suffixes from which on packed words are sorted where they can be; fewer are sorted as strings.
PACKED = 1 << 16
#: Above every common prefix: the least one of a range with a single suffix.
NONE = (1 << 31) - 1

_RANGE = "head string, tail string, size long, fall_at array<long>, fall array<int>, open_at array<long>, open array<int>"
_FOUND = f"part int, at long, n long, depth int, word string, {_RANGE}"


def common_prefixes(words: list[bytes]) -> np.ndarray:
    """How many letters each word shares with the one before; as many entries as words but one."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = [np.zeros(0, dtype=np.int64)]
    step = max(2, CELLS // max(1, int(size.max(initial=0))))
    for i in range(0, len(words) - 1, step - 1):
        part = words[i : i + step]
        width = max(1, int(size[i : i + step].max()))
        cells = np.array(part, dtype=f"S{width}").view(np.uint8).reshape(len(part), width)
        differ = cells[1:] != cells[:-1]
        upto = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out.append(np.minimum(upto, np.minimum(size[i : i + step][1:], size[i : i + step][:-1])))
    return np.concatenate(out)


class _Range:
    """The suffixes of one range, taken in order."""

    def __init__(self, part: int, first: bytes) -> None:
        self.part, self.head, self.tail, self.size = part, first, first, 1
        self.fall: list[tuple[int, int]] = []  # where the common prefix first falls to a new least value
        self.open: list[tuple[int, int]] = []  # (begin, depth) of stretches that may go on, depths rising

    def take(self, words: list[bytes]) -> list[tuple[int, int, int, bytes]]:
        """(begin, n, depth, word) of the stretches that end with these words and touch no border of the range."""
        found, stack, i = [], self.open, self.size
        shared = common_prefixes([self.tail, *words]).tolist()
        last = self.tail
        for depth, word in zip(shared, words):
            begin = i - 1
            while stack and stack[-1][1] > depth:
                begin, d = stack.pop()
                if begin:
                    found.append((begin, i - begin, d, last[:d]))
            if not stack or stack[-1][1] < depth:
                stack.append((begin, depth))
            if not self.fall or depth < self.fall[-1][1]:
                self.fall.append((i, depth))
            last = word
            i += 1
        self.tail, self.size = last, i
        return found

    def row(self) -> dict[str, list]:
        fall_at, fall = zip(*self.fall) if self.fall else ((), ())
        open_at, depths = zip(*self.open) if self.open else ((), ())
        return {"head": [self.head.decode()], "tail": [self.tail.decode()], "size": [self.size], "fall_at": [fall_at], "fall": [fall], "open_at": [open_at], "open": [depths]}


_SCHEMA = pa.schema(
    [("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("depth", pa.int32()), ("word", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("size", pa.int64())]
    + [("fall_at", pa.list_(pa.int64())), ("fall", pa.list_(pa.int32())), ("open_at", pa.list_(pa.int64())), ("open", pa.list_(pa.int32()))]
)


def _shared(words: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """How many letters each suffix shares with the one before; as many entries as suffixes but one."""
    out = np.full(max(0, len(size) - 1), 32 * len(words), dtype=np.int64)
    for j in range(len(words) - 1, -1, -1):
        x = words[j][1:] ^ words[j][:-1]
        at = np.flatnonzero(x)
        x = x[at]
        top = ((x & ~(x >> np.uint64(1))).astype(np.float64).view(np.int64) >> 52) - 1023  # no rounding goes beyond the leading bit
        out[at] = 32 * j + (63 - top) // 2
    return np.minimum(out, np.minimum(size[1:], size[:-1]))


def _nested(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, depth) of the stretches of suffixes that share ``depth`` letters, as ``shared`` tells of neighbours; by falling depth.

    From the deepest on, neighbours of one depth that nothing lower parts are a stretch, and go.
    """
    n = len(shared) + 1
    value = np.concatenate([[-1], shared, [-1]])
    before, after = np.arange(-1, n), np.arange(1, n + 2)
    order = np.argsort((shared.max(initial=0) - shared).astype(np.uint16), kind="stable") + 1
    begins, ends, depths = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
        if len(at):
            depth = value[at[0]]
            begin, end = before[at], after[at]
            begin, end = begin[value[begin] < depth], end[value[end] < depth]
            after[begin], before[end] = end, begin
            begins.append(begin)
            ends.append(end)
            depths.append(np.full(len(begin), depth))
    return np.concatenate(begins), np.concatenate(ends), np.concatenate(depths)


def _letters(words: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first ``depth`` letters of suffixes, as bytes one after the other."""
    parts = [np.zeros(0, dtype=np.uint8)]
    for a in range(0, len(at), packed.PIECE // 4):
        some, d = at[a : a + packed.PIECE // 4], depth[a : a + packed.PIECE // 4]
        wide = range(int(d.max(initial=0)) // 32 + 1)
        cells = np.concatenate([packed.letters(words[j][some], 32) for j in wide if j < len(words)], axis=1)
        parts.append(cells[np.arange(cells.shape[1]) < d[:, None]])
    return np.concatenate(parts)


_BLOCK = pa.schema([*(f for f in _SCHEMA if f.name not in ("at", "n", "depth", "word")), ("found", pa.int64()), ("letters", pa.int64()), ("numbers", pa.binary()), ("words", pa.binary())])
_BLOCKS = f"part int, {_RANGE}, found long, letters long, numbers binary, words binary"


def _block(part: int, words: list[np.ndarray], size: np.ndarray, *_: np.ndarray) -> dict:
    """What ``_Range`` and ``_stretches`` find in a range, from its sorted suffixes."""
    size = size.astype(np.int64)
    shared = _shared(words, size)
    begin, end, depth = _nested(shared)
    head, tail = (_letters(words, np.array([i]), size[[i]]).tobytes().decode() for i in (0, -1))
    least = np.minimum.accumulate(shared)
    falls = np.flatnonzero(np.diff(least, prepend=NONE))
    last = np.flatnonzero(end == len(size))[::-1]  # depths rise
    inside = np.flatnonzero((begin > 0) & (end < len(size)))
    at, n, deep = begin[inside], (end - begin)[inside], depth[inside]
    text = _letters(words, at, deep)
    return {
        "part": part, "head": head, "tail": tail, "size": len(size), "fall_at": falls + 1, "fall": least[falls], "open_at": begin[last], "open": depth[last],
        "found": len(at), "letters": len(text), "numbers": packed.pack(at.astype("<u4"), n.astype("<u4"), deep.astype(np.uint8)), "words": pa.compress(text, codec="zstd", asbytes=True),
    }


def _expanded(found: DataFrame, places: DataFrame) -> DataFrame:
    """word, depth, pos, n of the stretches inside ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                at, n, depth = packed.unpack(row["numbers"], row["found"], "<u4", "<u4", "u1")
                text = pa.decompress(row["words"], row["letters"], codec="zstd")
                off = np.concatenate([[0], np.cumsum(depth, dtype=np.int64)])
                for a in range(0, len(at), suffixes.BATCH):
                    b = min(a + suffixes.BATCH, len(at))
                    word = pa.StringArray.from_buffers(b - a, pa.py_buffer((off[a : b + 1] - off[a]).astype(np.int32)), text.slice(int(off[a]), int(off[b] - off[a])))
                    yield pa.record_batch([word, pa.array(depth[a:b].astype(np.int32)), pa.array(at[a:b].astype(np.int64) + row["start"]), pa.array(n[a:b].astype(np.int64))], names=["word", "depth", "pos", "n"])
                packed.release()

    return found.join(places, "part").select("start", "found", "letters", "numbers", "words").mapInArrow(run, "word string, depth int, pos long, n long")


def _batch(n: int, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: _Range | None = None
    for batch in batches:
        words = batch.column("suffix").cast(pa.binary()).to_pylist()
        if words and held is None:
            held, words = _Range(batch.column("part")[0].as_py(), words[0]), words[1:]
        if held is not None and words:
            found = held.take(words)
            at, n, depth, word = zip(*found) if found else ((), (), (), ())
            yield _batch(len(found), {"part": [held.part] * len(found), "at": at, "n": n, "depth": depth, "word": [w.decode() for w in word]})
    if held is not None:
        yield _batch(1, {"part": [held.part], **held.row()})


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many letters the first suffix of each range shares with the last one of the range before; -1 in the first range."""
    for batch in batches:
        before, head = batch.column("before").to_pylist(), batch.column("head").to_pylist()
        shared = [-1 if a is None else int(common_prefixes([a.encode(), b.encode()])[0]) for a, b in zip(before, head)]
        yield pa.record_batch([batch.column("part"), batch.column("size"), batch.column("least"), pa.array(shared, pa.int32())], names=["part", "size", "least", "shared"])


def _leasts(values: np.ndarray) -> list[np.ndarray]:
    """The least values of all stretches of one, two, four, ... ranges."""
    levels = [values]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def _first_below(levels: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place from ``start`` on whose value is below ``depth``; there is one."""
    at = start.copy()
    for j in range(len(levels) - 1, -1, -1):
        fits = at < len(levels[j])
        above = fits & (levels[j][np.where(fits, at, 0)] >= depth)
        at = np.where(above, at + (1 << j), at)
    return at


def _follow(touching: DataFrame, ranges: list) -> DataFrame:
    """``touching`` (i, side, depth, word) with the ranges (first, until) where a stretch begins and ends, and whether (cut_first, cut_until) that is at their borders."""
    least = np.array([r["least"] for r in ranges], dtype=np.int64)
    before = np.array([r["shared"] for r in ranges], dtype=np.int64)
    after = np.append(before[1:], -1)
    forth = _leasts(np.minimum(least, after))
    back = _leasts(np.minimum(least, before)[::-1])
    top = len(ranges) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, side, depth = (np.asarray(batch.column(c)).astype(np.int64) for c in ("i", "side", "depth"))
            ends, begins = (side == 1) & (after[i] < depth), (side == 0) & (before[i] < depth)
            until = np.where(ends, i, _first_below(forth, np.minimum(i + side, top), depth))
            first = np.where(begins, i, top - _first_below(back, top - np.maximum(i - 1 + side, 0), depth))
            out = {"first": first, "until": until, "cut_first": begins | (least[first] >= depth), "cut_until": ends | (least[until] >= depth)}
            yield pa.record_batch([batch.column("depth"), batch.column("word"), *(pa.array(v) for v in out.values())], names=["depth", "word", *out])

    return touching.mapInArrow(run, "depth int, word string, first long, until long, cut_first boolean, cut_until boolean")


def _ranges_found(suffixes: DataFrame) -> DataFrame:
    """What ``_stretches`` finds in ranges of all suffixes. Ranges are sorted in up to ``PHASES`` rounds, and only a round's suffixes are on disk at a time."""
    n = suffixes.count()
    phases = min(PHASES, 1 + n // PHASE_SUFFIXES)
    some = suffixes.where(F.pmod(F.xxhash64("read_id", "suffix"), F.lit(max(1, n // 1000))) == 0) if phases > 1 else suffixes.limit(0)
    heads = sorted(r["suffix"] for r in some.select("suffix").collect())  # about a thousand
    cuts = sorted({heads[i * len(heads) // phases] for i in range(1, phases)} - {""}) if heads else []
    path = scratch(suffixes.sparkSession, "ranges")
    paths = []
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        inside = suffixes if low is None else suffixes.where(F.col("suffix") >= low)
        inside = inside if high is None else inside.where(F.col("suffix") < high)
        ranged = inside.repartitionByRange("suffix", "read_id").sortWithinPartitions("suffix", "read_id")
        part = (F.spark_partition_id() + F.lit(i << 20)).alias("part")
        paths.append(f"{path}/{i}")
        written(ranged.select(part, "suffix").mapInArrow(_stretches, _FOUND), paths[-1])
    return suffixes.sparkSession.read.schema(_FOUND).parquet(*paths)


def right_maximal_strings(reads: DataFrame) -> DataFrame:
    """word, depth (its length), pos (its first suffix in the order of ``bwt.transform``), n (its occurrences) of every right-maximal string.

    ``reads`` has distinct read_ids and seq; a null seq has no suffix, an empty one only the empty suffix. The empty
    string is among the results where there are two suffixes or more. Equal reads are as many occurrences. No reads give no rows.
    """
    ship_package(reads.sparkSession)
    reads = checkpoint(reads.where("seq IS NOT NULL").select("read_id", "seq"))
    longest = bwt.packed_length(reads, PACKED)
    if longest is not None:
        found = suffixes.sorted_buckets(reads, longest, _block, _BLOCK, _BLOCKS)
        if found is None:
            return reads.sparkSession.createDataFrame([], "word string, depth int, pos long, n long")
        return _placed(found, _expanded)
    rows = reads.select("read_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") + 1)).alias("p")).select("read_id", F.expr("substring(seq, p)").alias("suffix"))
    found = _ranges_found(rows)
    if found.where("size IS NOT NULL").isEmpty():
        return found.select("word", "depth", F.col("at").alias("pos"), "n")
    return _placed(found, lambda found, places: found.where("word IS NOT NULL").join(places, "part").select("word", "depth", (F.col("start") + F.col("at")).alias("pos"), "n"))


def _placed(found: DataFrame, within: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """word, depth, pos, n of the stretches in ranges, from ``within`` and the places of ranges, and of those over borders."""
    parts = found.where("size IS NOT NULL").withColumn("least", F.coalesce(F.get("fall", F.size("fall") - 1), F.lit(NONE)))
    order = Window.orderBy("part")  # over one row a range
    ranges = parts.select("part", "size", "least", "head", F.lag("tail").over(order).alias("before")).mapInArrow(_borders, "part int, size long, least int, shared int")
    ranges = sorted(ranges.collect(), key=lambda r: r["part"])  # four numbers a range
    starts = np.cumsum([0, *(r["size"] for r in ranges)]).tolist()
    numbers = [(r["part"], i, start, r["shared"]) for i, (r, start) in enumerate(zip(ranges, starts))]
    places = F.broadcast(found.sparkSession.createDataFrame(numbers, "part int, i long, start long, shared int"))
    placed = parts.join(places, "part")

    def from_border(side: int, text: str, depths: Column) -> DataFrame:
        rows = placed.select("i", F.lit(side).alias("side"), text, F.explode(depths).alias("depth"))
        return rows.select("i", "side", "depth", F.expr(f"left({text}, depth)").alias("word"))

    heads = F.array_distinct(F.concat("fall", F.when(F.col("shared") >= 0, F.array("shared")).otherwise(F.array().cast("array<int>"))))
    touching = from_border(0, "head", heads).unionByName(from_border(1, "tail", F.col("open")))
    begin = placed.select(F.col("i").alias("first"), F.col("start").alias("_start"), "size", "open_at", "open")
    end = placed.select(F.col("i").alias("until"), F.col("start").alias("_end"), F.col("size").alias("_size"), "fall_at", "fall")
    followed = _follow(touching, ranges).join(begin, "first").join(end, "until")
    inside = F.expr("coalesce(get(filter(arrays_zip(open_at, open), x -> x.open >= depth), 0).open_at, size - 1)")
    stop = F.expr("coalesce(get(filter(arrays_zip(fall_at, fall), x -> x.fall < depth), 0).fall_at, _size)")
    pos = F.col("_start") + F.when(F.col("cut_first"), 0).otherwise(inside)
    until = F.col("_end") + F.when(F.col("cut_until"), F.col("_size")).otherwise(stop)
    over = followed.select("word", "depth", pos.alias("pos"), (until - pos).alias("n")).dropDuplicates(["depth", "pos"])
    return within(found, places).unionByName(over)
