"""Collocations by hierarchical pair naming.

Texts are lower-cased in A-Z, split into pieces and those into words; everything is counted per
language. A phrase of k words is the pair of two phrases of k - 1 words that overlap in all but
one word. So level k replaces neighbouring frequent names of level k - 1 by the name of their
pair: a number that all chunks of the corpus get from one join with the table of frequent
pairs. The pair is also the pair of parents of the phrase: its first k - 1 words and its last.
Counts of all its beginnings and ends, which the cuts need, come down this tree, and whether a
longer phrase holds it as often is asked of its children alone: a phrase holds all between it and
any longer one around it, and none of those is rarer than the longer one.

Chunks of texts (some megabytes) are turned into local codes once; the texts are not read again. At each
level a chunk sends its distinct pairs with their counts, so a frequent pair is one row a
chunk, and gets the names of the frequent ones back: by broadcast while these have ``NAMES_BYTES`` at most, else by a join.
Most pairs are rare. So hashed counters are added up first, as packed arrays, and a pair whose counter stays below the threshold is not
sent; what passes is counted exactly. Names are never hashes: words meet as
strings and pairs as two names.

A null text is empty and a null language ``und``. Repeated rows count each time. Empty tables give
no phrase. A very long text is a chunk of its own. Columns other than lang and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.hashcount import pack, unpack
from strandloom.llm.spans import byte_class, chunks, find_runs, name_spans, span_strings
from strandloom.llm.textblocks import LOWER, U64, mix, release, text_buffer
from strandloom.runtime import checkpoint, ship_package

#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
#: Chunks in a file of a level: a task decodes a file's rows together, so this bounds its memory however many chunks it has.
CHUNKS_A_FILE = 2
#: Bytes of a level's names that are broadcast at most; more are joined.
NAMES_BYTES = 32 << 20
#: Bits of the largest filter of counters (a bitmap of 32 MB), and of the counters that are added up in one group.
FILTER_BITS, _SLICE = 28, 20
#: Pairs of a bucket in which they are counted, repeats included.
BUCKET_PAIRS = 1 << 20
#: Parts that a language's phrases are ranked in first, so that no task gets all of them.
RANK_PARTS = 64
_BREAK = byte_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_WORD = ~(_BREAK | byte_class((0x20, 0x20), (0x09, 0x09)))


def _packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), dtype="<i4")


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """(codes of the words with -1 between pieces, language and word of each code, how often each occurs) of rows lang, text."""
    raw, off = text_buffer(batch.column(1))
    buf = LOWER[raw]
    starts, ends = find_runs(buf, off, _WORD)
    lang = batch.column(0).fill_null("und").dictionary_encode()
    row = np.searchsorted(off, starts, side="right") - 1
    group = np.asarray(lang.indices).astype(np.int64)[row] if len(starts) else np.zeros(0, dtype=np.int64)
    code, kept = name_spans(buf, starts, ends, group)
    piece = np.cumsum(_BREAK[buf])[starts] if len(starts) else starts
    new = np.zeros(len(starts), dtype=np.int64)
    new[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    out = np.full(len(starts) + int(new.sum()), -1, dtype=np.int64)
    out[np.arange(len(starts)) + np.cumsum(new)] = code
    return out, lang.dictionary.take(pa.array(group[kept])), span_strings(buf, starts[kept], ends[kept]), np.bincount(code, minlength=len(kept))


def pairs_of(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of neighbouring names, with -1 where there is no pair; left and right name and count of each code). Names below 0 are none."""
    some = names >= 0
    keep = some.copy()
    keep[1:] |= some[:-1]  # one gap is as good as many
    names, some = names[keep], some[keep]
    known, dense = np.unique(names, return_inverse=True)
    good = some[:-1] & some[1:]
    pair = dense[:-1][good] * np.int64(len(known)) + dense[1:][good]
    found, code, n = np.unique(pair, return_inverse=True, return_counts=True)
    out = np.full(max(0, len(names) - 1), -1, dtype=np.int64)
    out[good] = code
    width = max(1, len(known))
    return out, known[found // width] if len(found) else found, known[found % width] if len(found) else found, n


def _lists(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _corpus(docs: DataFrame) -> DataFrame:
    """A row for each chunk: codes of its words, and its distinct words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            codes, lang, word, n = words_of(chunk)
            release()
            yield pa.record_batch({"codes": pa.array([_packed(codes)], pa.binary()), "size": pa.array([len(codes)], pa.int32()), "lang": _lists(lang), "word": _lists(word), "n": _lists(pa.array(n, pa.int64()))})

    rows = docs.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "codes binary, size int, lang array<string>, word array<string>, n array<long>")
    return checkpoint(rows.withColumn("part", F.monotonically_increasing_id()), CHUNKS_A_FILE)


@dataclass
class WordNames:
    """Names of frequent words: their place in these arrays."""

    lang: pa.Array
    word: pa.Array
    ids: np.ndarray

    @staticmethod
    def keys(lang: pa.Array, word: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(lang, word, "\t")  # no word holds a tab

    def find(self, row: dict[str, pa.Scalar]) -> np.ndarray:
        """The name of each word of a chunk, or -1."""
        at = pc.index_in(self.keys(row["lang"].values, row["word"].values), self.keys(self.lang, self.word))
        return _named(np.asarray(at.fill_null(-1)), self.ids)


@dataclass
class PairNames:
    """Names of frequent pairs of names."""

    left: np.ndarray
    right: np.ndarray
    ids: np.ndarray

    def find(self, row: dict[str, pa.Scalar]) -> np.ndarray:
        """The name of each pair of a chunk, or -1."""
        lefts, rights = np.unique(self.left), np.unique(self.right)
        place = lambda left, right: np.searchsorted(lefts, left) * np.int64(len(rights) + 1) + np.searchsorted(rights, right)
        known = place(self.left, self.right)
        order = np.argsort(known)
        left, right = np.asarray(row["left"].values), np.asarray(row["right"].values)
        at = np.searchsorted(known[order], place(left, right))
        at = order[np.minimum(at, len(order) - 1)] if len(order) else np.full(len(left), -1)
        return _named(np.where((at >= 0) & (self.left[at] == left) & (self.right[at] == right), at, -1) if len(order) else at, self.ids)


def _named(at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, ids[np.maximum(at, 0)], -1) if len(ids) else np.full(len(at), -1, dtype=np.int64)


_LEVEL = "part long, codes binary, size int, left array<long>, right array<long>, n array<long>"


def _pair_row(part: pa.Array, codes: np.ndarray, names: np.ndarray) -> dict:
    """The next level's row of a chunk whose local codes have these names; no row where no two names are neighbours."""
    table = np.append(names, -1)  # its last place is that of code -1
    out, left, right, n = pairs_of(table[codes])
    lists = (pa.array(x, pa.int64()) for x in (left, right, n))
    row = {"part": part, "codes": pa.array([_packed(out)], pa.binary()), "size": pa.array([len(out)], pa.int32()), **dict(zip(("left", "right", "n"), map(_lists, lists)))}
    return row if len(n) else {k: v.slice(0, 0) for k, v in row.items()}


def _names_of(frequent: DataFrame, *keys: str) -> WordNames | PairNames | None:
    """All names of a level, if they have ``NAMES_BYTES`` at most."""
    size = frequent.agg(F.coalesce(F.sum(sum((F.octet_length(F.col(k).cast("string")) for k in keys), F.lit(16))), F.lit(0)).alias("n")).first()["n"]
    if size > NAMES_BYTES:
        return None
    rows = frequent.select(*keys, "id").toArrow().combine_chunks()
    one = lambda c: pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], rows.schema.field(c).type)
    if "word" in keys:
        return WordNames(one("lang"), one("word"), np.asarray(one("id")))
    return PairNames(np.asarray(one("left")), np.asarray(one("right")), np.asarray(one("id")))


def _next_level(corpus: DataFrame, frequent: DataFrame, filter_: Broadcast | None, *keys: str) -> DataFrame:
    """Chunks with pairs of neighbouring names in the place of their codes. Names come by broadcast while they are few, by a join of each chunk's distinct grams beyond."""
    names = _names_of(frequent, *keys)
    if names is not None:
        shared = corpus.sparkSession.sparkContext.broadcast(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    made = _pair_row(batch.column("part").slice(i, 1), _unpacked(row["codes"].as_py(), row["size"].as_py()), shared.value.find(row))
                    release()
                    yield pa.record_batch(made)

        return checkpoint(corpus.select("part", "codes", "size", *keys).mapInArrow(run, _LEVEL), CHUNKS_A_FILE)

    def joined(chunk: pa.Table, named: pa.Table) -> pa.Table:
        if not (chunk.num_rows and named.num_rows):
            return pa.table({"part": pa.array([], pa.int64()), "codes": pa.array([], pa.binary()), "size": pa.array([], pa.int32()), **{c: pa.array([], pa.list_(pa.int64())) for c in ("left", "right", "n")}})
        codes = _unpacked(chunk.column("codes")[0].as_py(), chunk.column("size")[0].as_py())
        table = np.full(int(codes.max(initial=-1)) + 1, -1, dtype=np.int64)
        table[named.column("code").to_numpy()] = named.column("id").to_numpy()
        made = _pair_row(chunk.column("part"), codes, table)
        release()
        return pa.table(made)

    rows = _grams(corpus, filter_, *keys).join(frequent.select(*keys, "id"), list(keys)).select("chunk", "code", "id")
    return checkpoint(corpus.select("part", "codes", "size").groupBy("part").cogroup(rows.groupBy("chunk")).applyInArrow(joined, _LEVEL), CHUNKS_A_FILE)


def _counter(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    return mix(left.astype(U64) ^ mix(right.astype(U64))) >> U64(64 - bits)


def _filter(corpus: DataFrame, least: int) -> Broadcast | None:
    """A bitmap of hashed counters: whether all pairs of a counter together occur ``least`` times. A pair whose bit is 0 is not frequent.

    Counters are four for each ``least`` occurrences, so most pairs that are not frequent
    are seen to be so, but no more than ``FILTER_BITS`` allows (32 MB as bitmap); where so many say nothing there is no filter.
    """
    plus = lambda x, y: x + y
    total = corpus.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), plus)), F.lit(0)).alias("n")).first()["n"]
    bits = min(max(16, int(4 * total / least).bit_length()), FILTER_BITS)
    if total >= least << bits:
        return None
    low = min(bits, _SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right, n = (np.asarray(batch.column(c)[i].values) for c in ("left", "right", "n"))
                values, where = np.unique(_counter(left, right, bits), return_inverse=True)
                counts = np.bincount(where, weights=n, minlength=len(values)).astype("<u4")
                edges = np.flatnonzero(np.diff((values >> U64(low)).astype(np.int64), prepend=-1, append=-1))
                rows: dict[str, list] = {"slice": [], "size": [], "steps": [], "counts": []}
                for a, b in zip(edges[:-1], edges[1:]):
                    own = values[a:b] & U64((1 << low) - 1)
                    rows["slice"].append(int(values[a]) >> low)
                    rows["size"].append(int(b - a))
                    rows["steps"].append(pack(np.diff(own, prepend=U64(0)).astype("<u4")))
                    rows["counts"].append(pack(counts[a:b]))
                release()
                yield pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=list(rows))

    def add(group: pa.Table) -> pa.Table:
        sums = np.zeros(1 << low, dtype=np.int64)
        for size, steps, counts in zip(*(group.column(c).to_pylist() for c in ("size", "steps", "counts"))):
            sums[np.cumsum(unpack(steps, size, "<u4"), dtype=np.int64)] += unpack(counts, size, "<u4")
        release()
        return pa.table({"slice": group.column("slice").slice(0, 1), "bitmap": pa.array([np.packbits(sums >= least).tobytes()], pa.binary())})

    sent = corpus.select("left", "right", "n").mapInArrow(run, "slice int, size int, steps binary, counts binary")
    bitmap = np.zeros((1 << bits >> low, 1 << low >> 3), dtype=np.uint8)
    for row in sent.groupBy("slice").applyInArrow(add, "slice int, bitmap binary").collect():
        bitmap[row["slice"]] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return corpus.sparkSession.sparkContext.broadcast((bits, bitmap.reshape(-1)))


def _kept(filter_: Broadcast, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs that the filter lets pass."""
    bits, bitmap = filter_.value
    at = _counter(left, right, bits).astype(np.int64)
    return np.flatnonzero(bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)


def _frequent_pairs(corpus: DataFrame, filter_: Broadcast | None, least: int) -> DataFrame:
    """left, right, a: the pairs that occur ``least`` times, counted exactly. A chunk sends its pairs to buckets as arrays, which grow in number with the corpus."""
    plus = lambda x, y: x + y
    total = corpus.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), plus)), F.lit(0)).alias("n")).first()["n"]
    buckets = (max(1, int(total) // BUCKET_PAIRS) - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right, n = (np.asarray(batch.column(c)[i].values) for c in ("left", "right", "n"))
                kept = np.arange(len(left)) if filter_ is None else _kept(filter_, left, right)
                if not len(kept):
                    continue
                bucket = (_counter(right[kept], left[kept], buckets) if buckets else np.zeros(len(kept), dtype=U64)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                cut = lambda x: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x[kept][order], pa.int64()))
                release()
                yield pa.record_batch({"bucket": pa.array(bucket[order][edges[:-1]], pa.int64()), "left": cut(left), "right": cut(right), "n": cut(n)})

    def add(group: pa.Table) -> pa.Table:
        flat = pa.table({c: pc.list_flatten(group.column(c)) for c in ("left", "right", "n")})
        sums = flat.group_by(["left", "right"], use_threads=False).aggregate([("n", "sum")])
        release()
        return sums.select(["left", "right", "n_sum"]).rename_columns(["left", "right", "a"]).filter(pc.field("a") >= least)

    return corpus.select("left", "right", "n").mapInArrow(run, "bucket long, left array<long>, right array<long>, n array<long>").groupBy("bucket").applyInArrow(add, "left long, right long, a long")


def _grams(corpus: DataFrame, filter_: Broadcast | None, *keys: str) -> DataFrame:
    """chunk, code, keys, n: a row for each distinct gram of each chunk; pairs that ``filter_`` rules out are left out."""
    if filter_ is None:
        return corpus.select(F.col("part").alias("chunk"), F.posexplode(F.arrays_zip(*keys, "n")).alias("code", "x")).select("chunk", "code", *(F.col(f"x.{k}").alias(k) for k in (*keys, "n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right, n = (np.asarray(batch.column(c)[i].values) for c in ("left", "right", "n"))
                kept = _kept(filter_, left, right)
                part = batch.column("part")[i].as_py()
                yield pa.record_batch({"chunk": pa.array(np.full(len(kept), part), pa.int64()), "code": pa.array(kept, pa.int32()), "left": pa.array(left[kept]), "right": pa.array(right[kept]), "n": pa.array(n[kept])})

    return corpus.select("part", "left", "right", "n").mapInArrow(run, "chunk long, code int, left long, right long, n long")


def _cut(k: int) -> Column:
    """(score, words before the cut, l, r) of the lowest cut of k words."""
    wide = lambda c: c.cast("decimal(19,0)")

    def at(j: int) -> Column:
        first, rest = F.get("firsts", F.lit(j - 1)), F.get("lasts", F.lit(k - j - 1))
        whole = F.call_function("div", F.lit(1000).cast("decimal(5,0)") * (wide(F.col("a")) * wide(F.col("n"))), wide(first) * wide(rest))
        return F.struct(whole.alias("score"), F.lit(j).alias("cut"), first.alias("l"), rest.alias("r"))

    return F.array_min(F.array(*map(at, range(1, k))))


def mine_phrases(docs: DataFrame, most_words: int = 5, least: int = 100, inside_percent: int = 100) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score, cut of the phrases of 2 to ``most_words`` words with a count a of ``least`` or more.

    l and r are the counts of the two parts of the lowest-scoring cut, n all words of the language;
    the score is floor(1000 a n / (l r)). Phrases that lie in a longer one with a count of
    ``inside_percent`` or more of theirs are left out.
    """
    ship_package(docs.sparkSession)
    corpus, keys, filter_ = _corpus(docs), ("lang", "word"), None
    grams = _grams(corpus, None, *keys)
    sizes = checkpoint(grams.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = grams.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    frequent = checkpoint(frequent.select(F.monotonically_increasing_id().alias("id"), "lang", "word", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.array("a").alias("firsts"), F.array("a").alias("lasts")))
    found = []
    for k in range(2, most_words + 1):
        corpus = _next_level(corpus, frequent, filter_, *keys)
        keys, filter_ = ("left", "right"), _filter(corpus, least)
        pairs = checkpoint(_frequent_pairs(corpus, filter_, least).select(F.monotonically_increasing_id().alias("id"), *keys, "a"))
        begin = frequent.select(F.col("id").alias("left"), "lang", "phrase", "firsts")
        end = frequent.select(F.col("id").alias("right"), "last", "lasts")
        with_a = lambda c: F.concat(c, F.array("a")).alias(c)
        longer = pairs.join(begin, "left").join(end, "right").select("id", *keys, "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", with_a("firsts"), with_a("lasts"))
        longer = checkpoint(longer)
        if k > 2:
            around = longer.select(F.explode(F.array(*keys)).alias("id"), "a").groupBy("id").agg(F.max("a").alias("most"))
            held = (F.col("most") * 100 >= F.col("a") * inside_percent) & F.col("most").isNotNull()
            found.append(_scored(frequent.join(around, "id", "left").where(~F.coalesce(held, F.lit(False))), sizes, k - 1))
        frequent = longer
    found.append(_scored(frequent, sizes, most_words))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _scored(phrases: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    rows = phrases.join(sizes, "lang").withColumn("_c", _cut(k))
    return rows.select("lang", "phrase", F.lit(k).alias("words"), "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), "n", F.col("_c.score").alias("score"), F.col("_c.cut").alias("cut"))


def top_phrases(mined: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language with their rank: by score, then count, both falling, then phrase by its bytes.

    Phrases are ranked in parts first, each of which keeps its first ``most``.
    """
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    rows = mined.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("_part", "_r")
