"""k-mer composition of clusters (cluster_id, seq), and rank vectors.

Reads are sorted by cluster once, and clusters of up to ``LETTERS`` letters A, C, G, T are counted as numbers, some
together. Larger ones, and those with other letters, have a row for each k-mer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import kmers as K
from strandloom.operators import packed
from strandloom.runtime import checkpoint, ship_package

#: Letters of clusters that are counted together, and of the largest cluster counted so.
LETTERS = 1 << 20
#: The longest short k-mer counted as a number with its cluster's.
MOST_SHORT = 16


def _numbered(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.struct("cluster_id", "seq_no").alias("read_id"), "seq")


def _windows(clusters: DataFrame, long_k: int) -> DataFrame:
    rows = K.occurrences(_numbered(clusters), long_k).select(F.col("read_id.cluster_id").alias("cluster_id"), F.col("read_id.seq_no").alias("seq_no"), "pos", "kmer")
    return rows


def _frequent(clusters: DataFrame, long_k: int, least: int) -> DataFrame:
    return _windows(clusters, long_k).groupBy("cluster_id", "kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; nulls are equal."""
    a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return np.append(np.ones(min(1, len(column)), dtype=bool), pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False))


def _some_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole clusters of rows that are sorted by them, about ``LETTERS`` together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("seq").nbytes
        if size >= LETTERS:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_changes(rows.column("cluster_id").combine_chunks()))[-1])
            if last:
                yield rows.slice(0, last)
            held = rows.slice(last).to_batches()
            size = sum(x.column("seq").nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def _summed(cluster: np.ndarray, number: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of the weights of each pair of cluster and number."""
    names, code = np.unique(number, return_inverse=True)
    pairs, at = np.unique(cluster * max(1, len(names)) + code, return_inverse=True)
    return pairs // max(1, len(names)), names[pairs % max(1, len(names))], np.bincount(at, weights=weight, minlength=len(pairs)).astype(np.int64)


class _Windows:
    """The long windows of some whole clusters: ``at`` their places, ``number`` and ``cluster`` of each, and ``often`` whether it is frequent in its cluster."""

    def __init__(self, rows: pa.Table, k: int, least: int) -> None:
        cluster_id, seq = rows.column("cluster_id").combine_chunks(), rows.column("seq").cast(pa.large_string()).combine_chunks()
        first = _changes(cluster_id)
        self.ids, of_read = cluster_id.filter(pa.array(first)), np.cumsum(first) - 1
        off = np.frombuffer(seq.buffers()[1], dtype=np.int64)[seq.offset : seq.offset + len(seq) + 1]
        self.codes = packed.CODE[np.frombuffer(seq.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]]
        self.sizes = np.diff(off)
        n = max(0, len(self.codes) - k + 1)
        self.at = np.flatnonzero(np.arange(k, k + n) <= np.repeat(np.cumsum(self.sizes), self.sizes)[:n])
        self.of_place = np.repeat(of_read, self.sizes)
        self.cluster = self.of_place[self.at]
        self.number = packed.numbers(self.codes, k, False)[0][self.at] if len(self.at) else np.zeros(0, dtype=np.uint64)
        names, code = np.unique(self.number, return_inverse=True)
        _, self.first, pair, times = np.unique(self.cluster * max(1, len(names)) + code, return_index=True, return_inverse=True, return_counts=True)
        self.often_first, self.often = times >= least, (times >= least)[pair]


#: (cluster, number of the short k-mer, n) from windows and the rows they are of.
_Short = Callable[[_Windows, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _by_clusters(clusters: DataFrame, long_k: int, short_k: int, least: int, short: _Short, rowwise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """cluster_id, kmer, n by ``short`` for clusters counted as numbers, by ``rowwise`` for the others."""
    rows = clusters.select("cluster_id", "seq_no", "seq").where("seq IS NOT NULL")
    if long_k > packed.MOST or short_k > MOST_SHORT:
        return rowwise(rows)
    ship_package(clusters.sparkSession)
    sizes = rows.groupBy("cluster_id").agg(F.sum(F.octet_length("seq")).alias("letters"), F.bool_or(F.col("seq").rlike("[^ACGT]")).alias("others"))
    rest = checkpoint(sizes.where(F.col("others") | (F.col("letters") > LETTERS)).select(F.col("cluster_id").alias("_rest")))
    some = not rest.isEmpty()
    is_rest = F.col("cluster_id").eqNullSafe(F.col("_rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _some_clusters(batches):
            windows = _Windows(part, long_k, least)
            cluster, number, n = short(windows, part)
            for a in range(0, len(n), 1 << 16):
                yield pa.record_batch([windows.ids.take(pa.array(cluster[a : a + (1 << 16)])), packed.strings(number[a : a + (1 << 16)], short_k), pa.array(n[a : a + (1 << 16)])], names=["cluster_id", "kmer", "n"])

    plain = rows.join(rest, is_rest, "left_anti") if some else rows
    counted = plain.repartition("cluster_id").sortWithinPartitions("cluster_id", "seq_no").mapInArrow(run, f"cluster_id {clusters.schema['cluster_id'].dataType.simpleString()}, kmer string, n long")
    return counted.unionByName(rowwise(rows.join(rest, is_rest, "left_semi"))) if some else counted


def by_distinct_windows(clusters: DataFrame, long_k: int = 16, short_k: int = 4, least: int = 2) -> DataFrame:
    """cluster_id, kmer (canonical), n: the short k-mers of each distinct long window that occurs ``least`` times in the cluster."""
    last = long_k - short_k + 1

    def short(windows: _Windows, _: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = windows.first[windows.often_first]
        cluster, number = windows.cluster[kept], windows.number[kept]
        cut = np.concatenate([number >> np.uint64(2 * p) & np.uint64((1 << 2 * short_k) - 1) for p in range(last)])
        return _summed(np.tile(cluster, last), np.minimum(cut, packed.turn(cut, short_k)), np.ones(len(cut)))

    def rowwise(some: DataFrame) -> DataFrame:
        rows = _frequent(some, long_k, least).select("cluster_id", F.col("kmer").alias("w"), S.reverse_complement("kmer").alias("turned"))
        each = rows.select("cluster_id", "w", "turned", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("p"))
        cut = lambda x, p: F.substring(x, p, F.lit(short_k))
        found = each.select("cluster_id", F.least(cut("w", F.col("p")), cut("turned", last + 1 - F.col("p"))).alias("kmer"))
        return found.groupBy("cluster_id", "kmer").agg(F.count(F.lit(1)).alias("n"))

    return _by_clusters(clusters, long_k, short_k, least, short, rowwise)


def by_covered_positions(clusters: DataFrame, long_k: int = 16, short_k: int = 4, least: int = 2) -> DataFrame:
    """cluster_id, kmer, n: positions of short k-mers inside a frequent long window, each once; n sums both strands under either form (one that is its own reverse complement doubles). Reads of one cluster and seq_no share their positions; a null cluster has none."""

    def short(windows: _Windows, part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, n = windows.at[windows.often], len(windows.codes)
        edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + long_k - short_k + 1, minlength=n + 1)
        at = np.flatnonzero(np.cumsum(edges))
        cluster, number = windows.of_place[at], packed.numbers(windows.codes, short_k, False)[0][at] if len(at) else np.zeros(0, dtype=np.uint64)
        opens = _changes(part.column("cluster_id").combine_chunks()) | _changes(part.column("seq_no").combine_chunks())
        if not opens.all():
            read = np.repeat(np.cumsum(opens), windows.sizes)[at]
            place = at - np.repeat(np.cumsum(windows.sizes) - windows.sizes, windows.sizes)[at]
            order = np.lexsort((number, place, read))
            same = np.all([np.diff(x[order], prepend=x[order[:1]] + 1) == 0 for x in (number, place, read)], axis=0)
            cluster, number = cluster[order[~same]], number[order[~same]]
        cluster, number, n = _summed(cluster, number, np.ones(len(number)))
        return _summed(np.tile(cluster, 2), np.concatenate([number, packed.turn(number, short_k)]), np.tile(n, 2))

    def rowwise(some: DataFrame) -> DataFrame:
        good = _frequent(some, long_k, least).select("cluster_id", "kmer")
        starts = _windows(some, long_k).join(good, ["cluster_id", "kmer"], "left_semi")
        p = F.explode(F.sequence(F.lit(0), F.lit(long_k - short_k)))
        inside = starts.select("cluster_id", "seq_no", "pos", "kmer", p.alias("d"))
        places = inside.select("cluster_id", "seq_no", (F.col("pos") + F.col("d")).alias("at"), F.substring("kmer", F.col("d") + 1, F.lit(short_k)).alias("kmer")).distinct()
        one = places.groupBy("cluster_id", "kmer").agg(F.count(F.lit(1)).alias("n"))
        both = one.unionByName(one.select("cluster_id", S.reverse_complement("kmer").alias("kmer"), "n"))
        return both.groupBy("cluster_id", "kmer").agg(F.sum("n").alias("n"))

    return _by_clusters(clusters.where("cluster_id IS NOT NULL"), long_k, short_k, least, short, rowwise)


def collapse(counts: DataFrame) -> DataFrame:
    """k-mer counts under canonical forms."""
    return counts.groupBy("cluster_id", S.canonical("kmer").alias("kmer")).agg(F.sum("n").alias("n"))


def canonical_positions(spark: SparkSession, k: int) -> DataFrame:
    """idx and kmer of the canonical k-mers in order."""
    rows = spark.range(4**k).select(S.unrank(F.col("id") + 1, k).alias("kmer")).where(F.col("kmer") <= S.reverse_complement("kmer"))
    return rows.select((F.row_number().over(Window.orderBy("kmer")) - 1).alias("idx"), "kmer")


def dense(counts: DataFrame, k: int, clusters: DataFrame | None = None) -> DataFrame:
    """cluster_id, idx, n for every canonical k-mer, zero where it does not occur; for all ``clusters``, if given, those without counts too. The list of k-mers has a size fixed by k and is broadcast.

    A cluster's counts come together once; zeros are put between them there.
    """
    known = counts.join(F.broadcast(canonical_positions(counts.sparkSession, k)), "kmer", "left")
    entry = F.when(F.col("cluster_id").isNotNull() & F.col("idx").isNotNull(), F.struct("idx", F.col("n").cast("long").alias("n")))
    rows = known.groupBy("cluster_id").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    if clusters is not None:
        rows = clusters.select("cluster_id").distinct().join(rows, "cluster_id", "left")
    rows = rows.withColumn("last", F.expr("coalesce(get(v, size(v) - 1).idx, -1)"))
    between = F.expr("flatten(transform(v, (x, i) -> concat(array_repeat(0L, x.idx - coalesce(get(v, i - 1).idx, -1) - 1), array(x.n))))")
    filled = F.concat(F.coalesce(between, F.expr("cast(array() AS array<bigint>)")), F.expr(f"array_repeat(0L, {_canonical(k) - 1} - last)"))
    return rows.select("cluster_id", F.posexplode(filled).alias("idx", "n"))


def _canonical(k: int) -> int:
    return 4**k // 2 if k % 2 else (4**k + 2**k) // 2


def shares(dense_counts: DataFrame) -> DataFrame:
    """cluster_id, idx, share of the cluster's total (0 where there is none)."""
    total = F.sum("n").over(Window.partitionBy("cluster_id"))
    return dense_counts.select("cluster_id", "idx", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("share"))


def ranks(values: DataFrame, value: str = "n", ties: str = "index") -> DataFrame:
    """cluster_id, idx, rank from 0: ties by index, or shared (``ties="shared"``)."""
    if ties == "shared":
        r = F.rank().over(Window.partitionBy("cluster_id").orderBy(value)) - 1
    else:
        r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(value, "idx")) - 1
    return values.select("cluster_id", "idx", r.cast("long").alias("rank"))


def vectors(values: DataFrame, value: str) -> DataFrame:
    """cluster_id and the array of its values by idx."""
    rows = values.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("idx", value))).alias("v"))
    return rows.select("cluster_id", F.transform("v", lambda x: x[value]).alias("v"))
