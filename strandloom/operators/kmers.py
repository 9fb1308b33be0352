"""k-mers of reads: occurrences, counts, and maximality.

Neighbour symbols are kept as bit masks ($ 1, A 2, C 4, G 8, T 16), so every
predicate is one aggregation with map-side combination. k-mers of up to ``packed.MOST`` letters
are tallied as numbers (``packed``); longer ones, and those that hold another letter, are rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandloom.functions import seq as S
from strandloom.operators import packed
from strandloom.runtime import checkpoint


def occurrences(reads: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """key, pos, kmer, rc (its reverse complement), next and prev ($ at an end) of every k-mer occurrence; shorter reads give none.

    A read is turned once, and rc cut from there; where rc is not used, no read is turned.
    """
    n = F.length("seq")
    turned = reads.where(n >= k).select(key, "seq", S.reverse_complement("seq").alias("_turned"))
    rows = turned.select(key, "seq", "_turned", F.explode(F.sequence(F.lit(1), n - k + 1)).alias("p"))
    return rows.select(
        key,
        (F.col("p") - 1).cast("long").alias("pos"),
        F.substring("seq", F.col("p"), F.lit(k)).alias("kmer"),
        F.substring("_turned", n - F.col("p") - k + 2, F.lit(k)).alias("rc"),
        F.when(F.col("p") + k <= n, F.substring("seq", F.col("p") + k, F.lit(1))).otherwise("$").alias("next"),
        F.when(F.col("p") > 1, F.substring("seq", F.col("p") - 1, F.lit(1))).otherwise("$").alias("prev"),
    )


def windows(reads: DataFrame, k: int) -> DataFrame:
    """m: the ``k`` letters from each place of a read on, fewer at its end. Every k-mer of ``k`` letters or fewer begins one of them."""
    rows = reads.where("seq <> ''").select("seq", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("p"))
    return rows.select(F.substring("seq", F.col("p"), F.lit(k)).alias("m"))


def symbol_bit(column: str) -> Column:
    """The bit of a neighbour symbol."""
    return F.expr(f"shiftleft(1, locate({column}, '$ACGT') - 1)")


def complement_bit(column: str) -> Column:
    """The bit of a neighbour symbol's complement."""
    return F.expr(f"shiftleft(1, locate({column}, '$TGCA') - 1)")


def rows_left(reads: DataFrame, k: int, most: int) -> DataFrame:
    """The occurrences that are not tallied as numbers: all of longer k-mers, else those with another letter than A, C, G, T."""
    reads = reads if "read_id" in reads.columns else reads.withColumn("read_id", F.lit(None).cast("long"))
    if k > most:
        return occurrences(reads, k)
    return occurrences(reads.where("seq RLIKE '[^ACGT]'"), k).where("kmer RLIKE '[^ACGT]'")


def both_ways(reads: DataFrame, k: int, tallied: Callable[[packed.Chunks], DataFrame], rowwise: Callable[[DataFrame], DataFrame], key: str | None = None) -> DataFrame:
    """What ``tallied`` makes of reads in chunks, with what ``rowwise`` makes of ``rows_left`` where there are such."""
    most = packed.MOST
    if k > most:
        return rowwise(rows_left(reads, k, most))
    chunks = packed.chunked(reads, key, times=packed.CHUNK_TIMES)
    found = tallied(chunks)
    return found.unionByName(rowwise(rows_left(reads, k, most))) if chunks.others else found


def _counted(rows: DataFrame, kmer: Column | str) -> DataFrame:
    return rows.groupBy(kmer).agg(F.count(F.lit(1)).alias("n"))


def counts(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """kmer and its occurrences, where they are ``least`` at least."""
    tallied = lambda chunks: packed.tally(chunks, k, masks=False, keep=lambda n, *_: n >= least).select("kmer", "n")
    return both_ways(reads, k, tallied, lambda rows: _counted(rows, "kmer").where(F.col("n") >= least))


def canonical_counts(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """Occurrences of each k-mer on either strand under its smaller form; its own reverse complement counts once. Those of ``least`` at least."""
    tallied = lambda chunks: packed.tally(chunks, k, strands=True, masks=False, keep=lambda n, m, *_: n + m >= least).select("kmer", (F.col("n") + F.col("m")).alias("n"))
    return both_ways(reads, k, tallied, lambda rows: _counted(rows, F.least("kmer", "rc").alias("kmer")).where(F.col("n") >= least))


def neighbourhoods(reads: DataFrame, k: int, keep: packed.Keep | None = None) -> DataFrame:
    """kmer, n, nexts and prevs (bit masks). k-mers that ``keep`` does not keep may be left out."""
    sums = F.count(F.lit(1)).alias("n"), F.bit_or(symbol_bit("next")).alias("nexts"), F.bit_or(symbol_bit("prev")).alias("prevs")
    tallied = lambda chunks: packed.tally(chunks, k, keep=keep).select("kmer", "n", F.col("first").alias("nexts"), F.col("second").alias("prevs"))
    return both_ways(reads, k, tallied, lambda rows: rows.groupBy("kmer").agg(*sums))


def _maximal(mask: str, n: str = "n") -> Column:
    return F.expr(f"bit_count({mask}) >= 2 OR ({n} >= 2 AND {mask} % 2 = 1)")


def right_maximal(reads: DataFrame, k: int) -> DataFrame:
    """k-mers with two next symbols, or that occur twice and end a read."""
    return neighbourhoods(reads, k, lambda n, m, nexts, *_: packed.maximal(nexts, n)).where(_maximal("nexts")).select("kmer", "n")


def left_maximal(reads: DataFrame, k: int) -> DataFrame:
    return neighbourhoods(reads, k, lambda n, m, nexts, prevs, _: packed.maximal(prevs, n)).where(_maximal("prevs")).select("kmer", "n")


def supermaximal(reads: DataFrame, k: int) -> DataFrame:
    """k-mers all of whose next symbols differ, and all of whose previous ones (ends count as one symbol)."""
    return neighbourhoods(reads, k).where("bit_count(nexts) = n AND bit_count(prevs) = n").select("kmer", "n")


def _paired(occurring: DataFrame) -> DataFrame:
    rows = occurring.select(
        F.least("kmer", "rc").alias("kmer"),
        F.expr("kmer <= rc").alias("fwd"),
        F.expr("kmer = rc").alias("own"),
        symbol_bit("next").alias("after"),
        complement_bit("prev").alias("before"),
    )
    return rows.groupBy("kmer").agg(
        F.sum(F.col("fwd").cast("long")).alias("n_fwd"),
        F.sum((~F.col("fwd")).cast("long")).alias("n_rev"),
        F.bool_or("own").alias("own"),
        F.bit_or(F.when(F.col("own"), F.col("after").bitwiseOR(F.col("before"))).when(F.col("fwd"), F.col("after")).otherwise(F.col("before"))).alias("nexts_fwd"),
        F.bit_or(F.when(F.col("own"), F.lit(0)).when(F.col("fwd"), F.col("before")).otherwise(F.col("after"))).alias("nexts_rev"),
    )


def strand_pairs(reads: DataFrame, k: int, keep: packed.Keep | None = None, masks: bool = True, turned: bool = False) -> DataFrame:
    """One row for a k-mer and its reverse complement (rc, where ``turned``): occurrences of each, and (unless not ``masks``) the next symbols of each on both strands. Those that ``keep`` does not keep may be left out."""
    names = [F.col(a).alias(b) for a, b in (("kmer", "kmer"), ("n", "n_fwd"), ("m", "n_rev"), ("own", "own"))]
    names += [F.col(a).alias(b) if masks else F.lit(0).alias(b) for a, b in (("first", "nexts_fwd"), ("second", "nexts_rev"))]
    names += ["rc"] if turned else []
    rowwise = lambda rows: _paired(rows).withColumn("rc", S.reverse_complement("kmer")) if turned else _paired(rows)
    return both_ways(reads, k, lambda chunks: packed.tally(chunks, k, strands=True, masks=masks, keep=keep, turned=turned).select(*names), rowwise)


def _sides() -> tuple[Column, Column]:
    """Whether the smaller form of a strand pair with its n occurs and is right-maximal, and whether the larger does."""
    return F.expr("n_fwd > 0") & _maximal("nexts_fwd"), F.expr("NOT own AND n_rev > 0") & _maximal("nexts_rev")


def right_maximal_both(reads: DataFrame, k: int) -> DataFrame:
    """Strand-aware right-maximal k-mers that occur themselves: kmer, n (both strands; one that is its own reverse complement counts forward only)."""
    fwd, rev = _sides()
    forms = F.array_compact(F.array(F.when(fwd, F.col("kmer")), F.when(rev, F.col("rc"))))
    return strand_pairs(reads, k, packed.maximal_either, turned=True).withColumn("n", F.col("n_fwd") + F.col("n_rev")).select(F.explode(forms).alias("kmer"), "n")


def right_maximal_canonical(reads: DataFrame, k: int) -> DataFrame:
    """The smaller forms of ``right_maximal_both``, each once: kmer, n."""
    return _either(strand_pairs(reads, k, packed.maximal_either))


def right_maximal_canonical_of(occurring: DataFrame) -> DataFrame:
    """Those of all given rows of ``occurrences``."""
    return _either(_paired(occurring))


def _either(pairs: DataFrame) -> DataFrame:
    fwd, rev = _sides()
    return pairs.withColumn("n", F.col("n_fwd") + F.col("n_rev")).where(fwd | rev).select("kmer", "n")


def symbols(reads: DataFrame) -> DataFrame:
    """Occurrences of each base, and of the end mark $ (one a read), with the sum of the smaller ones' occurrences."""
    one = F.explode(F.split("seq", "")).alias("ch")
    rows = reads.select(one).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    ends = reads.agg(F.count(F.lit(1)).alias("n")).select(F.lit("$").alias("ch"), "n")
    return rows.unionByName(ends)


def cumulative(symbol_counts: DataFrame) -> DataFrame:
    """``smaller``: occurrences of all smaller symbols; a frame of one row a symbol."""
    small = symbol_counts.select(F.col("ch").alias("c0"), F.col("n").alias("n0"))
    joined = symbol_counts.join(F.broadcast(small), F.col("c0") < F.col("ch"), "left")
    return joined.groupBy("ch", "n").agg(F.coalesce(F.sum("n0"), F.lit(0)).cast("long").alias("smaller"))


def extension_counts(reads: DataFrame, k: int) -> DataFrame:
    """Occurrences of each k-mer extended by one symbol to the right."""
    return occurrences(reads, k).groupBy("kmer", "next").agg(F.count(F.lit(1)).alias("n"))


def left_extension_counts(reads: DataFrame, k: int) -> DataFrame:
    """Occurrences of each k-mer extended by one symbol to the left."""
    return occurrences(reads, k).groupBy("kmer", "prev").agg(F.count(F.lit(1)).alias("n"))


def _uncovered(at: DataFrame, *kmer: str) -> DataFrame:
    """The k-mers of ``at`` (a row for each occurrence, with the letters ``between`` it and the nearest before) that none covers, with n."""
    found = at.groupBy(*kmer).agg(F.count(F.lit(1)).alias("n"), F.min("between").alias("a"), F.max("between").alias("b"), F.count("between").alias("m"))
    return found.where("m < n OR a <> b").select(*kmer, "n")


def _repeats(reads: DataFrame, k: int) -> tuple[DataFrame, list[str]]:
    """Occurrences of right-maximal k-mers with n of two or more: read_id, between, and the columns that name the k-mer."""
    chunks = _repeat_chunks(reads, k)
    if chunks is not None:
        return packed.repeats(chunks, k), ["low", "high"]
    at, kmer = _row_repeats(reads, k)
    return at, [kmer]


def _repeat_chunks(reads: DataFrame, k: int) -> packed.Chunks | None:
    """Reads in chunks where all k-mers can be two numbers there, else none."""
    if k <= packed.LONGEST and isinstance(reads.schema["read_id"].dataType, LongType):
        chunks = packed.chunked(reads, "read_id", times=packed.LONG_TIMES)
        return None if chunks.others else chunks
    return None


def _row_repeats(reads: DataFrame, k: int) -> tuple[DataFrame, str]:
    marked = right_maximal(reads, k).where("n >= 2").select("kmer")
    at = occurrences(reads, k).select("read_id", "pos", "kmer").join(marked, "kmer")
    before = F.lag("pos").over(Window.partitionBy("read_id").orderBy("pos"))
    at = at.withColumn("before", before).join(reads.select("read_id", "seq"), "read_id")
    between = F.when(F.col("before").isNotNull(), F.expr("substring(seq, cast(before + 1 AS int), cast(pos - before AS int))"))
    return at.select("kmer", "read_id", between.alias("between")), "kmer"


def submaximal(reads: DataFrame, k: int) -> DataFrame:
    """kmer, n of right-maximal k-mers (n of two or more) that no other of them covers.

    One covers another if it starts before every occurrence of it, at one distance and with
    the same letters between. The nearest one before decides, so each read's occurrences
    in order and one aggregation tell.
    """
    chunks = _repeat_chunks(reads, k)
    if chunks is not None:
        return packed.named(packed.uncovered(chunks, k), k)
    return _uncovered(*_row_repeats(reads, k))


def submaximal_reads(reads: DataFrame, k: int) -> tuple[DataFrame, list[str]]:
    """read_id and the columns that name the k-mer, for each submaximal k-mer and the reads that hold it; those columns."""
    at, kmer = _repeats(reads, k)
    at = checkpoint(at)
    return at.join(_uncovered(at, *kmer), kmer, "left_semi").select(*kmer, "read_id").distinct(), kmer


def suffix_tree_nodes(reads: DataFrame, depths: range) -> DataFrame:
    """depth, kmer, n of the right-maximal k-mers of each depth."""
    parts = [right_maximal(reads, k).withColumn("depth", F.lit(k)) for k in depths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
