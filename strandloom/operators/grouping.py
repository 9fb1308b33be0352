"""Groups of reads that share long k-mers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandloom.functions import seq as S
from strandloom.operators import kmers as K
from strandloom.operators import packed
from strandloom.operators.components import connected_components
from strandloom.runtime import checkpoint


def _chunks(reads: DataFrame, k: int) -> packed.Chunks | None:
    """Reads in chunks where k-mers can be two numbers there, else none."""
    fits = k <= packed.LONGEST and isinstance(reads.schema["read_id"].dataType, LongType)
    return packed.chunked(reads, "read_id", times=packed.LONG_TIMES) if fits else None


def star_edges(reads: DataFrame, k: int, both_strands: bool = False, chunks: packed.Chunks | None = None) -> DataFrame:
    """(rep, read_id): each read of a k-mer with the k-mer's smallest read, never all pairs. ``chunks`` are the reads' where they were made before."""
    kmer = F.least("kmer", "rc") if both_strands else F.col("kmer")

    def rowwise(occurring: DataFrame) -> DataFrame:
        rows = occurring.select("read_id", kmer.alias("kmer"))
        reps = rows.groupBy("kmer").agg(F.min("read_id").alias("rep"), F.max("read_id").alias("last")).where("rep < last").drop("last")
        return rows.join(reps, "kmer").where("rep <> read_id").select("rep", "read_id")

    chunks = _chunks(reads, k) if chunks is None else chunks
    if chunks is None:
        return rowwise(K.occurrences(reads, k)).distinct()
    edges = packed.stars(chunks, k, both_strands)
    return edges.unionByName(rowwise(K.rows_left(reads, k, packed.LONGEST))).distinct() if chunks.others else edges


def submaximal_components(reads: DataFrame, k: int) -> DataFrame:
    """The ``components`` of reads, forward strand, from k-submaximal repeats alone: fewer k-mers, the same groups."""
    rows, kmer = K.submaximal_reads(reads, k)
    rows = checkpoint(rows)
    reps = rows.groupBy(*kmer).agg(F.min("read_id").alias("rep"))
    found = connected_components(rows.join(reps, kmer).where("rep <> read_id").select("rep", "read_id").distinct(), "rep", "read_id")
    return reads.select("read_id").join(found, F.col("read_id") == F.col("node"), "left").select("read_id", F.coalesce("component", "read_id").alias("comp"))


def strand_kmer_pairs(reads: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers that occur on both strands, with their occurrences; own reverse complements are left out."""
    pairs = K.strand_pairs(reads, k, lambda n, m, first, second, own: ~own & (n > 0) & (m > 0), masks=False, turned=True).where("NOT own AND n_fwd > 0 AND n_rev > 0")
    return pairs.select("kmer", "rc", F.col("n_fwd").alias("n"), F.col("n_rev").alias("n_rc"))


def components(reads: DataFrame, k: int, both_strands: bool = False, mates: DataFrame | None = None, chunks: packed.Chunks | None = None) -> DataFrame:
    """(read_id, comp) of every read: reads that share a k-mer, or are mates, have one comp, its smallest read."""
    edges = star_edges(reads, k, both_strands, chunks)
    if mates is not None:
        edges = edges.unionByName(mates.select(F.col("r1").alias("rep"), F.col("r2").alias("read_id")))
    found = connected_components(edges, "rep", "read_id").select(F.col("node").alias("read_id"), F.col("component").alias("comp"))
    return reads.select("read_id").join(found, "read_id", "left").select("read_id", F.coalesce("comp", "read_id").alias("comp"))


def sizes(groups: DataFrame, by: str = "comp") -> DataFrame:
    return groups.groupBy(by).agg(F.count(F.lit(1)).alias("size"))


def large_groups(groups: DataFrame, least: int, by: str = "comp") -> DataFrame:
    """The members of groups of ``least`` reads or more."""
    big = sizes(groups, by).where(F.col("size") >= least).select(by)
    return groups.join(big, by, "left_semi")


def statistics(groups: DataFrame, least: int, by: str = "comp") -> DataFrame:
    """One row: groups, large groups, reads, reads in large groups."""
    large = F.col("size") >= least
    return sizes(groups, by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(large.cast("long")), F.lit(0)).alias("large_groups"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("reads"),
        F.coalesce(F.sum(F.when(large, F.col("size")).otherwise(0)), F.lit(0)).alias("kept_reads"),
    )


class _Forest:
    def __init__(self, items):
        self.parent = {x: x for x in items}
        self.size = dict.fromkeys(self.parent, 1)

    def find(self, x):
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            small, large = sorted((a, b), key=lambda r: (self.size[r], r))
            self.parent[small] = large
            self.size[large] += self.size[small]


def capped_union(rows: pd.DataFrame, max_size: int, fragment: int = 100) -> pd.DataFrame:
    """Size-capped union of one component's events in their fixed order.

    ``rows`` has read_id, pos, kmer and kind: ``kmer`` events (a read at a k-mer),
    ``mate`` events (kmer holds the mate's id) and ``both`` events of reads
    that meet on opposite strands. Mates join first and always. K-mer events
    follow by read and position, both falling: the read joins its k-mer's
    representative if both groups are within ``max_size``, or either is below
    ``fragment``; a representative whose group is smaller gives way. Opposite strands
    join last if the sum of sizes is within ``max_size``.
    """
    forest = _Forest(rows["read_id"])
    for r in rows[rows["kind"] == "mate"].sort_values(["read_id", "kmer"]).itertuples():
        forest.join(r.read_id, int(r.kmer))
    rep: dict[str, int] = {}
    for r in rows[rows["kind"] == "kmer"].sort_values(["read_id", "pos"], ascending=False).itertuples():
        other = rep.setdefault(r.kmer, r.read_id)
        a, b = forest.find(other), forest.find(r.read_id)
        if a == b:
            continue
        sa, sb = forest.size[a], forest.size[b]
        if (sa <= max_size and sb <= max_size) or sa < fragment or sb < fragment:
            forest.join(a, b)
        elif sb < sa:
            rep[r.kmer] = r.read_id
    for r in rows[rows["kind"] == "both"].sort_values(["kmer", "read_id"]).itertuples():
        a, b = forest.find(r.read_id), forest.find(r.pos)
        if a != b and forest.size[a] + forest.size[b] <= max_size:
            forest.join(a, b)
    out = pd.DataFrame({"read_id": sorted(forest.parent)})
    root = out["read_id"].map(forest.find)
    out["group_id"] = out.groupby(root)["read_id"].transform("min")
    return out


def _kmer_events(reads: DataFrame, k: int, both_strands: bool, submaximal: bool) -> DataFrame:
    """The ``kmer`` and ``both`` events of ``capped_union``, from a row for each occurrence of a k-mer."""
    keep = (K.submaximal(reads, k) if submaximal else K.right_maximal(reads, k).where("n >= 2")).select("kmer")
    occ = K.occurrences(reads, k).select("read_id", "pos", "kmer")
    events = occ.join(keep, "kmer", "left_semi").select("read_id", "pos", "kmer", F.lit("kmer").alias("kind"))
    if both_strands:
        first = K.right_maximal_both(reads, k).select("kmer").distinct()
        ends = occ.join(first, "kmer", "left_semi").groupBy("kmer").agg(F.min("read_id").alias("r"))
        other = ends.select(S.reverse_complement("kmer").alias("kmer"), F.col("r").alias("r2"))
        meet = ends.join(other, "kmer").where("kmer < reverse(translate(kmer, 'ACGT', 'TGCA'))")
        events = events.unionByName(meet.select(F.col("r").alias("read_id"), F.col("r2").alias("pos"), "kmer", F.lit("both").alias("kind")))
    return events


def _packed_events(chunks: packed.Chunks, k: int, both_strands: bool) -> DataFrame:
    """The same events from k-mers as numbers: rows are only those of the events."""
    events = packed.named(packed.repeats(chunks, k, places=True), k, "read_id", "pos").select("read_id", "pos", "kmer", F.lit("kmer").alias("kind"))
    if both_strands:
        meet = packed.meeting(chunks, k).select(F.col("r").alias("read_id"), F.col("r2").alias("pos"), "kmer", F.lit("both").alias("kind"))
        events = events.unionByName(meet)
    return checkpoint(events)  # what was sent goes from the disk here


def capped_groups(reads: DataFrame, k: int, max_size: int, fragment: int = 100, both_strands: bool = True, mates: DataFrame | None = None, bundle: int = 20_000, submaximal: bool = False) -> DataFrame:
    """(read_id, group_id): components whose unions obey the size rule of ``capped_union``.

    With ``submaximal`` the events are those of k-submaximal repeats, on the forward strand only.

    A union never leaves an uncapped component, so components are independent and
    run side by side, small ones in bundles of about ``bundle`` reads. Within one the
    order of unions decides the result, so a component is one task's work.
    """
    if submaximal and both_strands:
        raise ValueError("submaximal repeats have no form for both strands")
    chunks = _chunks(reads, k)
    comp = checkpoint(components(reads, k, both_strands, mates, chunks))
    events = _kmer_events(reads, k, both_strands, submaximal) if submaximal or chunks is None or chunks.others else _packed_events(chunks, k, both_strands)
    if mates is not None:
        events = events.unionByName(mates.select(F.col("r1").alias("read_id"), F.lit(0).cast("long").alias("pos"), F.col("r2").cast("string").alias("kmer"), F.lit("mate").alias("kind")))
    lone = sizes(comp).where("size = 1").select("comp")
    comp = comp.join(lone, "comp", "left_anti").select("read_id", "comp")
    own = comp.select("read_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("kmer"), F.lit("self").alias("kind"))
    n = max(1, -(-comp.count() // bundle))
    work = events.unionByName(own).join(comp, "read_id").withColumn("bundle", F.pmod(F.xxhash64("comp"), F.lit(n)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return capped_union(part, max_size, fragment)

    alone = lone.select(F.col("comp").alias("read_id"), F.col("comp").alias("group_id"))
    return work.groupBy("bundle").applyInPandas(run, "read_id long, group_id long").unionByName(alone)
