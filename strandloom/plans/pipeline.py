"""The whole clustering pipeline, and its k-means part alone."""

from __future__ import annotations

import resource
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import filtering, grouping, kmeans, profiles, reads
from strandloom.operators.order import with_position
from strandloom.plans.config import Config
from strandloom.runtime import checkpoint
from strandloom.sources import readers, writers


def preclusters(raw: DataFrame, config: Config) -> DataFrame:
    """cluster_id, seq_no, seq of groups of reads that share long k-mers, from ``raw`` (record_no, seq and, for mates, place of valid reads)."""
    ranked = with_position(raw, "orig_rank", "record_no")
    unique = reads.with_read_ids(reads.dedupe(ranked))
    mates = None
    if config.paired_ends:
        pairs = reads.consecutive_pairs(ranked, "record_no", "orig_rank", "place")
        mates = reads.remap_pairs(pairs, unique, "orig_rank", "read_id")
    good, bad = filtering.good_and_bad(unique.select("read_id", "seq"), config.read_filtering_k, config.read_filtering_threshold)
    if config.filtering_good_out:
        writers.fasta(good, config.filtering_good_out)
    if config.filtering_bad_out:
        writers.fasta(bad, config.filtering_bad_out)
    kept = reads.with_read_ids(good.select(F.col("read_id").alias("old_id"), "seq"))
    if mates is not None:
        mates = checkpoint(reads.remap_pairs(mates, kept, "old_id", "read_id"))
    kept = checkpoint(kept.select("read_id", "seq"))
    groups = grouping.capped_groups(kept, config.preclustering_k, config.precluster_max_size, mates=mates)
    large = grouping.large_groups(checkpoint(groups), config.precluster_min_size, "group_id")
    ids = with_position(large.select("group_id").distinct(), "cluster_id", "group_id")
    return reads.lookup(large, kept).join(ids, "group_id").select("cluster_id", F.col("read_id").alias("seq_no"), "seq")


def cluster(pre: DataFrame, config: Config, watch: Observation | None = None) -> DataFrame:
    """final, cluster_id, seq_no, seq: preclusters joined by k-means on their profiles. ``watch`` sees the assignment, a row for each precluster."""
    k = config.kmeans_kmer_length
    counted = profiles.by_covered_positions(pre, short_k=k) if config.run_metacluster else profiles.by_distinct_windows(pre, short_k=k)
    if config.run_metacluster:
        counted = profiles.collapse(counted)
    shares = profiles.shares(profiles.dense(counted, k, pre))
    points = profiles.vectors(shares, "share").select(F.col("cluster_id").alias("id"), F.col("v").alias("profile"))
    if config.run_metacluster:
        found = kmeans.adaptive(points)
    else:
        found = kmeans.kmeans(points, config.kmeans_number_of_clusters, config.kmeans_number_of_rounds).assignment
    found = found.select(F.col("id").alias("cluster_id"), F.col("cluster").alias("final"))
    if watch is not None:  # the set has at most as many numbers as k-means has clusters
        found = checkpoint(found.observe(watch, F.count(F.lit(1)).alias("preclusters"), F.size(F.collect_set("final")).alias("clusters")))
    rows = pre.join(found, "cluster_id")
    return rows.select("final", "cluster_id", "seq_no", "seq")


def peak_memory(spark: SparkSession) -> dict[str, float]:
    """The most memory in MB that was in use at once in each executor's JVM, on the heap and off it, as their heartbeats told; in a local session the driver is the executor.

    Executors that were lost count, those that have told nothing yet (no stage has ended) do not.
    """
    executors, found = spark.sparkContext._jsc.sc().statusStore().executorList(False), {}
    for i in range(executors.size()):
        told = executors.apply(i).peakMemoryMetrics()
        if told.isDefined():
            found[executors.apply(i).id()] = sum(told.get().getMetricValue(m) for m in ("JVMHeapMemory", "JVMOffHeapMemory")) / 2**20
    return found


def timed_run(spark: SparkSession, config: Config) -> tuple[DataFrame, dict[str, float]]:
    """``run``, written, with its statistics: sequences, preclusters, clusters, seconds, and in MB the peak memory of the driver's Python and the highest one of a JVM.

    The counts are observed while the result is written, so no job runs for them. Without sequences all are 0.
    """
    began = time.monotonic()
    groups, rows = Observation(), Observation()
    final = checkpoint(run(spark, config, groups).observe(rows, F.count(F.lit(1)).alias("sequences")))
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    jvm = max(peak_memory(spark).values(), default=0.0)
    return final, rows.get | groups.get | {"seconds": time.monotonic() - began, "driver_mb": peak, "jvm_mb": jvm}


def run(spark: SparkSession, config: Config, watch: Observation | None = None) -> DataFrame:
    """Read, cluster and, where the settings name places, write. Returns the final clusters. ``watch`` as in ``cluster``."""
    if config.only_kmeans:
        pre = readers.clusters(spark, config.preclusters_out)
    else:
        if config.paired_ends and readers.fasta(spark, config.input_reads, validate=False).where("record_no IS NOT NULL").count() % 2:
            raise ValueError("an odd number of reads has no mates")
        pre = checkpoint(preclusters(readers.fasta(spark, config.input_reads, places=True), config))
        if config.preclusters_out:
            writers.clusters(pre, config.preclusters_out)
    final = cluster(pre, config, watch)
    if config.final_clusters_out:
        writers.clusters(final.select(F.col("final").alias("cluster_id"), F.struct("cluster_id", "seq_no").alias("seq_no"), "seq"), config.final_clusters_out)
    return final
