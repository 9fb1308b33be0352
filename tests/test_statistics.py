"""Statistics of a run, observed in its own writes."""

import random

from pyspark.sql import functions as F

from strandloom.plans import pipeline
from strandloom.plans.config import Config


def reads_file(path, n):
    rng = random.Random(5)
    genomes = ["".join(rng.choice("ACGT") for _ in range(160)) for _ in range(3)]
    path.write_text("".join(f">r\n{g[i : i + 60]}\n" for g in genomes[:n] for i in range(0, 100, 6)))
    return str(path)


def settings(path, **more):
    return Config(input_reads=path, read_filtering_threshold=2, precluster_min_size=3, preclustering_k=20, precluster_max_size=100, kmeans_number_of_clusters=2, kmeans_number_of_rounds=3, **more)


def test_counts_equal_those_of_the_result(spark, tmp_path):
    final, stats = pipeline.timed_run(spark, settings(reads_file(tmp_path / "in.fa", 3), final_clusters_out=str(tmp_path / "final")))
    want = final.agg(F.count(F.lit(1)).alias("sequences"), F.countDistinct("final").alias("clusters"), F.countDistinct("cluster_id").alias("preclusters")).first().asDict()
    assert {k: stats[k] for k in want} == want and want["preclusters"] == 3 and want["sequences"] == 51
    assert stats["seconds"] > 0 and stats["driver_mb"] > 0


def test_peaks_of_executors(spark):
    spark.range(1000).repartition(3).agg(F.collect_list("id")).collect()
    before = pipeline.peak_memory(spark)
    assert set(before) == {"driver"} and before["driver"] > 1
    spark.range(1 << 20).repartition(3).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id")).collect()
    assert pipeline.peak_memory(spark)["driver"] >= before["driver"]


def test_nothing_left(spark, tmp_path):
    (tmp_path / "in.fa").write_text(">r\nACGTACGTACGTACGTACGTACGTACGTACGT\n")
    final, stats = pipeline.timed_run(spark, settings(str(tmp_path / "in.fa")))
    assert final.count() == stats["sequences"] == stats["preclusters"] == stats["clusters"] == 0
