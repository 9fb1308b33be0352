"""Writers of sequence files. Parquet is the plain choice for all tables; these give the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fasta(reads: DataFrame, path: str, header: str | None = None) -> None:
    """A FASTA folder; the header line is empty unless a column is named."""
    name = F.col(header).cast("string") if header else F.lit("")
    reads.select(F.concat(F.lit(">"), name, F.lit("\n"), F.col("seq"))).write.text(path)


def groups(group_rows: DataFrame, path: str) -> None:
    """The read ids of each group on a line, in order."""
    rows = group_rows.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("read_id")), " ").alias("value"))
    rows.select("value").write.text(path)


def clusters(rows: DataFrame, path: str) -> None:
    """cluster_id, seq_no, seq as cluster FASTA: the first sequence of a cluster has the header ``cluster_start``."""
    inside = Window.partitionBy("cluster_id").orderBy("seq_no")
    first = F.when(F.row_number().over(inside) == 1, F.lit(">cluster_start\n")).otherwise(F.lit(">\n"))
    marked = rows.withColumn("value", F.concat(first, "seq"))
    marked.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id", "seq_no").select("value").write.text(path)


def index(runs: DataFrame, path: str, in_order: bool = False) -> None:
    """Save the runs (start, ch, length) of an index, in order of start over the files; ``in_order`` if they come in that order.

    Starts are stored as differences, and small numbers as such: some bytes for a run.
    """
    rows = runs.select("start", "ch", "length")
    rows = rows if in_order else rows.repartitionByRange("start").sortWithinPartitions("start")
    rows.write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.enable.dictionary#start", "false").parquet(path)


def mate_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("r1", "r2").write.csv(path, sep=" ")
