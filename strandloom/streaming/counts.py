"""k-mer counts of a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import kmers as K


def streaming_counts(reads: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """Running count of each k-mer, for update or complete mode; reads that arrive later add to the counts, like strings added to an index."""
    kmer = F.least("kmer", "rc") if both_strands else F.col("kmer")
    return K.occurrences(reads, k).groupBy(kmer.alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
