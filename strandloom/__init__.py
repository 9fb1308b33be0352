"""Sequence analytics on Spark: reads, k-mers, grouping, profiles and clustering as DataFrame plans."""
