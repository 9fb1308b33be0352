"""Positions and running sums in a total order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import checkpoint


def with_position(df: DataFrame, name: str, *keys: str | Column, keep: list[str] | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its rows' positions from 0 in the order of ``keys`` (ties in any order).

    Rows are dealt by range and sorted once; a row's place in its partition is stored with
    it, and the partitions' sizes, one number for each, give the offsets. Only the columns
    ``keep`` are stored (all of ``df`` by default), so a long key may be left behind.
    ``sums`` maps new names to number columns whose sum over all earlier rows they hold.
    """
    keys = tuple(F.col(k) if isinstance(k, str) else k for k in keys)
    keep, sums = df.columns if keep is None else keep, sums or {}
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = checkpoint(ranged.select(*keep, *(F.col(v).cast("long").alias(f"_sum_{n}") for n, v in sums.items()), F.spark_partition_id().alias("_part"), inside.alias("_inside")))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_offset"), *(F.sum(f"_sum_{n}").alias(f"_before_{n}") for n in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = sizes.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["_offset", *(f"_before_{n}" for n in sums)]))
    rows = ranged.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long"))
    for n in sums:
        earlier = Window.partitionBy("_part").orderBy("_inside").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(n, F.col(f"_before_{n}") + F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)))
    return rows.select(*[c for c in keep if c != name and c not in sums], name, *sums)
