"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import remove, scratch, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours link to the smallest node it knows. Edges are (a, b) with a > b."""
    least = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x"))
    least = least.groupBy("x.u").agg(F.min("x.v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, edges.b == least.u).select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    both = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return edges.join(least, edges.a == least.u).select(F.explode(both).alias("x")).select("x.*").where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead straight to the smallest node of their component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down")).where("up + down > 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``edges``; a component is its smallest node.

    Large stars and small stars take turns until every node points at its
    component's smallest node. A path halves in each round, and edges never grow in
    number. Minima are pre-aggregated before each shuffle, so a node with very many
    neighbours costs no more than its edges. Each round is a Parquet table in the
    shared folder, with its real size known to the next plan; the one before goes.

    Edges with a null end and loops are left out: a node that has no other edge is not in the result.
    """
    spark = edges.sparkSession
    rows = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    path = scratch(spark, "components")
    rows = written(rows.distinct(), path)
    for _ in range(max_rounds):
        if _settled(rows):
            return rows.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(rows.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last, path = path, scratch(spark, "components")
        rows = written(_small_star(_large_star(rows)), path)
        remove(spark, last)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
