"""Functions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.functions import seq as S
from strandloom.operators import kmeans


def selection_sort_ranks(v):
    order, left = list(range(len(v))), list(v)
    for i in range(len(v)):
        small = min(range(i, len(v)), key=lambda j: (left[j], j))
        left[i], left[small] = left[small], left[i]
        order[i], order[small] = order[small], order[i]
    out = [0] * len(v)
    for r, i in enumerate(order):
        out[i] = r
    return out


def test_swap_ranks_equal_a_selection_sort(spark):
    rng = random.Random(4)
    vectors = [[], [1.0], [2.0, 2.0, 1.0], *([float(rng.randrange(4)) for _ in range(rng.randrange(2, 20))] for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(vectors)), "i int, v array<double>").select("i", kmeans.swap_rank_array("v").alias("r")).collect()
    assert {r.i: r.r for r in rows} == {i: selection_sort_ranks(v) for i, v in enumerate(vectors)}
    assert selection_sort_ranks([2.0, 2.0, 1.0]) == [2, 1, 0]  # ties are not in the order of their index


def test_packed_takes_no_longer_sequence(spark):
    rows = spark.createDataFrame([("A" * 128,), ("ACGT",), (None,)], "s string")
    assert rows.select(S.packed("s")).count() == 3
    with pytest.raises(Exception, match="do not fit"):
        rows.select(S.packed(F.concat("s", F.lit("C" * 4))).alias("p")).collect()


def test_packed_shift_by_a_column(spark):
    seqs = [(("ACGT" * 40)[i : i + n], b) for i, n, b in ((0, 128, 0), (1, 100, 31), (2, 70, 64), (3, 1, 127), (0, 128, 128), (1, 33, 5))]
    for r in spark.createDataFrame(seqs, "s string, b int").select("s", "b", S.packed_shift(S.packed("s"), F.col("b")).alias("p")).collect():
        value = 0
        for c in r.s:
            value = value * 4 + "ACGT".index(c)
        value = value * 4**r.b % 4**128
        words = [value >> 64 * (3 - w) & (1 << 64) - 1 for w in range(4)]
        assert [w & (1 << 64) - 1 for w in r.p] == words, r


@pytest.mark.parametrize("name", ["canonical_coverage", "whole_packed_reads", "pattern_counts"])
def test_new_queries_equal_sql(spark, name):
    from test_entry import test_spark_equals_sql

    test_spark_equals_sql(spark, name)


def test_swap_query(spark):
    rows = entry.queries()["rank_vector_swaps"](spark, "/root/testdata/sf0.001")
    assert rows.groupBy("cluster_id").agg(F.sort_array(F.collect_list("rank")).alias("r"), F.count("*").alias("n")).where("r <> sequence(0L, n - 1)").isEmpty()
