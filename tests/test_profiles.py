"""Profiles of clusters counted as numbers against those counted by rows, and how much of them is stored and sent."""

import random

import pytest

from strandloom.operators import profiles

SCHEMA = "cluster_id long, seq_no long, seq string"


def clusters(seed=3):
    rng = random.Random(seed)
    rows = [(None, 0, "ACGTACGTACGT" * 3), (None, None, "ACGTACGTAA"), (0, 0, ""), (0, 1, None), (0, 2, "AC"), (1, 0, "ACGTTGCAACGTTGCA"), (1, 0, "ACGTTGCATTGCAACG"), (1, None, "ACGTTGCA"), (1, None, "ACGTTGCA")]
    for c in range(2, 40):
        whole = "".join(rng.choice("ACGN" if c % 9 == 0 else "ACGT") for _ in range(60)) * 2
        rows += [(c, i, whole[(at := rng.randrange(60)) : at + rng.choice([3, 20, 50])]) for i in range(rng.randrange(1, 9))]
    return rows


@pytest.mark.parametrize("letters", [1, 60, 1 << 20])
@pytest.mark.parametrize("shape", [(5, 2, 2), (16, 4, 2), (7, 7, 3)])
def test_numbers_equal_rows(spark, monkeypatch, letters, shape):
    rows = spark.createDataFrame(clusters(), SCHEMA).repartition(3)
    for f in (profiles.by_distinct_windows, profiles.by_covered_positions):
        monkeypatch.setattr(profiles, "MOST_SHORT", 0)
        want = sorted(map(str, f(rows, *shape).select("cluster_id", "kmer", "n").collect()))
        monkeypatch.setattr(profiles, "MOST_SHORT", 16)
        monkeypatch.setattr(profiles, "LETTERS", letters)
        got = f(rows, *shape)
        assert got.schema.simpleString() == "struct<cluster_id:bigint,kmer:string,n:bigint>"
        assert sorted(map(str, got.collect())) == want and want


def test_no_row_for_each_window(spark):
    """Each read is sent, not its windows: no step makes rows of them."""
    rows = spark.createDataFrame([(c, 0, "ACGGT" * 200) for c in range(20)], SCHEMA)
    for f in (profiles.by_distinct_windows, profiles.by_covered_positions):
        assert "Generate" not in f(rows)._jdf.queryExecution().toString()
    assert profiles.by_covered_positions(rows.where("seq_no < 0")).count() == 0


def test_dense_puts_zeros(spark):
    counts = spark.createDataFrame([(1, "AC", 5), (1, "TA", 2), (2, "GT", 9), (None, "AC", 3)], "cluster_id long, kmer string, n long")
    want = {c: [0] * 10 for c in (None, 1, 2, 3)} | {1: [0, 5, 0, 0, 0, 0, 0, 0, 0, 2]}
    ids = spark.createDataFrame([(1,), (3,), (3,)], "cluster_id long")
    for given, names in ((None, [None, 1, 2]), (ids, [1, 3])):
        found = profiles.dense(counts, 2, given)
        got = sorted(((r.cluster_id, r.idx, r.n) for r in found.collect()), key=str)
        assert got == sorted(((c, i, n) for c in names for i, n in enumerate(want[c])), key=str)
    empty = profiles.dense(counts.where("n < 0"), 2)
    assert empty.count() == 0
