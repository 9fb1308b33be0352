"""Submaximal repeats found in chunks against those found by rows."""

import random

import numpy as np
import pytest

from strandloom.operators import grouping, kmers, packed


@pytest.mark.parametrize("k", [5, 28, 36])
def test_chunks_equal_rows(spark, monkeypatch, k):
    rng = random.Random(k)
    whole = "".join(rng.choice("ACGT") for _ in range(150))
    seqs = ["", "A", "A" * 60, "AC" * 40, *(whole[(at := rng.randrange(100)) : at + rng.randrange(3, 90)] for _ in range(60))]
    rows = spark.createDataFrame([(3 * i - 9, s) for i, s in enumerate(sorted(set(seqs)))], "read_id long, seq string").repartition(3)
    monkeypatch.setattr(packed, "CHUNK_LETTERS", 500)
    monkeypatch.setattr(packed, "BUCKET_KEYS", 300)
    assert kmers._repeats(rows, k)[1] == ["low", "high"]
    got = [sorted(tuple(r) for r in f.collect()) for f in (kmers.submaximal(rows, k), grouping.submaximal_components(rows, k).select("read_id", "comp"))]
    mixed = kmers.submaximal(rows.unionByName(spark.createDataFrame([(999, "N" * 50 + "ACN")], rows.schema)), k)
    monkeypatch.setattr(packed, "LONGEST", 0)
    assert kmers._repeats(rows, k)[1] == ["kmer"]
    want = [sorted(tuple(r) for r in f.collect()) for f in (kmers.submaximal(rows, k), grouping.components(rows, k).select("read_id", "comp"))]
    assert got == want and want[0]
    assert {r.kmer for r in mixed.collect()} >= {w for w, _ in want[0]}
    assert kmers.submaximal(rows.where("read_id > 5000"), k).count() == 0


def some_reads(spark, k):
    rng = random.Random(k)
    whole = "".join(rng.choice("ACGT") for _ in range(120))
    turned = whole[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = ["", "A", "A" * 60, "AC" * 40, "ACGT" * 20, *((w := rng.choice([whole, turned]))[(at := rng.randrange(80)) : at + rng.randrange(3, 90)] for _ in range(60))]
    return spark.createDataFrame([(3 * i - 9, s) for i, s in enumerate(sorted(set(seqs)))], "read_id long, seq string").repartition(3)


@pytest.mark.parametrize("k", [4, 5, 28, 36])
def test_events_of_chunks_equal_rows(spark, monkeypatch, k):
    rows = some_reads(spark, k)
    monkeypatch.setattr(packed, "CHUNK_LETTERS", 300)
    monkeypatch.setattr(packed, "BUCKET_KEYS", 200)
    got = sorted(map(tuple, grouping._packed_events(grouping._chunks(rows, k), k, True).collect()))
    assert got == sorted(map(tuple, grouping._kmer_events(rows, k, True, False).collect()))
    assert {kind for *_, kind in got} == {"kmer", "both"}


def test_capped_groups_make_no_row_for_an_occurrence(spark, monkeypatch):
    rows = some_reads(spark, 36)
    with monkeypatch.context() as by_rows:
        by_rows.setattr(packed, "LONGEST", 0)
        want = sorted(map(tuple, grouping.capped_groups(rows, 36, 3).collect()))
    monkeypatch.setattr(kmers, "occurrences", None)
    assert sorted(map(tuple, grouping.capped_groups(rows, 36, 3).collect())) == want


def test_few_chunks_send_to_few_buckets(spark, monkeypatch):
    """A chunk of long k-mers has twice the letters, and a bucket twice the k-mers, so a quarter of the rows are sent."""
    rows = spark.createDataFrame([(i, "".join(random.Random(i).choices("ACGT", k=50))) for i in range(200)], "read_id long, seq string").coalesce(1)
    monkeypatch.setattr(packed, "CHUNK_LETTERS", 500)
    monkeypatch.setattr(packed, "BUCKET_KEYS", 625)
    sent, stars = [], packed.checkpoint
    monkeypatch.setattr(packed, "checkpoint", lambda df, *n: sent.append(stars(df, *n)) or sent[-1])
    grouping.star_edges(rows, 36).count()
    assert len(sent) == 2 and sent[0].count() <= 10 and sent[1].count() <= 10 * 8


def test_order_of_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    for spread in (1, 50, 1 << 20):
        low = rng.integers(0, spread, 3000).astype(np.uint64) << np.uint64(40) | rng.integers(0, 3, 3000).astype(np.uint64)
        high = rng.integers(0, 3, 3000).astype(np.uint64)
        assert packed._pair_order(low, high, 61).tolist() == np.lexsort((high, low)).tolist()
    none = np.zeros(0, dtype=np.uint64)
    assert packed._pair_order(none, none, 61).tolist() == []


@pytest.mark.parametrize("far", [20, 28, 29, 45])
def test_letters_between_far_repeats_are_compared(spark, monkeypatch, far):
    """Submaximal repeats come from one entry a chunk and k-mer, also where many letters lie between."""
    rng = random.Random(far)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    one, two, gap = letters(8), letters(8), letters(far - 8)
    seqs = [letters(rng.randrange(5)) + one + (gap if i % 4 else letters(far - 8)) + two + letters(3) for i in range(12)]
    seqs += [letters(4) + two[1:] + letters(far - 7) + one for _ in range(4)]
    rows = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(3)
    monkeypatch.setattr(packed, "CHUNK_LETTERS", 120)
    monkeypatch.setattr(packed, "BUCKET_KEYS", 200)
    with monkeypatch.context() as by_rows:
        by_rows.setattr(packed, "LONGEST", 0)
        want = [sorted(map(tuple, kmers.submaximal(f, 8).collect())) for f in (rows, rows.where("read_id % 4 > 0"))]
    monkeypatch.setattr(packed, "repeats", None)  # no row for an occurrence
    assert [sorted(map(tuple, kmers.submaximal(f, 8).collect())) for f in (rows, rows.where("read_id % 4 > 0"))] == want
    assert want[0] and want[0] != want[1]
