"""Right-maximal strings of every length, against all substrings."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.operators import packed, suffixes, traversal
from strandloom.operators.traversal import common_prefixes, right_maximal_strings


def model(reads):
    suffixes = sorted((s[p:], i) for i, s in enumerate(reads) if s is not None for p in range(len(s) + 1))
    n, following, first = Counter(), defaultdict(set), {}
    for at, (x, i) in enumerate(suffixes):
        for k in range(len(x) + 1):
            n[x[:k]] += 1
            following[x[:k]].add(x[k] if k < len(x) else i)
            first.setdefault(x[:k], at)
    return sorted((w, len(w), first[w], n[w]) for w in n if len(following[w]) > 1)


def frame(spark, reads):
    return spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")


def found(df):
    return sorted((r.word, r.depth, r.pos, r.n) for r in df.collect())


def genome(seed, n, size, lengths, alphabet):
    rng = random.Random(seed)
    whole = "".join(rng.choice(alphabet) for _ in range(size))
    return [(whole[(at := rng.randrange(size)) :] + whole)[: rng.choice(lengths)] for _ in range(n)]


CASES = [
    genome(1, 40, 60, [0, 1, 5, 30, 60], "ACGT"),
    genome(2, 60, 20, [3, 12], "AC") + ["", "", None],
    ["A" * 70] * 3 + ["A" * 69, "CA" * 40, "AC" * 40],  # a third of all suffixes begin with one string
    ["ACGT"],
    ["", ""],
    [""],
    ["A"],
    ["NNA", "NNC", "NNA"],
]


@pytest.mark.parametrize("parts", [1, 4, 40])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_equal_to_all_substrings(spark, case, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert found(right_maximal_strings(frame(spark, CASES[case]))) == model(CASES[case])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_more_columns_and_no_reads(spark):
    reads = frame(spark, ["ACAC", "CACG"])
    named = reads.selectExpr("*", "1 AS p", "'x' AS suffix", "2 AS part", "'y' AS word")
    assert found(right_maximal_strings(named)) == model(["ACAC", "CACG"])
    assert right_maximal_strings(reads.where("read_id < 0")).count() == 0


def test_common_prefixes_in_slices(monkeypatch):
    words = sorted(x.encode() for x in genome(3, 50, 30, [0, 2, 9, 25], "AC"))
    want = [next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(words, words[1:])]
    for cells in (1, 60, 1 << 24):
        monkeypatch.setattr(traversal, "CELLS", cells)
        assert common_prefixes(words).tolist() == want
    assert common_prefixes([b""]).tolist() == []


@pytest.mark.parametrize("case", [0, 1, 2])
def test_rounds_of_sorting_find_the_same(spark, monkeypatch, case):
    monkeypatch.setattr(traversal, "PHASE_SUFFIXES", 20)
    written, paths = traversal.written, []
    monkeypatch.setattr(traversal, "written", lambda df, path: paths.append(path) or written(df, path))
    assert found(right_maximal_strings(frame(spark, CASES[case]))) == model(CASES[case])
    assert len(paths) > 1  # only a part of the suffixes is sent at a time


@pytest.mark.parametrize("bucket", [20, 300, 1 << 20])
@pytest.mark.parametrize("case", [0, 1, 2, 3, 4, 5, 6])
def test_packed_words_find_the_same(spark, monkeypatch, case, bucket):
    monkeypatch.setattr(traversal, "PACKED", 0)
    monkeypatch.setattr(packed, "CHUNK_LETTERS", 200)
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    monkeypatch.setattr(traversal, "_ranges_found", None)  # no suffix is sorted as a string
    assert found(right_maximal_strings(frame(spark, CASES[case]).repartition(3))) == model(CASES[case])


def test_order_of_packed_suffixes(monkeypatch):
    """Ties of the leading bits go by the next ones, by the ends of suffixes and at last by place."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2, (4000, 96)).astype(np.uint8)
    codes[:, 20:] = 0  # long ties
    codes[:2000, 90] = rng.integers(0, 4, 2000)
    size = rng.choice([3, 19, 40, 91, 96], 4000).astype(np.uint8)
    codes[np.arange(96) >= size[:, None]] = 0
    words = [sum(codes[:, 32 * j + i].astype(np.uint64) << np.uint64(62 - 2 * i) for i in range(32)) for j in range(3)]
    assert suffixes._order(words, size).tolist() == np.lexsort([size, *words[::-1]]).tolist()
