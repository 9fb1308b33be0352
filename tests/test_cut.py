"""Texts cut into reads, many in one batch, against a plain reading of each."""

import pytest

from strandloom.sources import readers

BASES = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"))


@pytest.mark.parametrize("rest", [False, True])
def test_cut_equals_plain_reading(spark, rest):
    texts = ["", "ab cd-efg", None, "x", "hijklmnopqrst", "...", "uvwxyzabcd", "abc", "The quick brown fox, 17 times", "ä"]
    docs = [(i + j, t) for j in (0, 11) for i, t in enumerate(texts)]
    want = []
    for d, t in docs:
        q = "".join(BASES[c.upper()] for c in t or "" if c.isascii() and c.isalpha())
        q = q[::-1].translate(str.maketrans("ACGT", "TGCA")) if d % 2 else q
        want += [(d, i // 5, q[i : i + 5]) for i in range(0, len(q), 5) if rest or len(q) - i >= 5]
    got = readers.reads_of_texts(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 5, rest=rest)
    assert sorted(map(tuple, got.collect())) == sorted(want)
