"""One row that a third of a table repeats: put together before batches are dealt, and all its repeats come back."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.llm import hashcount, jaccard, repeats
from test_operators import brute_components, prose, rows_of

MANY = 3000


@pytest.fixture(scope="module")
def items():
    hot = prose(70, 900)
    return [(7, hot)] * MANY + [(None, None)] * MANY + [(None, hot)] * 50 + [(100 + i, prose(60, 901 + i)) for i in range(40)] + [(8, hot + " end"), (9, "solo"), (9, "solo"), (10, "")]


@pytest.fixture(scope="module")
def table(spark, items):
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(6)
    return df.withColumns({"copies": F.lit(5), "count_all": F.lit("x"), "batch": F.lit(None)})


def test_few_rows_travel(spark, table, items):
    rows, size = hashcount.batched(table.select("doc_id", "text"), ["doc_id"])
    found = rows.groupBy("doc_id", "text").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("sent"), F.countDistinct("batch").alias("batches")).collect()
    assert {(r.doc_id, r.text): r.n for r in found} == Counter(items)
    assert max(r.sent for r in found) <= 6 and max(r.batches for r in found) == 1
    assert size == sum(len((t or "").encode()) for _, t in items)


def test_jaccard(table, items):
    some = Counter(items)
    once = [x for x in items if some[x] == 1] + [x for x, n in some.items() if n > 1 for _ in range(2)]
    want = {r: 0 for r in brute_components(once, 4, 85)}
    got = Counter(rows_of(jaccard.jaccard_components(table)))
    assert set(got) == set(want) and sum(got.values()) == len(items)
    assert got[7, 67, 7] == MANY and got[None, 67, 7] == 50 and got[8, 68, 7] == 1 and got[None, 0, None] == MANY


@pytest.mark.parametrize("repeats_stay", [True, False])
def test_keep_one(table, items, repeats_stay):
    got = Counter(tuple(r) for r in jaccard.keep_one(table, keep_repeats=repeats_stay).select("doc_id", "text").collect())
    hot = items[0][1]
    assert got[7, hot] == (MANY if repeats_stay else 1) and got[None, None] == MANY
    assert (None, hot) not in got and (8, hot + " end") not in got and got[9, "solo"] == (2 if repeats_stay else 1)


def test_substrings(table, items):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(table).collect())
    hot = items[0][1]
    assert got[7, 70, 70, ""] == MANY and got[None, 70, 70, ""] == 50 and got[8, 71, 70, "end"] == 1
    assert got[None, 0, 0, ""] == MANY and got[9, 1, 0, "solo"] == 2 and sum(got.values()) == len(items)
    assert not any(hot in k[3] for k in got)


def test_a_repeated_row_is_found_elsewhere_however_it_arrives(spark):
    text = prose(50, 7)
    for parts in (1, 2):  # both in one Arrow batch, or in one each
        df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string").repartition(parts)
        assert [(r.n_removed, r.kept_text) for r in repeats.remove_repeats(df).collect()] == [(50, "")] * 2
