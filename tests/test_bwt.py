"""Suffix order by doubling, run lengths over borders, and search in the index, against Python."""

import random

import pytest

from strandloom.operators import bwt


def genome(n, size, seed, alphabet="ACGT"):
    rng = random.Random(seed)
    whole = "".join(rng.choice(alphabet) for _ in range(size))
    out = set()
    for _ in range(n):
        at, length = rng.randrange(size), rng.choice([0, 1, 5, 30, 100, 180])
        out.add((whole[at:] + whole)[:length])
    return sorted(out | {"A" * 200, "A" * 199, "AC" * 90, "CA" * 90})


def frame(spark, reads):
    return spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")


def model(reads):
    return [(x[2], x[1]) for x in sorted((s[p:] + "$", i, s[p - 1] if p else "$") for i, s in enumerate(reads) for p in range(len(s) + 1))]


@pytest.mark.parametrize("alphabet", ["ACGT", "AC", "ACGNT"])
def test_doubling_orders_long_repeats(spark, alphabet, monkeypatch):
    monkeypatch.setattr(bwt, "SHORT", 10)
    reads = genome(40, 250, 1, alphabet)
    got = [(r.ch, r.read_id) for r in bwt.transform(frame(spark, reads)).orderBy("pos").collect()]
    assert got == model(reads)


def test_runs_over_borders_and_ranks(spark):
    rows = [(i, c) for i, c in enumerate("A" * 50 + "C" + "A" * 3 + "$" * 40 + "GT" * 20 + "T" * 60)]
    table = spark.createDataFrame(rows, "pos long, ch string").repartition(5)
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(tuple(r) for r in bwt.run_lengths(table).collect())
        assert [(s, c, k) for s, c, k in got] == [(0, "A", 50), (50, "C", 1), (51, "A", 3), (54, "$", 40), *((94 + i, "GT"[i % 2], 1) for i in range(39)), (133, "T", 61)]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    text = "".join(c for _, c in rows)
    assert all(r["rank"] == text[: r.pos].count(r.ch) for r in bwt.rank_before(table, block=7).collect())
    none = table.where("pos < 0")
    assert bwt.run_lengths(none).count() == 0 and bwt.rank_before(none).count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_search_counts_substrings(spark, block):
    reads = [s[:100] for s in genome(25, 200, 2)]
    want = model(reads)
    patterns = ["A", "AC", "ACG", "", "TTTTTT", "AXA", "$", *(s[3:9] for s in reads if len(s) > 30)]
    index = bwt.searchable(bwt.transform(frame(spark, reads)), block)
    got = {r.pattern: (r.low, r.high) for r in bwt.find_patterns(index, spark.createDataFrame([(p,) for p in [*patterns, None, "A"]], "pattern string"), block).collect()}
    suffixes = sorted(s[p:] + "$" for s in reads for p in range(len(s) + 1))
    assert len(got) == len(set(patterns)) and len(suffixes) == len(want)
    for p, (low, high) in got.items():
        inside = [i for i, x in enumerate(suffixes) if x[:-1].startswith(p)]
        assert (low, high) == ((inside[0], inside[-1] + 1) if inside else (0, 0)), p


def test_no_reads(spark):
    none = frame(spark, ["A"]).where("read_id < 0")
    assert bwt.transform(none).count() == 0
    index = bwt.searchable(bwt.transform(none))
    assert [tuple(r) for r in bwt.find_patterns(index, spark.createDataFrame([("A",)], "pattern string")).collect()] == [("A", 0, 0)]


@pytest.mark.parametrize("block", [5, 4096])
def test_insert_equals_the_transform_of_both(spark, block):
    reads = [s[:14] for s in genome(30, 60, 5, "ACN")] + ["", "A", "A", "AAAA"]
    df = frame(spark, reads)
    old, new = df.where("read_id < 14"), df.where("read_id >= 14")
    got = bwt.insert(bwt.transform(old).select("pos", "ch"), new, block).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(len(got))) and "".join(r.ch for r in got) == "".join(c for c, _ in model(reads))


def test_insert_of_and_into_nothing(spark):
    df = frame(spark, ["ACG", "AC"])
    none = df.where("read_id < 0")
    want = "".join(c for c, _ in model(["ACG", "AC"]))
    for old, new in ((none, df), (df, none)):
        assert "".join(r.ch for r in bwt.insert(bwt.transform(old), new).orderBy("pos").collect()) == want
    with pytest.raises(Exception, match="does not know"):
        bwt.insert(bwt.transform(df), frame(spark, ["AXA"])).count()
