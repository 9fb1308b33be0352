"""The transform from packed words in blocks, against Python and the sort of strings."""

import random
import time

import pytest

from strandloom.operators import bwt, packed, suffixes
from strandloom.sources import readers, writers


def frame(spark, reads):
    return spark.createDataFrame([(7 * i - 5, s) for i, s in enumerate(reads)], "read_id long, seq string")


def some_reads():
    rng = random.Random(4)
    whole = "".join(rng.choice("ACGT") for _ in range(90)) * 3
    long = [whole[(at := rng.randrange(170)) : at + rng.choice([1, 31, 32, 33, 64, 65, 100])] for _ in range(60)]
    return ["", "", "A", "A", "A" * 32, "A" * 33, "A" * 100, "A" * 100, "T" * 64, "T" * 100, *long, None]


def model(reads):
    rows = sorted((s[p:] + "$", 7 * i - 5, s[p - 1] if p else "$") for i, s in enumerate(reads) if s is not None for p in range(len(s) + 1))
    return [(c, i) for _, i, c in rows]


@pytest.mark.parametrize("bucket", [50, 700, 1 << 20])
def test_blocks_equal_sorted_suffixes(spark, monkeypatch, tmp_path, bucket):
    monkeypatch.setattr(packed, "CHUNK_LETTERS", 900)
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    monkeypatch.setattr(suffixes, "BATCH", 64)
    reads = some_reads()
    df, want = frame(spark, reads).repartition(3), model(reads)
    found = bwt.packed_blocks(df)
    assert found.count() == 1 if bucket > 1000 else found.count() >= 3
    got = suffixes.rows_of(found).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(len(want))) and [(r.ch, r.read_id) for r in got] == want
    text = "".join(c for c, _ in want)
    assert all(r["rank"] == text[: r.pos].count(r.ch) == r["rank"] and text[r.pos] == r.ch for r in bwt.ranks_of_reads(df).collect())
    table = got and spark.createDataFrame([(i, c) for i, c in enumerate(text)], "pos long, ch string")
    runs = sorted(tuple(r) for r in bwt.run_lengths(table).collect())
    assert sorted(tuple(r) for r in bwt.runs_of_reads(df).collect()) == runs
    ordered, in_order = bwt.ordered_runs(df)
    writers.index(ordered, str(tmp_path / "index"), in_order)
    assert in_order and sorted(tuple(r) for r in readers.index(spark, str(tmp_path / "index")).collect()) == runs
    for block in (7, 4096):
        assert sorted(map(str, bwt.index_of_reads(df, block).collect())) == sorted(map(str, bwt.searchable(table, block).collect()))


def test_one_repeat_fills_many_buckets(spark, monkeypatch):
    """Equal suffixes are cut by read_id: no bucket grows with a repeat. Few suffixes are sent at a time."""
    monkeypatch.setattr(packed, "CHUNK_LETTERS", 2000)
    monkeypatch.setattr(suffixes, "BUCKET", 500)
    sizes = [r.n for r in bwt.packed_blocks(frame(spark, ["A" * 40] * 300)).collect()]
    assert sum(sizes) == 300 * 41 and max(sizes) < 2000


def test_other_letters_and_long_reads_go_the_other_way(spark):
    for reads in (["ACN"], ["A" * 300]):
        assert bwt.packed_blocks(frame(spark, reads)) is None
        assert "".join(r.ch for r in bwt.transform(frame(spark, reads)).orderBy("pos").collect()) == "".join(c for c, _ in model(reads))


def test_shuffle_files_go_with_their_step(spark):
    """A step that is written leaves no shuffle files behind, and the setting is as before."""
    from strandloom import runtime

    files = lambda: {f.getName() for f in _files(spark) if f.getName().startswith("shuffle_")}
    setting, before = spark.conf.get(runtime.CLEANUP, None), files()
    rows = runtime.checkpoint(spark.range(1000).repartition(3, "id"))
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and rows.count() == 1000 and spark.conf.get(runtime.CLEANUP, None) == setting


def _files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]
