"""The data source of sequence files, cut into ranges of any size, against the records that were written."""

import gzip
import os
import random
import struct
import zlib

import pytest

from strandloom.sources import datasource, readers


@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark


def blocks(data, size):
    """``data`` as gzip blocks that state their sizes, with the empty block that ends such files."""
    out = b""
    for piece in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(piece) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(piece), len(piece))
    return out


def records(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 5, 40, 120])))
        # qualities begin with the marks of headers and separators
        out.append((f"r{i} @+>", seq, "".join(rng.choice("@+>I#") for _ in seq)))
    return out


def fastq_bytes(rows, end="\n"):
    return "".join(f"@{h}{end}{s}{end}+{end}{q}{end}" for h, s, q in rows).encode()


def fasta_bytes(rows, width, end="\n"):
    return "".join(f">{h}{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for h, s, _ in rows).encode()


def load(spark, path, **options):
    rows = spark.read.format("sequences").options(**options).load(str(path)).collect()
    return [(r.header, r.seq, r.qual) for r in sorted(rows, key=lambda r: (r.file, r.part, r.at))]


@pytest.mark.parametrize("split", [1000, 50_000, 1 << 20])
@pytest.mark.parametrize("packing", ["plain", "blocks", "gzip", "crlf"])
def test_ranges_of_any_size_give_each_record_once(source, tmp_path, split, packing):
    rows = records(300, split)
    end = "\r\n" if packing == "crlf" else "\n"
    packed = {"blocks": lambda b: blocks(b, 700), "gzip": gzip.compress}.get(packing, lambda b: b)
    (tmp_path / "a.fq").write_bytes(packed(fastq_bytes(rows, end)))
    (tmp_path / "a.fa").write_bytes(packed(fasta_bytes(rows, 50, end)))
    assert load(source, tmp_path / "a.fq", split_bytes=split) == rows
    assert load(source, tmp_path / "a.fa", split_bytes=split) == [(h, s, None) for h, s, _ in rows]


@pytest.mark.parametrize("form", ["fastq", "fasta"])
def test_every_cut_of_a_small_file(form):
    """All range sizes, down to single bytes, without a session."""
    rows = records(12, 3)
    data = fastq_bytes(rows) if form == "fastq" else fasta_bytes(rows, 7)
    want = [(h, s, q if form == "fastq" else None) for h, s, q in rows]
    path = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"strandloom-cuts-{os.getpid()}-{form}")
    for packed, sizes in ((data, [1, 2, 3, 7, 10, 41, 100, 333, len(data), len(data) + 9]), (blocks(data, 30), [1, 9, 40, 57, 200, 100_000])):
        with open(path, "wb") as f:
            f.write(packed)
        for size in sizes:
            reader = datasource.SequenceReader({"path": path, "split_bytes": str(size)})
            got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.select(["header", "seq", "qual"]).to_pylist()]
            assert got == want, size
    os.remove(path)


def test_same_records_as_the_line_reader(source, tmp_path):
    rows = records(200, 9)
    (tmp_path / "a.fq").write_bytes(fastq_bytes(rows))
    want = [(r.header, r.seq, r.qual) for r in readers.fastq(source, str(tmp_path / "a.fq")).orderBy("record_no").collect()]
    assert load(source, tmp_path / "a.fq", split_bytes=3000) == want
    numbered = readers.sequences(source, str(tmp_path / "a.fq"), split_bytes=3000).orderBy("record_no").collect()
    assert [(r.record_no, r.header, r.seq, r.qual) for r in numbered] == [(i, *r) for i, r in enumerate(want)]


def test_odd_files(source, tmp_path):
    (tmp_path / "none").mkdir()
    assert load(source, tmp_path / "none") == []
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a").write_bytes(b"")
    (folder / "b").write_bytes(b"\n\n@x\nAC\n+\nII\n\n@y\nG")
    (folder / "_c").write_bytes(b">no\nA\n")
    (folder / "d").write_bytes(b"; before\n>\n>only header\n>z\nAC\n\nGT")
    (folder / "e.gz").write_bytes(gzip.compress(b">m1\nA\n") + gzip.compress(b">m2\nC\n"))
    assert load(source, folder) == [("x", "AC", "II"), ("y", "G", None), ("", "", None), ("only header", "", None), ("z", "ACGT", None), ("m1", "A", None), ("m2", "C", None)]
    assert load(source, f"file://{folder}/e.gz") == [("m1", "A", None), ("m2", "C", None)]
    (tmp_path / "bad").write_bytes(b"@x\nAC\n+\nII\nAC\n")
    with pytest.raises(Exception, match="without @"):
        load(source, tmp_path / "bad")
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b">m1\nA\n" * 99)[:-9])
    with pytest.raises(Exception, match="inside of a gzip member"):
        load(source, tmp_path / "cut.gz")


@pytest.mark.parametrize("form", ["fasta", "fastq"])
def test_write_and_read_back(source, tmp_path, form):
    rows = records(100, 4)
    df = source.createDataFrame([(i, *r) for i, r in enumerate(rows)], "extra int, header string, seq string, qual string").repartitionByRange(3, "extra").sortWithinPartitions("extra")
    out = tmp_path / "out"
    df.write.format("sequences").option("format", form).mode("append").save(str(out))
    assert load(source, out) == [(h, s, q if form == "fastq" else None) for h, s, q in rows]
    assert sorted(x.name for x in out.iterdir()) == [f"part-{i:05d}.{form}" for i in range(3)]
    with pytest.raises(Exception, match="FileExistsError"):
        df.write.format("sequences").option("format", form).mode("append").save(str(out))
    df.limit(5).write.format("sequences").option("format", form).mode("overwrite").save(str(out))
    assert len(load(source, out)) == 5
    with pytest.raises(Exception, match="needs the columns"):
        df.select("header").write.format("sequences").mode("append").save(str(tmp_path / "other"))


def test_what_failed_attempts_left_is_not_there(source, tmp_path):
    """Two attempts of a task have written; only the one that is committed counts, and a failed job leaves no file."""
    writer = datasource.SequenceWriter({"path": str(tmp_path / "w")}, ["header", "seq"], False)

    def attempt(name):
        file = tmp_path / "w" / writer.work / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(">x\nA\n")
        return datasource.Written(0, str(file))

    attempt("00000-lost")
    writer.commit([attempt("00000-kept"), None])
    assert [x.name for x in (tmp_path / "w").iterdir()] == ["part-00000.fasta"]
    bad = source.range(4).selectExpr("CAST(id AS string) AS header", "IF(id = 3, raise_error('lost'), 'A') AS seq").repartition(2)
    with pytest.raises(Exception):
        bad.write.format("sequences").mode("append").save(str(tmp_path / "v"))
    assert not (tmp_path / "v").exists() or list((tmp_path / "v").iterdir()) == []
