"""k-mers as numbers against rows, over many small chunks and buckets."""

import random

import pytest

from strandloom.functions import seq as S
from strandloom.operators import filtering, grouping, packed
from strandloom.operators import kmers as K


@pytest.fixture
def reads(spark, monkeypatch):
    monkeypatch.setattr(packed, "BUCKET_KEYS", 100)
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(150)) + "ACGTACGTACGT" + "A" * 40
    seqs = sorted({genome[i : i + rng.randrange(1, 60)] for i in (rng.randrange(200) for _ in range(80))} | {"ACGNACGNACGA", "TTACGNACG", "A"})
    return spark.createDataFrame([(7 * i, s) for i, s in enumerate(seqs)], "read_id long, seq string").repartition(6)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k", [3, 16, 28])
def test_numbers_equal_rows(reads, monkeypatch, k):
    of = [K.counts, K.canonical_counts, K.neighbourhoods, K.right_maximal, K.left_maximal, K.right_maximal_both, K.right_maximal_canonical, K.strand_pairs]
    filters = [lambda r, k, f=f, t=t: f(r, k, t) for f in (filtering.frequent_forward, filtering.frequent_both) for t in (2, 4)]
    plain = reads.where("seq NOT LIKE '%N%'")
    got = [rows(f(plain, k)) for f in of + filters]
    monkeypatch.setattr(packed, "MOST", 0)
    assert got == [rows(f(plain, k)) for f in of + filters]


@pytest.mark.parametrize("k", [3, 4])
def test_other_letters_are_kept(reads, monkeypatch, k):
    of = [K.counts, K.canonical_counts, lambda r, k: filtering.frequent_forward(r, k, 3)]
    got = [rows(f(reads, k)) for f in of]
    monkeypatch.setattr(packed, "MOST", 0)
    assert got == [rows(f(reads, k)) for f in of]


def test_a_chunk_sends_a_kmer_once(spark):
    """A k-mer in every read is an entry a chunk, not a row an occurrence."""
    many = spark.createDataFrame([("ACGTACGTAC" * 10,)] * 500, "seq string").coalesce(1)
    sent, _ = packed._sent(packed.chunked(many), 16, False, True)
    assert sum(r.n for r in sent.collect()) == 10


def test_windows_begin_with_every_short_kmer(spark):
    found = K.windows(spark.createDataFrame([("ACGTT",), ("",), ("C",)], "seq string"), 3)
    assert sorted(r.m for r in found.collect()) == ["ACG", "C", "CGT", "GTT", "T", "TT"]


def test_turned_and_unmixed(spark):
    codes = packed._CODE[list(b"ACGTTGCATTACGGATCAACGTAGGTACT")]
    for k in (1, 2, 7, 16, 28):
        own, back = packed.numbers(codes, k, True)
        assert (packed.turn(own, k) == back).all() and (packed.unmixed(packed.mixed(own, k), k) == own).all()
        words = packed.strings(own, k).to_pylist()
        assert words[0] == "ACGTTGCATTACGGATCAACGTAGGTACT"[:k]
        assert packed.strings(back, k).to_pylist() == [r.x for r in spark.createDataFrame([(w,) for w in words], "w string").select(S.reverse_complement("w").alias("x")).collect()]


@pytest.mark.parametrize(("k", "both"), [(6, True), (28, False), (36, False), (36, True), (45, True)])
def test_stars_equal_rows(reads, monkeypatch, k, both):
    got = rows(grouping.star_edges(reads, k, both))
    monkeypatch.setattr(packed, "LONGEST", 0)
    assert got == rows(grouping.star_edges(reads, k, both)) and got


def row_of(seqs):
    codes = packed.CODE[list("".join(seqs).encode())]
    return {"reads": len(seqs), "n": len(codes), "letters": packed.pack(codes), "sizes": packed.pack(packed.np.array([len(x) for x in seqs], dtype=packed.np.uint32)), "part": 0}


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("k", [1, 3, 16, 26])
@pytest.mark.parametrize("strands", [False, True])
def test_large_chunks_in_pieces(monkeypatch, k, strands):
    """Places and sorted values worked on by pieces that cut reads and buckets anywhere, and added up over two chunks, against plain counting."""
    monkeypatch.setattr(packed, "PIECE", 7)
    rng = random.Random(k)
    genome = "".join(rng.choice("ACGT") for _ in range(60)) + "ACGTACGTACGT" + "A" * 30
    halves = [["", *(genome[i : i + rng.randrange(0, 40)] for i in (rng.randrange(100) for _ in range(30))), "ACGNACGNACGA", "A"] for _ in range(2)]
    want = {}
    for s in halves[0] + halves[1]:
        for p in range(len(s) - k + 1):
            w, after, before = s[p : p + k], "$ACGTN".index(s[p + k] if p + k < len(s) else "$"), "$ACGTN".index(s[p - 1] if p else "$")
            if "N" in w:
                continue
            other = strands and turned(w) < w
            n = want.setdefault(turned(w) if other else w, [0, 0, 0, 0])
            before = (0, 4, 3, 2, 1, 5)[before] if strands else before
            n[other] += 1
            n[2] |= 1 << (before if other else after)
            n[3] |= 1 << (after if other else before)
    for masks in (False, True):
        bits = min(3, 2 * k)
        sent = [packed._blobs(packed._Chunk(row_of(h), k, strands).values(masks), k, bits, strands, masks) for h in halves]
        got = {}
        for bucket in range(1 << bits):
            rows = [(x["n"][i], x["blob"][i]) for x in sent for i, b in enumerate(x["bucket"]) if b == bucket]
            if rows:
                group = packed.pa.table({"bucket": [bucket] * len(rows), "n": [n for n, _ in rows], "blob": packed.pa.array([b for _, b in rows], packed.pa.binary())})
                _, _, _, number, *more = packed._added(group, k, bits, strands, masks)
                got |= dict(zip(packed.strings(number, k).to_pylist(), map(list, zip(*(x.tolist() for x in more)))))
        assert got == {w: n if masks else [*n[:2], 0, 0] for w, n in want.items()}
    chunk = packed._Chunk(row_of(halves[0]), k, strands)
    words = packed._heads(chunk.values(False) >> packed.U64(7))
    keys = (chunk.values(False) >> packed.U64(7))[words]
    flags = packed.np.arange(len(keys)) % 3 == 0
    flagged = set(packed.strings(packed.unmixed(keys[flags], k), k).to_pylist())
    holds = [any(w in flagged or (strands and turned(w) in flagged) for w in (s[p : p + k] for p in range(len(s) - k + 1))) for s in halves[0]]
    assert chunk.holding(flags).tolist() == [i for i, x in enumerate(holds) if x]


def test_holding_without_room_for_reads_in_the_number():
    """28 letters and the number of one of 300 reads have more than 64 bits."""
    rng = random.Random(7)
    seqs = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(300)]
    chunk = packed._Chunk(row_of(seqs), 28, False)
    value = chunk.values(False) >> packed.U64(7)
    flags = value == packed.mixed(packed.numbers(packed.CODE[list(seqs[123].encode())], 28, False)[0], 28)[1]
    assert chunk.holding(flags).tolist() == [123]


def test_rows_sent_do_not_grow_with_the_square(spark, monkeypatch):
    """Four chunks of the usual size are one chunk of a tally, and its buckets are twice as large."""
    batch = packed.pa.record_batch({"seq": ["ACGTACGTAC" * 10] * 160})
    monkeypatch.setattr(packed, "CHUNK_LETTERS", 1000)
    assert [len(list(packed._pieces(iter([batch]), times=t))) for t in (1, packed.CHUNK_TIMES)] == [16, 4]
    monkeypatch.setattr(packed, "BUCKET_KEYS", 250)
    chunks = packed.chunked(spark.createDataFrame([("ACGTTGCAAC" * 10,)] * 160, "seq string").coalesce(1), times=packed.CHUNK_TIMES)
    assert packed._sent(chunks, 16, False, False)[1] == 5


@pytest.mark.parametrize(("k", "fan"), [(3, 1), (16, 1), (16, 3), (28, 2)])
def test_more_buckets_than_a_chunk_sends_to(reads, monkeypatch, k, fan):
    """Units of a bucket are added up and sent on to its parts, in up to four steps; filters are answered the same way back."""
    of = [K.canonical_counts, K.neighbourhoods, K.right_maximal, K.left_maximal, K.strand_pairs, lambda r, k: filtering.frequent_forward(r, k, 2), lambda r, k: filtering.frequent_both(r, k, 2)]
    monkeypatch.setattr(packed, "CHUNK_LETTERS", 20)
    monkeypatch.setattr(packed, "FAN_BITS", fan)
    plain = reads.where("seq NOT LIKE '%N%'")
    chunks = packed.chunked(plain, "read_id", times=packed.CHUNK_TIMES)
    sent, bits = packed._sent(chunks, k, False, True)
    assert bits == fan < packed._goal(chunks, k) and sent.count() <= chunks.rows.count() << fan
    got = [rows(f(plain, k)) for f in of]
    monkeypatch.setattr(packed, "MOST", 0)
    assert got == [rows(f(plain, k)) for f in of]


def test_counts_of_units_have_room():
    """What units send on may be more than 32 bits hold."""
    kinds = packed._kinds(16, 3, True, False, wide=True)
    key, n = packed.np.array([1 << 28, 5 << 28], dtype=packed.U64), packed.np.array([1 << 33, 7])
    buckets, sizes, blobs = zip(*packed._rows(key, [n, n + 1], kinds, 0, 8, packed.U64(29)))
    assert (buckets, sizes) == ((0, 2), (1, 1))
    group = packed.pa.table({"bucket": [0, 0], "n": [1, 1], "blob": packed.pa.array([blobs[0]] * 2, packed.pa.binary())})
    assert [x.tolist() for x in packed._added(group, 16, 3, True, False, wide=True)[4:6]] == [[1 << 34], [(1 << 34) + 2]]


def test_letters_and_planes_come_back():
    rng = packed.np.random.default_rng(6)
    for k in (1, 8, 15, 16, 28, 32):
        x = rng.integers(0, 1 << 2 * k, 50, dtype=packed.np.uint64)
        assert packed.strings(x, k).to_pylist() == ["".join("ACGT"[v >> 2 * (k - 1 - j) & 3] for j in range(k)) for v in x.tolist()]
    arrays = [packed.np.array(v, t) for v, t in (([0, 1 << 40, 7], "<u8"), ([-5, 3, -(1 << 50)], "<i8"), ([1, 1 << 24, 2], "<u4"), ([9, 0, 255], "u1"))]
    back = packed.unpack(packed.pack(*arrays), 3, "<u8", "<i8", "<u4", "u1")
    assert [x.tolist() for x in back] == [x.tolist() for x in arrays]


def test_turned_forms_are_made_with_the_numbers(reads):
    """rc comes with a tally's rows, and from rows where a k-mer holds another letter; the plan turns no string for plain reads."""
    plain = reads.where("seq NOT LIKE '%N%'")
    for source in (plain, reads):
        found = K.strand_pairs(source, 4, turned=True)
        assert [r for r in found.select("kmer", "rc").collect() if r.rc != turned(r.kmer)] == []
    assert "translate" not in grouping.strand_kmer_pairs(plain, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in K.right_maximal_both(plain, 4)._jdf.queryExecution().optimizedPlan().toString()
