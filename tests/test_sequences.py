"""Sequence operators on hand-worked reads, and against plain models."""

import gzip
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import bwt, components, filtering, grouping, kmeans, profiles
from strandloom.operators import kmers as K
from strandloom.operators import reads as R
from strandloom.operators.components import connected_components
from strandloom.operators.order import with_position
from strandloom.plans import catalog, pipeline
from strandloom.plans.config import Config, command_line, read_config
from strandloom.sources import readers, writers
from strandloom.streaming.counts import streaming_counts

FASTA = ">r0\nACGTACGTAA\n>r1\nacgtacg\ngtt\n>r2\nACGTNACGTA\n>r3\nACGTACGTAA\n>r4\nTTACGTACGT\n>r5\nGGGGCCCCAA"
UNIQUE = ["ACGTACGGTT", "ACGTACGTAA", "GGGGCCCCAA", "TTACGTACGT"]


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "reads.fasta"
    path.write_text(FASTA)
    return str(path)


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame(list(enumerate(UNIQUE)), "read_id long, seq string").cache()


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_fasta_keeps_valid_reads(spark, fasta):
    rows = readers.fasta(spark, fasta).orderBy("record_no").collect()
    assert [r.header for r in rows] == ["r0", "r1", "r3", "r4", "r5"]
    assert rows[1].seq == "ACGTACGGTT"
    assert readers.fasta(spark, fasta, validate=False).count() == 6


def test_gzip_fastq_and_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(FASTA)
    assert readers.fasta(spark, str(tmp_path / "a.fa.gz")).count() == 5
    (tmp_path / "a.fq").write_text("@x\nACGT\n+\nI!II\n@y\nGG\n+y\nII\n")
    q = readers.fastq(spark, str(tmp_path / "a.fq"))
    assert [(r.header, r.seq) for r in q.orderBy("record_no").collect()] == [("x", "ACGT"), ("y", "GG")]
    assert [r.m for r in q.orderBy("record_no").select(S.mask_low_quality("seq", "qual", 20).alias("m")).collect()] == ["ANGT", "GG"]
    assert [r.header for r in readers.fastq_to_fasta(spark, str(tmp_path / "a.fq")).collect()] == ["0", "1"]
    (tmp_path / "a.txt").write_text("ACGT 1\n\nGG\n")
    assert pairs(readers.lines(spark, str(tmp_path / "a.txt")).select("seq")) == {("ACGT",), ("GG",)}


def test_pairs_and_duplicates(spark, fasta):
    raw = with_position(readers.fasta(spark, fasta, validate=False), "record", "record_no").withColumn("seq", S.clean("seq"))
    valid = with_position(raw.where(S.is_valid("seq")), "valid_rank", "record")
    records = raw.join(valid.select("record", "valid_rank"), "record", "left").withColumnRenamed("record", "n")
    mates = R.consecutive_pairs(records, "n")
    assert pairs(mates) == {(0, 1), (3, 4)}
    ids = R.with_read_ids(R.dedupe(valid, "valid_rank"))
    assert [(r.read_id, r.seq, r.valid_rank) for r in ids.orderBy("read_id").collect()] == [(0, UNIQUE[0], 1), (1, UNIQUE[1], 2), (2, UNIQUE[2], 4), (3, UNIQUE[3], 3)]
    assert pairs(R.remap_pairs(mates, ids, "valid_rank", "read_id")) == {(3, 2)}


@pytest.fixture
def many_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_fasta_in_many_parts(spark, tmp_path, many_splits):
    rng = random.Random(11)
    text, want, n = "\n\n", [], 0
    for i in range(300):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 7, 40, 61, 150])))
        if rng.random() < 0.1:
            seq += "N"
        text += f">r{i} a>b{chr(13) * (i % 3 == 0)}\n" + "".join(f"{seq[k:k + 60].lower()}{chr(13) * (i % 3 == 0)}\n" for k in range(0, len(seq), 60)) + "\n" * (i % 5 == 0)
        if seq:
            if "N" not in seq:
                want.append((n, f"r{i} a>b", seq))
            n += 1
    (tmp_path / "x.fa").write_bytes(text.encode())
    rows = readers.fasta(spark, str(tmp_path / "x.fa"))
    assert spark.read.text(str(tmp_path / "x.fa")).rdd.getNumPartitions() > 20
    assert [tuple(r) for r in rows.orderBy("record_no").collect()] == want
    assert readers.fasta(spark, str(tmp_path / "x.fa"), validate=False).count() == 300


def mates_by_hand(records):
    """Mates by a walk over the records, as a stream would give them."""
    out, valid, parsed, good_before = set(), 0, 0, False
    for seq in records:
        good = bool(seq) and set(seq) <= set("ACGT")
        parsed += bool(seq)
        if good:
            valid += 1
            if parsed % 2 == 0 and good_before:
                out.add((valid - 2, valid - 1))
        good_before = good
    return out


def test_mates_of_a_file_in_many_parts(spark, tmp_path, many_splits):
    rng = random.Random(12)
    records = [rng.choice(["", "N", "ACGTN", *["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(6)]]) for _ in range(400)]
    records += ["ACGTACGT"] * (sum(map(bool, records)) % 2)
    (tmp_path / "m.fa").write_text("".join(f">r{i}\n{s}\n" if s else f">r{i}\n" for i, s in enumerate(records)))
    raw = readers.fasta(spark, str(tmp_path / "m.fa"), places=True)
    ranked = with_position(raw, "orig_rank", "record_no")
    assert pairs(R.consecutive_pairs(ranked, "record_no", "orig_rank", "place")) == mates_by_hand(records)


def test_pipeline_joins_mates(spark, fasta, tmp_path, monkeypatch):
    seen = {}
    real = pipeline.grouping.capped_groups
    monkeypatch.setattr(pipeline.grouping, "capped_groups", lambda kept, *a, mates=None, **k: seen.update(mates=pairs(mates)) or real(kept, *a, mates=mates, **k))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    c = Config(input_reads=fasta, paired_ends=True, read_filtering_k=4, read_filtering_threshold=2, preclustering_k=8, precluster_min_size=1, kmeans_number_of_clusters=1, filtering_good_out=good, filtering_bad_out=bad)
    final, stats = pipeline.timed_run(spark, c)
    assert seen["mates"] == {(3, 2)} and final.count() == stats["sequences"] == 4 and stats["seconds"] > 0 and stats["driver_mb"] > 0
    assert spark.read.text(good).where("value <> '>'").count() == 4 and spark.read.text(bad).count() == 0
    (tmp_path / "odd.fa").write_text(">a\nACGT\n")
    with pytest.raises(ValueError, match="odd"):
        pipeline.run(spark, Config(input_reads=str(tmp_path / "odd.fa"), paired_ends=True))


def test_clusters_keep_their_order(spark, tmp_path, many_splits):
    rng = random.Random(14)
    text, want, cluster = ">before\nAC\n", [], -1
    for i in range(200):
        mark = i == 0 or rng.random() < 0.1
        if mark:
            cluster, k = cluster + 1, 0
        seq = "".join(rng.choice("ACGT") for _ in range(20))
        text += f">{'cluster_start' + 'x' * (i % 2) if mark else ''}\n{seq}\n"
        want.append((cluster, k, seq))
        k += 1
    (tmp_path / "c.fa").write_text(text)
    assert [tuple(r) for r in readers.clusters(spark, str(tmp_path / "c.fa")).orderBy("cluster_id", "seq_no").collect()] == want
    assert readers.clusters(spark, str(tmp_path / "c.fa"), exact=True).select("cluster_id").distinct().count() == text.count(">cluster_start\n")


def test_submaximal_equals_a_walk(spark):
    rng = random.Random(15)
    genome = "".join(rng.choice("ACGT") for _ in range(60))
    seqs = sorted({genome[i : i + rng.randrange(12, 30)] for i in [rng.randrange(40) for _ in range(40)]} | {"".join(rng.choice("AC") for _ in range(15)) for _ in range(10)})
    rows = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")

    def places(x):
        return [(s, p) for s in seqs for p in range(len(s) - len(x) + 1) if s.startswith(x, p)]

    def right_maximal(x):
        after = [s[p + len(x) : p + len(x) + 1] or "$" for s, p in places(x)]
        return len(after) > 1 and (len(set(after)) > 1 or "$" in after)

    for k in (4, 6):
        marked = {x for s in seqs for x in (s[p : p + k] for p in range(len(s) - k + 1)) if right_maximal(x)}
        keep = set()
        for w in marked:
            x, covered = w, False
            while not covered:
                before = {s[p - 1] if p else "$" for s, p in places(x)}
                if len(before) > 1 or "$" in before:  # left-maximal, or at the reads' starts
                    break
                x = before.pop() + x
                covered = x[:k] in marked
            if not covered:
                keep.add((w, len(places(w))))
        assert pairs(K.submaximal(rows, k)) == keep and len(keep) < len(marked)
        assert pairs(grouping.submaximal_components(rows, k)) == pairs(grouping.components(rows, k))
    assert groups_of(grouping.capped_groups(rows, 6, 1000, both_strands=False, submaximal=True), "group_id") == groups_of(grouping.components(rows, 6), "comp")
    with pytest.raises(ValueError, match="both strands"):
        grouping.capped_groups(rows, 6, 1000, submaximal=True)


def capped_by_hand(seqs, k, most, fragment):
    """The capped union over all reads at once, with sets in place of a forest."""
    group = {i: {i} for i in range(len(seqs))}
    after, events = {}, []
    for i, s in enumerate(seqs):
        for p in range(len(s) - k + 1):
            after.setdefault(s[p : p + k], []).append(s[p + k : p + k + 1] or "$")
            events.append((i, p, s[p : p + k]))
    keep = {w for w, a in after.items() if len(a) > 1 and (len(set(a)) > 1 or "$" in a)}
    rep = {}
    for i, _, w in sorted(events, key=lambda e: (-e[0], -e[1])):
        if w in keep:
            a, b = group[rep.setdefault(w, i)], group[i]
            if a is b:
                continue
            if (len(a) <= most and len(b) <= most) or len(a) < fragment or len(b) < fragment:
                a |= b
                for x in b:
                    group[x] = a
            elif len(b) < len(a):
                rep[w] = i
    return {(i, min(g)) for i, g in group.items()}


@pytest.mark.parametrize(("most", "fragment"), [(1000, 100), (3, 1), (2, 3), (5, 2)])
def test_capped_groups_equal_a_model(spark, most, fragment):
    rng = random.Random(16)
    genomes = ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(3)]
    seqs = sorted({g[i : i + 25] for g in genomes for i in range(0, 56, 4)} | {genomes[0][40:60] + genomes[1][:10]})
    rows = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    assert pairs(grouping.capped_groups(rows, 12, most, fragment, both_strands=False, bundle=5)) == capped_by_hand(seqs, 12, most, fragment)


def test_packed_sequences(spark):
    rng = random.Random(17)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (1, 31, 32, 33, 64, 100, 128, 128)]
    rows = spark.createDataFrame([(s, t) for s in seqs for t in seqs], "s string, t string").select("s", "t", S.packed("s").alias("p"), S.packed("t").alias("q"))
    value = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    number = lambda ws: sum((w & (1 << 64) - 1) << 64 * (3 - i) for i, w in enumerate(ws))
    for shift in (0, 1, 31, 32, 40, 127, -1, -32, -45):
        for r in rows.select("s", "t", "p", S.packed_shift("p", shift).alias("m"), S.packed_and("p", "q").alias("a"), S.packed_or("p", "q").alias("o"), S.packed_xor("p", "q").alias("x"), S.packed_less("p", "q").alias("l"), S.nonzero_bases("p").alias("z")).collect():
            v, w = value(r.s), value(r.t)
            assert number(r.p) == v and r.z == len(r.s) - r.s.count("A") and r.l == (v < w)
            assert (number(r.a), number(r.o), number(r.x)) == (v & w, v | w, v ^ w)
            assert number(r.m) == ((v << 2 * shift) & (1 << 256) - 1 if shift >= 0 else v >> -2 * shift)


def test_locate_rejects_duplicates(spark):
    rows = spark.createDataFrame([("CC",), ("AA",), ("GG",), ("AA",)], "seq string")
    assert pairs(R.locate(rows, spark.createDataFrame([("GG",), ("TT",)], "seq string"))) == {("GG", 2)}
    with pytest.raises(Exception, match="duplicate read"):
        R.locate(rows, rows).collect()


def test_concatenated_and_saved_index(spark, unique, tmp_path):
    rows = R.concatenated(unique.withColumn("header", F.concat(F.lit("h"), "read_id")), "read_id")
    text = "".join(f">h{i}{s}" for i, s in enumerate(UNIQUE))
    for r in rows.collect():
        at = r.start + r.header_length
        assert text[r.start : at] == f">h{r.record_no}" and text[at : at + r.read_length] == UNIQUE[r.record_no]
    b = bwt.transform(unique)
    writers.index(bwt.run_lengths(b), str(tmp_path / "index"))
    assert pairs(bwt.expand(readers.index(spark, str(tmp_path / "index")))) == pairs(b.select("pos", "ch"))


def test_scalar_functions(spark):
    row = spark.range(1).select(
        S.reverse_complement(F.lit("AACG")).alias("rc"), S.lex_rank(F.lit("TTTT")).alias("rank"), S.unrank(F.lit(256), 4).alias("back"),
        S.trim_n(F.lit("NnACNGTn")).alias("trim"), S.segments(F.lit("ACGNNACGTTNA"), 3).alias("cut"), S.normalise(F.array(F.lit(1.0), F.lit(3.0))).alias("v"),
        S.normalise(F.array(F.lit(0.0))).alias("zero"), S.cut_even_palindrome(F.lit("ACGT")).alias("pal"), S.code_reverse_complement(F.lit(0), 3).alias("code"),
    ).first()
    assert (row.rc, row.rank, row.back, row.trim, row.cut, row.v, row.zero, row.pal, row.code) == ("CGTT", 256, "TTTT", "ACNGT", ["ACG", "ACGTT"], [0.25, 0.75], None, "CGT", 63)
    assert [r.n for r in spark.range(1, 5).orderBy("id").select(S.canonical_number("id").alias("n")).collect()] == [2, 10, 32, 136]


def test_canonical_counts(unique):
    four = dict(pairs(K.canonical_counts(unique, 4)))
    assert (four["CGTA"], four["ACGT"], four["GTAC"], four["GTAA"]) == (8, 5, 3, 2)
    five = dict(pairs(K.canonical_counts(unique, 5)))
    assert (five["ACGTA"], five["CGTAC"], five["CGTAA"], five["GCCCC"]) == (7, 6, 2, 2)
    assert K.occurrences(unique, 11).count() == 0


def test_own_reverse_complement_once_is_maximal(spark):
    one = spark.createDataFrame([(0, "AACGTT"), (1, "GACGTC")], "read_id long, seq string")
    assert ("AACGTT", 1) not in pairs(K.right_maximal_both(one, 6))  # $ on either strand
    once = spark.createDataFrame([(0, "AACGTC")], "read_id long, seq string")
    assert ("ACGT", 1) in pairs(K.right_maximal_both(once, 4))  # next C, and the complement of A before


@pytest.mark.parametrize(("k", "tau", "keep"), [(4, 2, {0, 1, 2, 3}), (4, 4, {0, 1, 3}), (5, 3, {0, 1, 3}), (6, 2, {0, 1, 2, 3})])
def test_filter_both_strands(unique, k, tau, keep):
    assert {r[0] for r in filtering.frequent_both(unique, k, tau).collect()} == keep
    good, bad = filtering.good_and_bad(unique, k, tau)
    assert good.count() + bad.count() == 4


def test_filter_needs_maximal_kmers(spark):
    one = spark.createDataFrame([(0, "GTACGTACGT")], "read_id long, seq string")
    assert filtering.frequent_both(one, 4, 3).count() == 0
    with pytest.raises(ValueError, match="two"):
        filtering.frequent_both(one, 4, 1)


def groups_of(df, by):
    return {frozenset(x) for x in df.toPandas().groupby(by)["read_id"].apply(list)}


@pytest.mark.parametrize(("k", "both", "want"), [(6, False, [{0, 1, 3}, {2}]), (8, False, [{0}, {1, 3}, {2}]), (9, False, [{0}, {1}, {2}, {3}]), (9, True, [{0}, {1, 3}, {2}])])
def test_components_of_reads(unique, k, both, want):
    assert groups_of(grouping.components(unique, k, both), "comp") == {frozenset(x) for x in want}


def test_mates_join_components(spark, unique):
    mates = spark.createDataFrame([(0, 2)], "r1 long, r2 long")
    assert groups_of(grouping.components(unique, 9, mates=mates), "comp") == {frozenset({0, 2}), frozenset({1}), frozenset({3})}


def test_capped_union_model():
    rows = pd.DataFrame({"read_id": [0, 1, 2, 0, 1, 2], "pos": [0, 0, 0, -1, -1, -1], "kmer": ["A", "A", "A", "", "", ""], "kind": ["kmer"] * 3 + ["self"] * 3})
    assert capped(rows, 10, 100) == [0, 0, 0]
    assert capped(rows, 1, 1) == [0, 1, 1]


def capped(rows, most, fragment):
    return grouping.capped_union(rows, most, fragment)["group_id"].tolist()


def test_capped_groups_without_cap_are_components(unique):
    assert groups_of(grouping.capped_groups(unique, 6, 1000, both_strands=False), "group_id") == {frozenset({0, 1, 3}), frozenset({2})}


def test_connected_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(pairs(connected_components(edges)))
    assert got[60] == 0 and got[101] == 100 and len(got) == 63
    assert connected_components(edges.where("a < 0")).count() == 0


def test_components_of_a_shuffled_path_take_few_rounds(spark, monkeypatch):
    ids = list(range(5000))
    random.Random(3).shuffle(ids)
    sizes = []
    settled = components._settled
    monkeypatch.setattr(components, "_settled", lambda rows: sizes.append(len(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))) or settled(rows))
    got = connected_components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"))
    assert got.agg(F.max("component")).first()[0] == 0 and got.count() == 5000
    assert len(sizes) <= 16 and max(sizes) < 8  # digits of the size estimate: no round inherits the one before


def test_components_equal_a_model(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7), (None, 3), (900, 900)] + [(5, 500 + i) for i in range(300)]
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    assert dict(pairs(connected_components(spark.createDataFrame(edges, "a long, b long")))) == least


def test_profiles(spark):
    c = spark.createDataFrame([(0, 0, UNIQUE[0]), (0, 1, UNIQUE[1])], "cluster_id long, seq_no long, seq string")
    got = {r.kmer: r.n for r in profiles.by_distinct_windows(c, 5, 2).collect()}
    assert got == {"AC": 6, "CG": 3, "TA": 3}  # AC holds GT
    places = {r.kmer: r.n for r in profiles.by_covered_positions(c, 5, 2).collect()}
    assert places == {"AC": 7, "GT": 7, "CG": 8, "TA": 6}  # AC 4 and GT 3 in either; CG and TA double
    d = profiles.dense(profiles.by_distinct_windows(c, 5, 2), 2)
    assert d.count() == 10
    v = profiles.vectors(profiles.ranks(d), "rank").first().v
    assert sorted(v) == list(range(10))


def test_kmeans_and_merging(spark):
    points = [(i, [float(i % 2 * 5 + i), 1.0, float((1 - i % 2) * 9)]) for i in range(10)]
    df = spark.createDataFrame(points, "id long, profile array<double>")
    got = kmeans.kmeans(df, 2, 10, init_ids=[0, 1])
    labels = {r.id: r.cluster for r in got.assignment.collect()}
    assert labels[0] == labels[2] and labels[1] == labels[3] != labels[0]
    assert kmeans.kmeans(df.where("id < 0"), 2).rounds == 0
    assert kmeans.merge_by_ratio({(0, 1): 1.0, (0, 2): 9.0, (1, 2): 9.0}, {0: 1.0, 1: 1.0, 2: 1.0}, 1.0, least=1) == {0: 0, 1: 0, 2: 2}
    assert kmeans.agglomerate([[0.0, 1.0], [0.0, 1.1], [9.0, 1.0]], {0: 1, 1: 1, 2: 1}, {0: 0.1, 1: 0.1, 2: 0.1}) == {0: 0, 1: 0, 2: 2}


def test_kmeans_tells_whether_it_settled(spark):
    df = spark.createDataFrame([(i, [float(i % 2 * 5 + i), 1.0, float((1 - i % 2) * 9)]) for i in range(10)], "id long, profile array<double>")
    assert kmeans.kmeans(df, 2, 10, init_ids=[0, 1]).settled
    assert not kmeans.kmeans(df, 2, 1, init_ids=[0, 1]).settled


def test_registered_kmeans_has_reference_settings(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(kmeans, "kmeans", lambda p, k=50, rounds=100, seed=1: seen.append((k, rounds, seed)) or kmeans.Result(p.selectExpr("id", "0 AS cluster", "0.0D AS dist"), [[0.0]], 1, True))
    catalog.kmeans_query(spark, "/root/testdata/sf0.001")
    catalog.adaptive_kmeans(spark, "/root/testdata/sf0.001")
    assert seen == [(50, 100, 1), *((10, 200, 1 + r) for r in range(10))]


def test_bwt_against_sorted_suffixes(spark, unique):
    suffixes = sorted((s[p:] + "$", i, s[p - 1] if p else "$") for i, s in enumerate(UNIQUE) for p in range(len(s) + 1))
    b = bwt.transform(unique)
    want = "".join(x[2] for x in suffixes)
    assert "".join(r.ch for r in b.orderBy("pos").collect()) == want
    runs = bwt.run_lengths(b).orderBy("start").collect()
    assert "".join(r.ch * r.length for r in runs) == want and all(x.ch != y.ch for x, y in zip(runs, runs[1:]))
    assert all(r["rank"] == want[: r.pos].count(r.ch) for r in bwt.rank_before(b, block=7).collect())


def test_order_does_not_matter(spark):
    random.seed(2)
    seqs = ["".join(random.choice("ACGT") for _ in range(20)) for _ in range(30)]
    seqs += [s[5:] + s[:5] for s in seqs[:9]]
    mixed = random.sample(seqs, len(seqs))
    a, b = (R.with_read_ids(spark.createDataFrame([(s,) for s in x], "seq string").distinct()) for x in (seqs, mixed))
    assert pairs(filtering.frequent_both(a, 5, 2)) == pairs(filtering.frequent_both(b, 5, 2))
    flipped = [s if i % 2 else s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in enumerate(seqs)]
    c = R.with_read_ids(spark.createDataFrame([(s,) for s in flipped], "seq string").distinct())
    assert pairs(K.canonical_counts(a, 5)) == pairs(K.canonical_counts(c, 5))


def test_config():
    text = "".join(f"{f.replace('_', '-')}: {v}  # c\n" for f, v in {**Config().__dict__, "run_metacluster": "true", "only_kmeans": "false", "paired_ends": "false"}.items())
    got = read_config(text)
    assert got.run_metacluster is True and got.threads == 4
    assert command_line(got, ["--read-filtering-k", "5", "--only-kmeans", "false"]).read_filtering_k == 5
    with pytest.raises(ValueError, match="missing"):
        read_config("threads: 4")


def test_files_and_pipeline(spark, tmp_path):
    random.seed(5)
    genome = "".join(random.choice("ACGT") for _ in range(300))
    seqs = [genome[i : i + 60] for i in range(0, 240, 6)]
    (tmp_path / "in.fa").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(seqs)))
    c = Config(input_reads=str(tmp_path / "in.fa"), final_clusters_out=str(tmp_path / "final"), preclusters_out=str(tmp_path / "pre"), read_filtering_threshold=2, precluster_min_size=3, preclustering_k=20, precluster_max_size=100, kmeans_number_of_clusters=2, kmeans_number_of_rounds=3)
    final = pipeline.run(spark, c)
    assert final.count() == len(seqs)
    assert readers.clusters(spark, str(tmp_path / "final")).count() == len(seqs)
    assert readers.count_clusters(spark, str(tmp_path / "pre")) == final.select("cluster_id").distinct().count()
    g = spark.createDataFrame([(0, 3), (0, 1), (1, 2)], "group_id long, read_id long")
    writers.groups(g, str(tmp_path / "groups"))
    assert sorted(r[0] for r in readers.groups(spark, str(tmp_path / "groups")).select("read_id").collect()) == [1, 2, 3]
    writers.mate_pairs(spark.createDataFrame([(3, 2)], "r1 long, r2 long"), str(tmp_path / "mates"))
    assert pairs(readers.mate_pairs(spark, str(tmp_path / "mates"))) == {(3, 2)}


def test_streaming_counts(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame(list(enumerate(UNIQUE)), "read_id long, seq string").write.parquet(str(src))
    stream = spark.readStream.schema("read_id long, seq string").parquet(str(src))
    q = streaming_counts(stream, 4).writeStream.format("memory").queryName("kmer_stream").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert dict(pairs(spark.table("kmer_stream")))["CGTA"] == 8


def test_outliers(spark):
    near = [(i, 0, 10 + i % 3) for i in range(20)] + [(30 + i, 1, 5) for i in range(4)]
    assigned = spark.createDataFrame([*near, (99, 0, 60), (98, 2, 7)], "id long, cluster int, dist long")
    assert pairs(kmeans.outliers(assigned)) == {(99, 0, 60)}
    spread = spark.createDataFrame([(i, 0, d) for i, d in enumerate([0, 2, 4, 6, 8])], "id long, cluster int, dist long")
    assert pairs(kmeans.outliers(spread)) == set()
    assert pairs(kmeans.outliers(spread, deviations=1.0)) == {(4, 0, 8)}
