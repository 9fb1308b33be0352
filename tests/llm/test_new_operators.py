"""Lexical search, collocations and line dedup against brute force and SQL, and on odd rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import language, linededup, mixing, phrases, pii, queries, search, spans

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
LINES = ["The same long line of words, here and there.", "  the SAME long line of words, here and there.\t", "short", "", "a line that two documents share only", "ÄÖÜ ein Satz mit über zwanzig Zeichen", "Another boilerplate line of the site"]
TEXTS = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 9))) for _ in range(30)] + [None, "", "\n", "\n\n", " ".join(f"w{i % 50}" for i in range(20000)), "\n".join(LINES[0] for _ in range(3000))]
WORDS = "red blue new york city old town hall in the".split()
PROSE = [" ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\t", "\n"]) for _ in range(rng.randrange(200))) + rng.choice([" new york city hall", ""]) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", i) for i, t in enumerate(TEXTS + PROSE)]
    rows += [rows[0], rows[0], (None, LINES[0], None, None, None), (None, None, None, None, None), (None, PROSE[0], "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("seen", "last", "part", "codes", "word", "n", "left", "n_lines", "_row", "terms", "block", "query", "rank"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.cache()


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(search, "BLOCK_BYTES", 2000)


def rows_of(df):
    return [(r.doc_id, r.text, r.lang) for r in df.collect()]


# 13 lines
def kept_lines(rows, min_docs=3):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held, last = Counter(), {}
    rank = lambda i: -1 if i is None else i
    for i, text, _ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                held[k] += 1
                last[k] = max(last.get(k, -1), rank(i))
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (held[key(x)] >= min_docs and last[key(x)] != rank(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (4, 3)])
def test_line_dedup_equals_brute_force(docs, batches, fanout):
    out = linededup.drop_shared_lines(docs, batches=batches, fanout=fanout)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=repr)
    assert got == sorted(kept_lines(rows_of(docs)), key=repr) and any(r[2] for r in got)
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()


def test_line_dedup_beyond_frequent_keys(spark):
    lines = [f"line number {i} of the shared stock" for i in range(900)]
    rows = [(i, "\n".join(rng.sample(lines, 60)), None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.drop_shared_lines(df).collect())
    assert got == sorted(kept_lines(rows))


def test_line_runs_batch_by_batch(spark, docs):
    """Each batch keeps the lines that no earlier batch had; few runs remain of many batches."""
    runs, seen = linededup.LineRuns(spark, fanout=2), set()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    for b in range(5):
        batch = docs.where(f"doc_id % 5 = {b} AND doc_id < 30").dropDuplicates(["doc_id"])
        rows = rows_of(batch)
        want = sorted((i, p) for i, t, _ in rows for p, x in enumerate(t.split("\n")) if len(key(x)) >= 20 and key(x) not in seen)
        assert sorted(tuple(r) for r in linededup.new_lines(batch, runs).collect()) == want
        seen |= {key(x) for _, t, _ in rows for x in t.split("\n")}
    assert len(runs.runs()) == 2 and sum(r.where("NOT seen").count() for r in runs.runs()) == len({k for k in seen if len(k) >= 20})
    runs.close()
    assert runs.runs() == []


# 12 phrases
def mined(rows, least, percent=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in found.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: E731, B023
            if any(inside(q) and 100 * b >= percent * a for q, b in found.items()):
                continue
            score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, counts[p[:cut]], counts[p[cut:]], n[lang], score))
    return out


@pytest.mark.parametrize("names, bits, percent", [(1 << 20, 28, 100), (0, 28, 100), (1 << 20, 4, 60)])
def test_phrases_equal_brute_force(docs, monkeypatch, names, bits, percent):
    """With names by broadcast and by join, with and without a filter, in one bucket and in many."""
    monkeypatch.setattr(phrases, "NAMES_BYTES", names)
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    monkeypatch.setattr(phrases, "BUCKET_PAIRS", 100)
    got = phrases.mine_phrases(docs, least=8, inside_percent=percent)
    assert sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == sorted(mined(rows_of(docs), 8, percent))
    top = phrases.top_phrases(got, 3).collect()
    want = defaultdict(list)
    for row in mined(rows_of(docs), 8, percent):
        want[row[0]].append((-row[6], -row[2], row[1].encode()))
    assert {(r.lang, r["rank"], r.phrase.encode()) for r in top} == {(lang, i + 1, x[2]) for lang, own in want.items() for i, x in enumerate(sorted(own)[:3])}


def test_products_beyond_64_bits(spark):
    row = (10**15, 10**17, [10**15, 10**15], [10**15, 10**15])
    df = spark.createDataFrame([row], "a long, n long, firsts array<long>, lasts array<long>")
    assert df.select(phrases._cut(2).alias("c")).first().c.score == 1000 * row[0] * row[1] // (10**15 * 10**15)


# 11 search
def ranked(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t, _ in rows]
    df = Counter(t for _, bag in bags for t in bag)
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            n = sum(bag.values())
            m = 10 + 90 * n * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def test_search_equals_brute_force(spark, docs, monkeypatch):
    items = [(1, "New York, the city hall"), (2, None), (3, "nothing of this kind"), (4, "über ZWANZIG zeichen w3 w4"), (5, "red"), (5, "blue old"), (None, "town"), (6, " ".join(WORDS) + " short site same")]
    frame = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("score", F.lit("own"))
    index = search.build_index(docs)
    assert index.blocks.count() > 3
    for query_bytes in (1 << 20, 40):
        monkeypatch.setattr(search, "QUERY_BYTES", query_bytes)
        got = [tuple(r) for r in search.search(index, frame, 7).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=repr) == sorted(ranked(rows_of(docs), items, 7), key=repr)
    assert search.search(search.build_index(docs.where("doc_id < 0")), frame).count() == 0
    assert search.search(index, frame.where("item_id > 99")).count() == 0


def test_sliced_sums_and_best():
    values = np.random.default_rng(3).integers(0, 1 << 30, (9, 130))
    values[:, 5] = 0
    values[:, 100] = values[:, 20]
    sliced = lambda v: np.stack([np.packbits(np.pad((v >> b & 1).astype(np.uint8), (0, 62)), bitorder="little").view("<u8") for b in range(30)])
    total = search.add_up([sliced(v) for v in values])
    sums = values.sum(axis=0)
    for k in (1, 2, 7, 129, 500):
        at, got = search.best(total, k)
        want = sorted(sorted(range(130), key=lambda i: (-sums[i], i))[: min(k, 129)])
        assert at.tolist() == want and got.tolist() == sums[want].tolist()


def test_names_of_spans_do_not_rest_on_hashes(monkeypatch):
    buf = np.frombuffer(b"ab cd ab ef", dtype=np.uint8)
    starts, ends = spans.find_runs(buf, np.array([0, 11]), spans.byte_class((97, 122)))
    group = np.array([0, 0, 0, 1])
    right, _ = spans.name_spans(buf, starts, ends, group)
    monkeypatch.setattr(spans, "span_hashes", lambda b, s, e: np.zeros(len(s), dtype=np.uint64))
    code, kept = spans.name_spans(buf, starts, ends, np.zeros(4, dtype=np.int64))
    assert code[0] == code[2] and len({*code.tolist()}) == 3 == len(kept) and len({*right.tolist()}) == 3


def test_empty_tables(docs):
    none = docs.where("doc_id < 0")
    assert phrases.mine_phrases(none).count() == 0 and linededup.drop_shared_lines(none).count() == 0


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_collocations", "op13_line_dedup"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall(), key=repr)


# earlier operators
@pytest.mark.parametrize("name", ["op3_language_id", "op6_pii", "op7_toxicity"])
def test_learning_queries_run(spark, name):
    got = queries.queries()[name](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert name == "op6_pii" or all(0 <= r.score <= 1 for r in got)


def test_threshold_takes_equal_scores_whole():
    good, bad = tuple([1] + [0] * (len(pii.FEATURES) - 1)), tuple([1, 9] + [0] * (len(pii.FEATURES) - 2))
    model = pii.fit_trees([(good, 1000, 990), (bad, 10, 0)], rounds=0, held=[(good, 1000, 998), (bad, 600, 0)])
    assert "number" not in model.thresholds  # both have one score, and together a precision of 0.62
    model = pii.fit_trees([(good, 1000, 990), (bad, 1000, 0)], rounds=20, held=[(good, 1000, 998), (bad, 600, 0)])
    assert "number" in model.thresholds


def test_rows_without_id_are_drawn_apart(spark):
    rows = [(None, f"some text number {i}", "s", "en") for i in range(1000)]
    drawn = mixing.draw(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).where("drawn").count()
    assert 700 < drawn < 900


def test_no_language_to_learn(spark):
    rows = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    models = language.train_languages(rows, needed=False)
    assert [(r.doc_id, r.lang_pred, r.score) for r in language.identify_languages(rows, models).orderBy("doc_id").collect()] == [(1, "und", 0.0), (2, "und", 0.0)]


def test_pii_overlaps_and_merges_against_brute_force(spark):
    rng = random.Random(6)
    made = []
    for i in range(60):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(0, 60) for _ in range(rng.randrange(0, 9)))]
        made.append((i, sorted(spans), [(a, a + rng.randint(1, 9)) for a in range(0, 66, 3)]))
    rows = spark.createDataFrame(made, "i int, s array<struct<start:int,end:int>>, q array<struct<start:int,end:int>>").withColumn("body", F.repeat(F.lit("x"), 90))
    ordered = pii._ordered(rows, "s", F.lit(True)).withColumn("hit", F.transform("q", lambda q: pii._starts_before(q["end"]) > pii._ends_by(q["start"])))
    for r in ordered.collect():
        assert r.hit == [any(a < d and c < b for a, b in r.s) for c, d in r.q]


def test_pii_redacts_overlapping_spans_as_one(spark):
    """Base and added spans that overlap in any way give one bracket, named by the first by start, end and kind."""
    rng = random.Random(7)
    parts = ["+49 170 1234567", "4111 1111 1111 1111", "10.0.0.1", "a.b@c.de", "é" * 700, "\U0001d54f text ", " ", ",", "(030) 123 4567 89", "abcdef0123456789abcdef"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, "", None])], "doc_id long, text string, body string")
    low = pii.Trees(bias=1.0, thresholds={"number": 0.0, "secret": 0.0})  # adds every candidate that meets no base span
    found = {r.doc_id: r.s for r in pii.find_pii(df, low).select("doc_id", pii.span_list(added=True).alias("s")).collect()}
    out = {r.doc_id: (r.text, r.body) for r in pii.redact(df, low).collect()}
    for i, text in enumerate([*texts, "", None]):
        merged = []
        for start, end, kind in sorted((s.start, s.end, s.kind) for s in found[i]):
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end, kind])
        want, at = [], 0
        for start, end, kind in merged:
            want += [text[at:start], f"[{kind.upper()}]"]
            at = end
        assert out[i] == (None if text is None else "".join(want) + text[at:], "x")


def test_pii_takes_texts_with_many_spans(spark):
    n = 25_000  # two spans each
    df = spark.range(1).select("id", F.repeat(F.lit("tel +49 170 1234567, 123 456 78 90;\n"), n).alias("text"))
    low = pii.Trees(bias=1.0, thresholds={"number": 0.0})
    began = time.monotonic()
    r = pii.redact(df, low).select(F.length("text").alias("n"), F.md5("text").alias("h")).first()
    want = "tel [PHONE], [NUMBER];\n" * n
    assert r.n == len(want) and r.h == hashlib.md5(want.encode()).hexdigest()
    assert time.monotonic() - began < 60


def test_chunks_of_a_level_lie_in_small_files(spark, docs, monkeypatch):
    """A task decodes a file's rows together, so files hold few chunks however many a task made."""
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 2000)
    corpus = phrases._corpus(docs.coalesce(1))
    most = corpus.groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0]
    assert corpus.count() > phrases.CHUNKS_A_FILE >= most
