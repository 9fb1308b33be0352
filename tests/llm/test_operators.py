"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import bpe, chat, hashcount, jaccard, language, media, mixing, pii, quality, queries, repeats, toxicity
from strandloom.llm.textblocks import Words, text_buffer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and tion ing red blue stone water light house ärger été niño".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.sample(WORDS, 2)) for _ in range(n))


A, B = prose(120, 1), prose(150, 2)
TEXTS = [
    A, A, A.upper(), A + " one more", A.replace("stone", "STONE", 1), B, B + "\n" + A, None, "", "  \n\t ", "solo", "solo", "Solo words here",
    "x " * 3000, prose(9000, 3), "né 😀   zero", "spam! " * 200, "!!! $$$ ###", "a\x1cb c\x85d", A + "\n" + A + "\n" + B,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", i) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, B, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("batch", "topic", "tokens", "_row", "email", "body", "node", "score", "kept", "drawn", "media"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(hashcount, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(hashcount, "BUCKET_HASHES", 500)


def words(text):
    return (text or "").encode().split()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_words_match_the_pattern():
    buf, off = text_buffer(pa.array(TEXTS))
    w = Words(buf, off)
    for i, t in enumerate(TEXTS):
        got = [bytes(buf[w.starts[k] : w.ends[k]]) for k in range(w.word_off[i], w.word_off[i + 1])]
        assert got == [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


# 1 chat
def test_chat_reads_back(spark):
    hard = "</s>[INST] ok [/INST] <|turn|> <\\|turn|> <\\\\|end|>\\ [ <|next|"
    rows = [(1, 2, "assistant", hard), (1, 1, "user", None), (1, 1, "user", "b"), (1, 3, "assistant", "x"), (1, 4, None, ""), (2, None, "<|text|>", "y"), (None, 0, "user", "z"), (1, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] or -1, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert {c: [tuple(x) for x in r.t] for c, r in got.items()} == dict(want)
    assert got[1].l == hard + "x" and got[2].l == "" and got[1].n_blocks == 3
    assert "[INST]" not in got[1].formatted
    assert chat.format_conversations(df.where("conv_id > 9")).count() == 0


def test_chat_plan_is_native(spark, tmp_path):
    spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = queries.op1_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2 mixing
def test_mixing_meets_targets(spark, docs, empty):
    rows = [(i, "w" * (400 + i % 7), ["en", "de"][i % 5 == 0], f"s{i % 3 * (i % 2)}", 0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = df.selectExpr("source _source", "lang _lang", "'t' _topic", "1L n").groupBy("_source", "_lang", "_topic").agg(F.sum("n").alias("n"))
    target = spark.createDataFrame([("s0", 0.5), ("s1", 0.25), ("s2", 0.25)], "value string, share double")
    even = spark.createDataFrame([("en", 0.5), ("de", 0.5)], "value string, share double")
    raked = mixing.rake(cells, 40, targets={"source": target, "lang": even}).toPandas()
    assert np.allclose(raked.groupby("_source")["weight"].sum() / raked["weight"].sum(), [0.5, 0.25, 0.25], atol=1e-6)
    assert np.allclose(raked.groupby("_lang")["weight"].sum() / raked["weight"].sum(), 0.5, atol=1e-6)
    got = mixing.draw(df).toPandas()
    assert abs((got["probability"] * got["tokens"]).sum() / got["tokens"].sum() - mixing.KEEP) < 1e-9
    assert abs(got["drawn"].mean() - mixing.KEEP) < 0.06
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and kept.where("topic <> 'own topic'").count() == 0
    assert mixing.draw(empty).count() == 0


def test_mixing_rounds_reach_the_targets_and_rates_fill_up(spark):
    rows = [(i, "w" * (40 + 900 * (i % 11 == 0)), ["en", "de", None][i % 3], f"s{min(i % 7, 3)}", 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = mixing._keyed(df, None).groupBy("_source", "_lang", "_topic").agg(F.sum("tokens").alias("n"))
    raked = mixing.rake(cells).cache()
    assert mixing.marginal_error(raked) < 1e-6 < mixing.marginal_error(mixing.rake(cells, 0))
    for keep in (0.1, 0.8, 0.97, 1.0):
        p = {tuple(r)[:3]: r.probability for r in mixing.probabilities(raked, keep).collect()}
        n = {tuple(r)[:3]: r.n for r in cells.where("n > 0").collect()}
        assert abs(sum(p[c] * n[c] for c in n) - keep * sum(n.values())) < 1e-6 and all(0 < x <= 1 for x in p.values())
    assert mixing.probabilities(raked.where("n < 0")).count() == 0


# 3 language
def test_language_models(spark, docs, empty):
    en, de = [prose(60, s) for s in range(40)], [" ".join("".join(random.Random(s * 99 + k).sample("schau gelb über straße und zug ein".split(), 2)) for k in range(60)) for s in range(40)]
    m = language.fit_models({"de": de, "en": en})
    for lang in range(2):  # each context's probabilities sum to one over the symbols seen in it and the rest
        assert (m.probs[0][:, lang].sum() <= 1 + 1e-9) and (m.probs[0][:, lang] > 0).all()
    rows = spark.createDataFrame([(0, prose(50, 777)), (1, "über straße gelbzug und schauein"), (2, None), (3, "12 !!"), (4, ""), (5, "漢字かな交じり文" * 30), (5, "zug")], "doc_id long, text string")
    got = sorted(rows_of(language.identify_languages(rows, m, reject=False)))
    assert [g[1] for g in got[:5]] == ["en", "de", "und", "und", "und"] and all(0 <= g[2] <= 1 for g in got)
    assert Counter(r[1] for r in rows_of(language.identify_languages(rows, m)) if r[0] == 5)["und"] >= 1
    assert language.identify_languages(docs, m).count() == docs.count()
    assert language.identify_languages(empty, m).count() == 0
    with pytest.raises(ValueError, match="labelled"):
        language.train_languages(empty)


def test_language_entropy_ignores_neighbours():
    m = language.fit_models({"a": [prose(50, 1)] * 9, "b": ["zug schau"] * 9})
    alone = [m.entropies(pa.array([t]))[0][0] for t in TEXTS]
    assert np.allclose(alone, m.entropies(pa.array(TEXTS))[0])


def test_language_models_equal_plain_kneser_ney():
    """Interpolated Kneser-Ney by the book, on strings."""
    texts = {"a": [prose(12, s) for s in range(6)], "b": ["schau gelb zug " * 3, "über zug"]}
    m, d, order = language.fit_models(texts, held=99), 0.75, language.ORDER
    gap = "\0" * (order - 1)

    def symbols(t):
        return gap + "".join(re.sub(r"[^\W\d_]|(.)", lambda x: x[0].lower() if x[1] is None else "\0", t)) if t else gap

    def squeezed(t):  # one gap between letter runs, none before the first
        body = re.sub("\0+", "\0", symbols(t)[order - 1 :]).lstrip("\0")
        return gap + body

    alphabet = max(2, len({c for ts in texts.values() for i, t in enumerate(ts) if i % 99 or len(ts) < 99 for c in squeezed(t)[order - 1 :]}) + 1)
    for k, lang in enumerate(m.langs):
        grams = Counter()
        for t in texts[lang]:
            s = squeezed(t)
            for i in range(order - 1, len(s)):
                grams[s[i - order + 1 : i + 1]] += 1
        counts = {order: grams}
        longer = set(grams)
        for n in range(order - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in longer)
            longer = set(counts[n])

        def prob(g, counts=counts):
            if not g:
                return 1 / alphabet
            c = counts[len(g)]
            same = [x for x in c if x[:-1] == g[:-1]]
            if not same:
                return prob(g[1:])
            total = sum(c[x] for x in same)
            return max(c[g] - d, 0) / total + min(1.0, d * len(same) / total) * prob(g[1:])

        for t in ("zug über stone", prose(4, 91)):
            s = squeezed(t)
            want = -sum(np.log2(prob(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))) / (len(s) - order + 1)
            assert abs(m.entropies(pa.array([t]))[0][0, k] - want) < 1e-9


# 4 media
@pytest.mark.parametrize("n", [0, 1, 64, 1417, 1418, 50_000])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(n)
    stored = media.store_payload(payload)
    got, s = media.load_payload(stored)
    assert got == payload and s.crc_failed == 0 and s.resyncs == 0 and s.vbr["frames"] == s.frames == len(s.offsets)
    assert s.samples == 1152 * s.frames and all(media.parse_header(stored[a : a + 4]) for a in s.offsets)


def test_media_resynchronises_and_checks(spark, docs, empty):
    stored = media.store_payload(b"q" * 9000)
    whole = media.parse_mpeg(stored)
    cut = whole.offsets[2]
    damaged = stored[:cut] + b"\xff\xfb\x00noise\xff" + stored[cut:] + b"TAG" + b"name".ljust(125, b"\0")
    s = media.parse_mpeg(damaged)
    assert s.frames == whole.frames and s.resyncs == 1 and s.tags["title"] == "name"
    flipped = bytearray(stored)
    flipped[whole.offsets[1] + 8] ^= 1
    assert media.parse_mpeg(bytes(flipped)).crc_failed == 1
    assert media.parse_mpeg(b"").frames == media.parse_mpeg(os.urandom(300)).frames == 0
    df = spark.createDataFrame([(0, bytearray(stored)), (1, None), (None, bytearray(b""))], "doc_id long, media binary")
    assert {r.doc_id: r.n_frames for r in media.media_columns(df, "media").collect()} == {0: whole.frames, 1: 0, None: 0}
    got = {r.doc_id: r for r in media.payload_digests(media.text_as_media(docs)).collect() if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    assert media.text_as_media(empty).count() == 0


@pytest.mark.parametrize("tag", [b"TAG", b"APETAGEX", b"ID3\x04\x00\x00\x00\x00\x00\x7f"])
def test_media_payload_may_look_like_tags(tag):
    for n in (64, 128, 192):
        for at in range(n - len(tag) + 1):
            payload = bytearray(random.Random(at).randbytes(n))
            payload[at : at + len(tag)] = tag
            got, s = media.load_payload(media.store_payload(bytes(payload)))
            assert got == bytes(payload) and s.resyncs == s.crc_failed == 0


def test_media_query_equals_brute_force(spark, docs):
    import zlib

    found = media.payload_digests(media.text_as_media(docs))
    stored = {r.doc_id: bytes(r.media) for r in media.text_as_media(docs).where("doc_id IS NOT NULL").collect()}
    for r in found.where("doc_id IS NOT NULL").collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert f"frames={-(-len(padded) // media._ROOM[14]) + 1};" in r.feature


def test_media_free_format():
    frames = [bytes((0xFF, 0xFB, 2 << 2 | 2 * (k % 3 == 1), 0xC4)) + bytes(196 + (k % 3 == 1)) for k in range(7)]
    s = media.parse_mpeg(b"junk" * 5 + b"".join(frames))
    assert s.frames == 7 and s.samples == 7 * 1152 and s.resyncs == 1 and s.offsets[1] - s.offsets[0] == 200 and s.offsets[2] - s.offsets[1] == 201
    assert media.parse_mpeg(frames[0]).frames == 0  # one frame alone tells no length


def crc_by_bits(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ b else 0)
    return c


@pytest.mark.parametrize(("layer", "mode"), [(1, 0), (1, 3), (1, 1), (2, 0), (2, 3), (2, 1)])
def test_media_checksums_of_layers_one_and_two(layer, mode):
    header = bytes((0xFF, 0xF8 | (4 - layer) << 1, 8 << 4, mode << 6))  # MPEG-1, protected, 44.1 kHz
    h = media.parse_header(header)
    rng = random.Random(layer * 10 + mode)
    body = bytearray(rng.randbytes(h.length - 6))
    bits = [int(x) for x in "".join(f"{b:08b}" for b in body)]
    channels, bound = (1 if mode == 3 else 2), (4 if mode == 1 else 32)
    if layer == 1:
        n = 4 * (bound * channels + (32 - bound if channels == 2 else 0))
    else:
        per = h.kbps // channels
        table = [4] * 11 + [3] * 12 + [2] * (7 if per >= 96 else 4)
        n = factors = 0
        for band, size in enumerate(table):
            for _ in range(channels if band < bound else 1):
                factors += (1 if band < bound or channels == 1 else 2) * any(bits[n : n + size])
                n += size
        n += 2 * factors
    crc = crc_by_bits([int(x) for x in "".join(f"{b:08b}" for b in header[2:])] + bits[:n])
    frame = header + crc.to_bytes(2, "big") + bytes(body)
    s = media.parse_mpeg(frame * 3)
    assert (s.frames, s.crc_checked, s.crc_failed) == (3, 3, 0)
    bad = bytearray(frame * 3)
    bad[7] ^= 0x10
    assert media.parse_mpeg(bytes(bad)).crc_failed == 1


# 5 BPE
def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_of_one_hash_keep_their_own_tokens(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    x = thue_morse(10)
    y = x.translate(str.maketrans("ab", "ba"))
    texts = [x, y, f"{x} {y}", "q" * 64 + " " + "q" * 65, *(t or "" for t in TEXTS)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    with open(queries.TOKENIZER, "rb") as f:
        raw = f.read()
    assert [g.tolist() for g in bpe.Bpe(raw).encode_batch(texts)] == want
    h = Words(*text_buffer(pa.array([x, y]))).hashes
    assert h[0] != h[1]
    real = bpe.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda *a: real(*a) & np.uint64(63))  # nearly every word meets another
    own = bpe.Bpe(raw)
    for _ in range(2):
        assert [g.tolist() for g in own.encode_batch(texts)] == want


def test_bpe_equals_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    rng = random.Random(3)
    letters = [chr(c) for c in range(1, 0x250)] + list(" 　漢😀́​ ")
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(80)) for _ in range(400)] + ["don't I'LL we'll 's ''s a'sb", "a" * 3000, "x<|endoftext|> y<|endoftext|>", " \n\n a \t"]
    with open(queries.TOKENIZER, "rb") as f:
        own = bpe.Bpe(f.read(), max_words=200)
    for _ in range(2):  # the second time the table of words was emptied or reused
        got = own.encode_batch(texts)
        assert [x.tolist() for x in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in got] == [lib.decode(x.tolist(), skip_special_tokens=False) for x in got]
    a, b = np.divmod(np.array([rng.randrange(5000**2) for _ in range(3000)]), 5000)
    brute = [own.exact(own.tokens[x] + own.tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    whole = np.array([own.exact(own.tokens[x]) == [x] and own.exact(own.tokens[y]) == [y] for x, y in zip(a.tolist(), b.tolist())])
    assert (own.compatible(a, b) == np.array(brute))[whole].all()
    assert bpe.encode_texts(docs, queries.TOKENIZER).count() == docs.count()
    assert bpe.encode_texts(empty, queries.TOKENIZER).count() == 0


# 6 PII
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, found):
    d = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_pii_base_spans_and_redaction(spark, docs, empty):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab.@-_+ 0123456789()é😀") for _ in range(300)) for _ in range(60)]
    texts += ["a@b.c_d@e.f a@b.c.d..e", "4111 1111-1111 1111 +1 (555) 123-4567", "1." * 2000, "0" * 5000, "a@" * 3000 + "b.c", None, " ".join(["+1 (456) 555-2186 x@y.zz 1.2.3.4"] * 200), "1.2.3.4 10.0.0.256"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("email", F.lit("clash"))
    model = pii.fit_pii(df)
    found = pii.find_pii(df.drop("email"), model).select("doc_id", pii.span_string(pii.span_list()).alias("s"))
    for r in found.collect():
        t = texts[r.doc_id] or ""
        assert r.s == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in RULES.items() for m in re.finditer(p, t) if valid(k, m[0])), t[:80]
    out = {r.doc_id: r for r in pii.redact(df, model).collect()}
    assert out[texts.index(None)].text is None and out[0].email == "clash"
    assert out[61].text == "[CARD] [PHONE]" or "[CARD]" in out[61].text
    assert pii.redact(docs, model).columns == docs.columns and pii.redact(docs, model).count() == docs.count()
    assert pii.find_pii(empty.select("doc_id", "text"), pii.fit_pii(empty)).count() == 0


def test_pii_trees_learn_and_hold_precision():
    good, bad = (1, 11, 4, 1, 1, 0, 1, 0, 0, 0, 0), (1, 7, 2, 0, 0, 0, 0, 0, 0, 0, 0)
    m = pii.fit_trees([(good, 500, 499), (bad, 500, 5)])
    as_map = lambda x: dict(zip(pii.FEATURES, x))
    assert m.score(as_map(good)) >= m.thresholds["number"] > m.score(as_map(bad)) and "secret" not in m.thresholds


def test_pii_candidates_have_no_upper_length(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("aZ_09 .-()+5\n") for _ in range(400)) for _ in range(60)]
    texts += ["x" + "0f" * 400, "key " + "0f" * 64, "1 " * 3000 + "x", "(555) " * 400, "9" * 4000, "a_" * 5000, "5" * 4000 + "x", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    number = re.compile(r"(?<![A-Za-z0-9_])\(?[0-9]+(?![A-Za-z0-9_])(?:[ ().-]+[0-9]+(?![A-Za-z0-9_]))*")
    secret = re.compile(r"[A-Za-z0-9_]+")
    for r in pii.candidates(pii.base_spans(df)).select("doc_id", "proposed").collect():
        t = texts[r.doc_id] or ""
        want = [("number", m.start(), m.end()) for m in number.finditer(t) if m.end() - m.start() >= 7]
        want += [("secret", m.start(), m.end()) for m in secret.finditer(t) if m.end() - m.start() >= 16 and re.search("[0-9]", m[0])]
        assert [(p.kind, p.start, p.end) for p in r.proposed] == want, t[:60]


def test_pii_added_spans_are_those_the_trees_select(spark):
    rng = random.Random(13)
    texts = []
    for i in range(1500):
        kind = rng.randrange(4)
        code = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        texts.append(prose(5, i) + [f" password: {code} x", f" build {rng.randrange(10**8, 10**9)}_{'abcdefghij'} y", f" call +1 (555) 123-{rng.randrange(1000, 9999)} z", " plain"][kind])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit_pii(df)
    proposed = {r.doc_id: r.proposed for r in pii.candidates(pii.base_spans(df)).select("doc_id", "proposed").collect()}
    added = 0
    for r in pii.find_pii(df, model).select("doc_id", "added").collect():
        want = [(p.kind, p.start, p.end) for p in proposed[r.doc_id] if not p.base and model.score({f: p[f] for f in pii.FEATURES}) >= model.thresholds.get(p.kind, float("inf"))]
        assert [tuple(x) for x in r.added] == want
        added += len(want)
    assert added > 100 and "secret" in model.thresholds
    counts = pii.find_pii(df, model).agg(F.sum(queries._added("secret")).alias("secret"), F.sum(queries._added("number")).alias("number")).first()
    assert counts.secret + counts.number == added and counts.secret > 100


def test_pii_thresholds_come_from_held_out_counts():
    good, bad = (1, 11, 4, 1, 1, 0, 1, 0, 0, 0, 0), (1, 7, 2, 0, 0, 0, 0, 0, 0, 0, 0)
    fitted = [(good, 500, 499), (bad, 500, 5)]
    assert "number" in pii.fit_trees(fitted, held=[(good, 200, 199), (bad, 100, 0)]).thresholds
    assert "number" not in pii.fit_trees(fitted, held=[(good, 200, 120), (bad, 100, 0)]).thresholds
    assert "number" not in pii.fit_trees(fitted, held=[]).thresholds


# 7 toxicity
def test_factorization_machine_learns_exclusive_or():
    """Either term alone is neutral over all rows; only the pair tells."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (4000, 2))
    sets = [np.array([10 + k for k in range(2) if r[k]] + [100 + int(rng.integers(50)), 200 + int(rng.integers(50))]) for r in x]
    m = toxicity.fit_machine(sets, x[:, 0] ^ x[:, 1])
    raw = lambda c: m._raw(np.zeros(len(c), dtype=int), m.slot[c], 1)[0]
    assert raw([10]) > 0 and raw([11]) > 0 and raw([10, 11]) < 0 and m.bias < 0


def test_machine_equals_the_plain_sum():
    rng = np.random.default_rng(5)
    m = toxicity.Machine(np.arange(1 << toxicity.BITS), 0.3, rng.normal(size=1 << toxicity.BITS), rng.normal(size=(1 << toxicity.BITS, 4)) / 10)
    doc, bucket = toxicity.terms(pa.array([TEXTS[0], TEXTS[10], None]))
    for i, got in enumerate(m.score(pa.array([TEXTS[0], TEXTS[10], None]))):
        own = sorted(set(bucket[doc == i].tolist()))
        raw = 0.3 + sum(m.weight[b] for b in own) + sum(m.factor[a] @ m.factor[b] for k, a in enumerate(own) for b in own[:k])
        assert abs(got - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9


def test_held_out_folds(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) doc_id"))
    for parts in (4, 5):
        for r in rows.select("doc_id", queries._fold(parts).alias("f")).collect():
            assert r.f == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % parts


def test_factorization_machine_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 2))
    sets = [np.array([10 + k for k in range(2) if r[k]] + [100 + int(rng.integers(50))]) for r in x]
    y = (x[:, 0] ^ x[:, 1] ^ 1) * (x.sum(1) > 0) | 0  # only both together
    m = toxicity.fit_machine(sets, y, epochs=40)
    both = m._raw(np.array([0, 0]), m.slot[[10, 11]], 1)[0]
    assert both > 0 and m._raw(np.array([0]), m.slot[[10]], 1)[0] < 0


def test_toxicity_scores(spark, docs, empty):
    bad = [(i, prose(40, i) + (" scum stupid" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(bad, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(0, None), (None, 1), (1, 7)], "doc_id long, toxic int"))
    m = toxicity.train_toxicity(df.drop("toxic"), labels)
    got = toxicity.score_toxicity(spark.createDataFrame([(0, prose(30, 901) + " Stupid, SCUM."), (1, prose(30, 902)), (2, None), (3, "")], "doc_id long, text string"), m)
    assert {r.doc_id: r.predicted for r in got.collect()} == {0: 1, 1: 0, 2: 0, 3: 0}
    assert toxicity.score_toxicity(docs, m).count() == docs.count() and toxicity.score_toxicity(empty, m).count() == 0
    none = toxicity.train_toxicity(empty, labels.where("doc_id < 0"))
    assert toxicity.score_toxicity(docs, none).where("score between 0 and 1").count() == docs.count()


# 8 Jaccard join
def brute_components(items, size, percent):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in items:
        w = [x.translate(lower) for x in words(t)]
        sets.append(frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else []))
    comp = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for (key, _), c in zip(items, comp):
        if key is not None:
            least[c] = min(key, least.get(c, key))
    return Counter((key, len(s), least.get(c)) for (key, _), s, c in zip(items, sets, comp))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_equals_brute_force(spark, docs, size, percent):
    rng = random.Random(size)
    items = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = [prose(80, s).split() for s in range(6)]
    for i in range(150):  # chains of edits around a few texts
        w = list(base[rng.randrange(6)])
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        items.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(items, "doc_id long, text string")
    assert Counter(rows_of(jaccard.jaccard_components(df, size, percent))) == brute_components(items, size, percent)


def test_jaccard_of_many_near_copies(spark):
    rng = random.Random(31)
    base = prose(120, 500).split()
    items = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        items.append((i, " ".join(w)))
    df = spark.createDataFrame(items, "doc_id long, text string")
    assert Counter(rows_of(jaccard.jaccard_components(df))) == brute_components(items, 4, 85)
    assert jaccard.keep_one(df, keep_repeats=False).count() == len({c for _, _, c in brute_components(items, 4, 85)})


def test_keep_one_without_repeats(spark, docs):
    kept = jaccard.keep_one(docs, keep_repeats=False)
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[0] == 1 and 1 not in ids and ids[7] == ids[8] == ids[9] == 1 and kept.columns == docs.columns
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, None)], "doc_id long, text string")
    assert Counter(rows_of(jaccard.keep_one(rows, keep_repeats=False))) == Counter({(1, "a b c d e f"): 1, (None, None): 2})


def test_keep_one(docs, empty):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[0] == 2 and 1 not in ids and 4 not in ids and ids[7] == ids[8] == ids[9] == 1
    assert jaccard.keep_one(empty).count() == 0


def test_keep_one_decides_by_row(spark):
    a, b, c, d, e = (prose(120, s) for s in range(60, 65))
    rows = [
        (None, "nothing like it " + prose(40, 70)), (None, None), (None, " "), (None, "solo"),  # link with none: all stay
        (None, a), (7, a + " more"), (8, a),  # a null key only where no other is
        (None, b), (None, b), (None, b + " more"),  # null keys only: one row
        (9, c), (10, c), (10, d),  # 10 loses one group and is alone elsewhere
        (11, e), (11, e + " more"),  # one key, two texts of one group
    ]
    df = spark.createDataFrame([(*r, {"n": i}) for i, r in enumerate(rows)], "doc_id long, text string, own map<string,int>")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    found = [(r.doc_id, r.text, r.own["n"]) for r in kept.collect()]
    n = {x[2] for x in found}
    assert len(found) == len(n) == 9 and {0, 1, 2, 3, 5, 10, 12} <= n
    assert len(n & {7, 8, 9}) == 1 and len(n & {13, 14}) == 1


# 9 repeats
def test_repeats_equal_brute_force(spark, docs, empty):
    rng = random.Random(8)
    long_pass, edge = prose(60, 50).split(), prose(35, 51).split()
    items = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for i in range(40):
        own = prose(rng.randrange(0, 90), 100 + i).split()
        part = rng.choice([long_pass, edge, edge[:34], long_pass[5:45]])
        at = rng.randrange(len(own) + 1)
        items.append((100 + i, " ".join(own[:at] + part + own[at:])))
    count = Counter(tuple(w[k : k + 35]) for _, t in items for w in [words(t)] for k in range(len(w) - 34))
    want = Counter()
    for key, t in items:
        w = words(t)
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[(key, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())] += 1
    df = spark.createDataFrame(items, "doc_id long, text string")
    assert Counter(rows_of(repeats.remove_repeats(df))) == want
    assert repeats.remove_repeats(empty).count() == 0


def test_cover_meets_every_pair():
    for i in range(repeats.PERIOD):
        for j in range(repeats.PERIOD):
            assert any((i + s) % repeats.PERIOD in repeats.COVER and (j + s) % repeats.PERIOD in repeats.COVER for s in range(repeats.PERIOD))


# 10 quality
def test_quality_equals_brute_force(docs, empty):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        t = r.text or ""
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {p for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want[(r.doc_id, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed)] += 1
    assert Counter(rows_of(quality.quality_features(docs).select("doc_id", *quality.BASE, "base_failed"))) == want
    assert quality.quality_features(empty).count() == 0


def test_cascade_does_less_than_all_rules(docs):
    texts = pa.array([t for t in TEXTS if t] * 5 + ["short"] * 50)
    order = tuple(sorted(quality.RULES, key=lambda r: r.name == "repeated_words"))
    short, whole = quality.View(texts), quality.View(texts)
    verdict = quality.cascade(short, order) < 0
    every = np.zeros(len(whole), dtype=bool)
    for rule in quality.RULES:
        every |= rule.rejects(whole)
    assert (verdict == ~every).all() and short.work[0] < whole.work[0]


def test_rule_order_repeats(docs):
    first = quality.estimate_rules(docs)
    assert first == quality.estimate_rules(docs.repartition(7)) and quality.estimate_rules(docs, sample_rows=3)


def test_cascade_order_changes_no_verdict(docs):
    ids = [sorted((r.doc_id is None, r.doc_id or 0) for r in quality.keep_quality(docs, rules).select("doc_id").collect()) for rules in (quality.RULES, quality.RULES[::-1], None)]
    assert ids[0] == ids[1] == ids[2] and (False, 5) in ids[0]
    assert quality.keep_quality(docs).columns == docs.columns
    order = quality.estimate_rules(docs)
    assert len(order) == len(quality.RULES) and all(a["gain"] >= b["gain"] for a, b in zip(order, order[1:]))
