"""The pipeline's stages on a small table, each held against what it must do."""

import hashlib

import pytest

import corpus_pipeline as P
from strandloom.llm import queries


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    prose = lambda s, n=80: " ".join(f"wort{(k * k * 7 + s * 131) % 997}x{s}" for k in range(n))
    rows = [(i, prose(i), "en", f"s{i % 2}", 1) for i in range(12)]
    rows += [(20, prose(3), "en", "s0", 1), (21, prose(4) + " extra", "de", "s1", 1), (22, "short", "en", "s0", 1), (23, None, None, None, None), (24, "spam " * 90, "en", "s0", 1), (25, prose(40) + " mail a.b@c.de", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns = docs.columns
    good = P.quality_rules(spark, docs, sf_dir).cache()
    assert sorted(r.doc_id for r in good.collect()) == [*range(12), 20, 21, 25] and good.columns == columns
    one = P.near_duplicates(spark, good, sf_dir).cache()
    assert sorted(r.doc_id for r in one.collect()) == [*range(12), 25]
    clean = P.personal_data(spark, one, sf_dir).cache()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[25].endswith("mail [EMAIL]") and "@" not in "".join(texts.values()) and clean.columns == columns
    drawn = P.mixture(spark, clean, sf_dir)
    assert {r.doc_id for r in drawn.collect()} <= set(texts) and drawn.columns == columns


@pytest.fixture(scope="module")
def odd(spark):
    """Null keys and texts, repeated rows, one very long word, one very long text, and columns with the names of results."""
    prose = lambda s, n=80: " ".join(f"wort{(k * k * 7 + s * 131) % 997}x{s}n{k // 500}" for k in range(n))
    rows = [(1, prose(1), "en", "s0"), (1, prose(1), "en", "s0"), (None, prose(1), None, None), (None, prose(2), "en", "s1"), (None, prose(2), "en", "s1"), (2, None, "en", "s0"), (3, "", None, "s0"), (None, None, None, None)]
    rows += [(4, prose(4) + " " + "ab" * 50_000, "de", "s1"), (5, prose(5, 20_000), "en", "s0"), (6, prose(6) + " a.b@c.de", "en", "s2"), (6, prose(7), "en", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "CAST(length(text) AS LONG) AS n_chars")
    for name in ("batch", "node", "row", "key", "tag", "doc", "body", "email", "added", "topic", "tokens", "probability", "drawn", "_row", "kept"):
        df = df.selectExpr("*", f"'own {name}' AS `{name}`")
    return df.cache()


@pytest.mark.parametrize("stage", [s for s in P.STAGES if s[0] != "tokens"], ids=lambda s: s[0])
def test_stages_keep_columns_and_bear_odd_rows(spark, odd, stage):
    name, run = stage
    kept = run(spark, odd, "")
    assert kept.columns == odd.columns and kept.where("topic <> 'own topic' OR tag <> 'own tag'").count() == 0
    got = sorted((r.doc_id is None, r.doc_id or 0, len(r.text or ""), r.text is None) for r in kept.collect())
    every = sorted((r.doc_id is None, r.doc_id or 0, len(r.text or ""), r.text is None) for r in odd.collect())
    if name == "quality_rules":
        assert [g[:2] for g in got] == [(False, 1), (False, 1), (False, 5), (False, 6), (False, 6), (True, 0), (True, 0), (True, 0)]  # the long word makes words too long on average
    elif name == "near_duplicates":  # one row with text 1, one with text 2; those without words all stay
        assert [g[:2] for g in got] == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 6), (False, 6), (True, 0), (True, 0)]
    elif name == "personal_data":
        assert len(got) == len(every) and {r.text[-7:] for r in kept.where("doc_id = 6").collect()} >= {"[EMAIL]"}
        assert kept.where("NOT n_chars <=> length(text)").count() == 0
    else:
        assert set(got) <= set(every)
    assert run(spark, odd.where("doc_id > 99"), "").count() == 0


def test_token_stage_bears_odd_rows(spark, odd):
    got = P.tokens(spark, odd, "")
    assert got.count() == odd.count() and got.where("n_tokens = 0").count() == 3 and got.where("n_tokens <> size(ids)").count() == 0
    assert P.tokens(spark, odd.where("doc_id > 99"), "").count() == 0


def test_run(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    assert rows and {r.doc_id for r in rows} <= {*range(12), 25} and all(len(r.ids) == r.n_tokens for r in rows)
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5


def test_queries_have_contract_columns(spark):
    want = {
        "op4_media_columns": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op10_quality_rules": {"doc_id", "n_words", *("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "base_failed", "kept"},
    }
    found = queries.queries()
    assert sorted(found) == sorted(f"op{n}_{x}" for n, x in [(1, "chat_format"), (2, "mixing"), (3, "language_id"), (4, "media_columns"), (5, "bpe"), (6, "pii"), (7, "toxicity"), (8, "ngram_jaccard"), (9, "substring_dedup"), (10, "quality_rules")])
    for name, columns in want.items():
        assert columns <= set(found[name](spark, "/root/testdata/sf0.001").columns)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
