"""The operators over the driver's tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, chat, jaccard, language, linededup, media, mixing, phrases, pii, quality, repeats, search, toxicity
from strandloom.runtime import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -1, formatted and read back."""
    probe = spark.range(1).selectExpr(
        f"explode(array(named_struct('conv_id', -1L, 'turn', 0L, 'role', 'user', 'text', '{PROBE}'), named_struct('conv_id', -1L, 'turn', 1L, 'role', 'assistant', 'text', '{PROBE}'))) AS t"
    ).select("t.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat.format_conversations(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    as_lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(as_lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


OP1_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (
  SELECT *, regexp_replace(text, '([<\\[])(\\\\*)({chat._TAILS})', '\\1\\\\\\2\\3', 'g') AS shown,
    regexp_replace(role, '([<\\[])(\\\\*)({chat._TAILS})', '\\1\\\\\\2\\3', 'g') AS name,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown) + CASE WHEN opens THEN length(name) + {len(chat.TURN) + len(chat.TEXT) + len(chat.END)} ELSE {len(chat.NEXT)} END)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE opens) AS n_blocks
FROM e GROUP BY conv_id
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its calibrated probability and whether it is drawn."""
    return mixing.draw(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), "drawn")


def _fold(parts: int) -> Column:
    """The remainder of crc32 of a row's doc_id as text; a null one counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from rows outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    models = language.train_languages(docs.where(_fold(4) != 2), needed=False)
    found = language.identify_languages(docs, models, reject=False)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stream of MPEG audio frames, scanned and read back."""
    return media.payload_digests(media.text_as_media(table(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def _added(kind: str) -> Column:
    """How many spans of a kind the trees added."""
    return F.size(F.filter("added", lambda s: s["kind"] == kind)).cast("long")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base spans and those the trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit_pii(docs))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.span_string(pii.span_list()), 256).alias("base_sha256"),
        pii.span_string(pii.span_list(added=True)).alias("spans"),
        *(_added(k).alias(f"n_{k}") for k in pii.GENERATORS),
        (F.size(pii.span_list(added=True))).cast("long").alias("n_spans"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every text, learned from labelled rows outside fold 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train_toxicity(docs, labels.where(_fold(5) != 0).select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, machine).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles are 85 % alike."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words of repeated 35-word windows."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text and the cascade's verdict; which rule rejected a text first is left to the operator."""
    return quality.quality_features(table(spark, sf_dir, "documents")).drop("failed_rule")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    index = search.build_index(table(spark, sf_dir, "documents"))
    return search.search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return phrases.top_phrases(phrases.mine_phrases(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that three documents or more share."""
    found = linededup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_W = "'[^\\x20\\x09-\\x0D]+'"
_TEXTS = f"""t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, {_W}) AS words FROM t)"""

OP8_SQL = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, doc_id, regexp_extract_all(text, {_W}) AS words FROM t),
s AS MATERIALIZED (SELECT DISTINCT row, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN ['short ' || len(words) || ' ' || array_to_string(words, ' ')] ELSE [] END) AS gram FROM w),
n AS MATERIALIZED (SELECT row, count(*) AS n FROM s GROUP BY row),
i AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.row <> b.row GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT row AS node, row AS other FROM t UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a),
g AS (SELECT node, min(t.doc_id) AS component_id FROM reach JOIN t ON t.row = other GROUP BY node)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM t JOIN g ON g.node = t.row LEFT JOIN n ON n.row = t.row
"""

OP9_SQL = f"""
WITH {_TEXTS},
p AS MATERIALIZED (SELECT row, pos, array_to_string(words[pos:pos + 34], ' ') AS passage FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS pos FROM w)),
again AS (SELECT row, pos FROM p JOIN (SELECT passage FROM p GROUP BY passage HAVING count(*) > 1) USING (passage)),
gone AS (SELECT DISTINCT row, pos + d AS pos FROM again, range(0, 35) r(d)),
every AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM every ANTI JOIN gone USING (row, pos) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (row)
"""

OP10_SQL = f"""
WITH {_TEXTS},
g AS (SELECT row, pos, array_to_string(words[pos:pos + 2], ' ') AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS pos FROM w)),
h AS (SELECT row, pos, count(*) OVER (PARTITION BY row, gram) AS n FROM g),
r AS (SELECT row, count(DISTINCT pos + d) AS n FROM h, range(0, 3) x(d) WHERE h.n > 1 GROUP BY row),
l AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row),
b AS (SELECT row, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0) AS lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '')) AS alpha
  FROM w LEFT JOIN l USING (row) LEFT JOIN r USING (row)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * upper > 4 * alpha OR 2 * n_dup_lines > lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept FROM f
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
x AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
t AS MATERIALIZED (SELECT row, doc_id, n, term, count(*) AS tf FROM x GROUP BY ALL),
s AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, big_n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
p AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY item_id, row)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM p WHERE score > 0
QUALIFY rank <= 10
"""

OP12_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k)),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
x AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
y AS (SELECT x.lang, x.phrase, x.k, a, cut, u.f AS l, v.f AS r, n, ((1000::HUGEINT * a * n) // (u.f::HUGEINT * v.f))::BIGINT AS score
  FROM x JOIN n USING (lang) JOIN f u ON u.lang = x.lang AND u.phrase = array_to_string(x.words[1:cut], ' ') JOIN f v ON v.lang = x.lang AND v.phrase = array_to_string(x.words[cut + 1:x.k], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = z.lang AND c.k > z.k AND 100 * c.a >= 100 * z.a AND contains(' ' || c.phrase || ' ', ' ' || z.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""

OP13_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM t),
k AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3),
j AS (SELECT row, pos, line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN s ON s.key = k.key),
o AS (SELECT row, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM j GROUP BY row)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM o JOIN t USING (row)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_mixing": op2_mixing,
        "op3_language_id": op3_language_id,
        "op4_media_columns": op4_media_columns,
        "op5_bpe": op5_bpe,
        "op6_pii": op6_pii,
        "op7_toxicity": op7_toxicity,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_lexical_search": op11_lexical_search,
        "op12_collocations": op12_collocations,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_mixing": mixing.draw_sql(), "op8_ngram_jaccard": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_collocations": OP12_SQL, "op13_line_dedup": OP13_SQL}
