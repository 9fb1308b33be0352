"""Registered queries of the sequence operators, with the same results as SQL for DuckDB.

Reads are derived from ``documents`` (``reads_of_texts``): pieces of 100 letters, and in
the queries named ``whole_...`` the shorter last piece of each text too. Distances and centres use ``embeddings`` in thousandths, as integers, so both engines agree exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import distance as D
from strandloom.functions import seq as S
from strandloom.operators import bwt, filtering, grouping, kmeans, order, profiles, traversal
from strandloom.operators import kmers as K
from strandloom.operators import reads as R
from strandloom.runtime import checkpoint, scratch, ship_package, spread, table
from strandloom.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Whether the reads of the query being built hold the shorter last pieces.
_REST: ContextVar[bool] = ContextVar("rest", default=False)

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _reads_sql(bases: str) -> str:
    return f"""
s AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{bases}') AS q FROM documents),
r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS q FROM s WHERE length(q) >= 100),
reads AS (SELECT doc_id, i, substr(q, i * 100 + 1, 100) AS seq FROM (SELECT doc_id, q, unnest(range(0, length(q) // 100)) AS i FROM r))"""


READS = _reads_sql("ACGTACGTACGTACGTACGTACGTAC")
RAW = _reads_sql("ACGTACGTACGTANGTACGTACGTAC")
WHOLE = {x: x.replace("WHERE length(q) >= 100", "WHERE length(q) >= 1").replace("length(q) // 100", "(length(q) + 99) // 100") for x in (READS, RAW)}
UNIQUE = READS + ",\nu AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS read_id FROM (SELECT DISTINCT seq FROM reads))"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _occ(k: int, source: str = "u", key: str = "read_id") -> str:
    return f"""
occ AS (SELECT {key}, p - 1 AS pos, substr(seq, p, {k}) AS kmer,
  CASE WHEN p + {k} <= length(seq) THEN substr(seq, p + {k}, 1) ELSE '$' END AS nxt,
  CASE WHEN p > 1 THEN substr(seq, p - 1, 1) ELSE '$' END AS prv
  FROM (SELECT {key}, seq, unnest(range(1, length(seq) - {k} + 2)) AS p FROM {source}))"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.reads_of_texts(_texts(spark, sf_dir), rest=_REST.get())


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.reads_of_texts(_texts(spark, sf_dir), keep_n=True, rest=_REST.get())


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_read_ids(_reads(spark, sf_dir).select("seq").distinct())


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``_unique`` for queries that need no read_id: no sort."""
    return _reads(spark, sf_dir).select("seq").distinct()


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(order.with_position(_reads(spark, sf_dir), "orig_rank", "doc_id", "i"))


def _with_rest(f: Query) -> Query:
    """The query over all letters of the texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _REST.set(True)
        try:
            return f(spark, sf_dir)
        finally:
            _REST.reset(token)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _per_read(name: str, column: Callable[[], dict], sql: str, raw: bool = False) -> None:
    """A query of doc_id, i and computed columns of every read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return (_raw if raw else _reads)(spark, sf_dir).select("doc_id", "i", *(c.alias(n) for n, c in column().items()))

    query(name, f"WITH {RAW if raw else READS} SELECT doc_id, i, {sql} FROM reads")(run)


# Scalar functions.
_per_read("revcomp", lambda: {"rc": S.reverse_complement("seq")}, f"{_rc('seq')} AS rc")
_per_read("reverse_reads", lambda: {"rev": F.reverse("seq")}, "reverse(seq) AS rev")
_per_read("complement", lambda: {"comp": S.complement("seq")}, "translate(seq, 'ACGT', 'TGCA') AS comp")
_per_read("canonical_reads", lambda: {"canon": S.canonical("seq")}, f"least(seq, {_rc('seq')}) AS canon")
_per_read("trim_n", lambda: {"trimmed": S.trim_n("seq")}, "regexp_replace(seq, '^[Nn]+|[Nn]+$', '', 'g') AS trimmed", raw=True)
_per_read("even_palindromes", lambda: {"cut": S.cut_even_palindrome("seq")}, f"CASE WHEN seq = {_rc('seq')} THEN substr(seq, 2) ELSE seq END AS cut")
_per_read("base_codes", lambda: {"codes": S.base_codes("seq")}, "translate(seq, '$ACGTN', '012345') AS codes", raw=True)


@query("valid_reads", f"WITH {RAW} SELECT doc_id, i, seq FROM reads WHERE regexp_full_match(seq, '[ACGT]+')")
def valid_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).where(S.is_valid("seq")).select("doc_id", "i", "seq")


@query("skip_ambiguous", f"WITH {RAW} SELECT doc_id, count(*) AS n FROM reads WHERE NOT regexp_matches(seq, '[^ACGT]') GROUP BY doc_id")
def skip_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).where(~F.col("seq").rlike("[^ACGT]")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("cut_ambiguous", f"WITH {RAW}, p AS (SELECT doc_id, i, unnest(string_split_regex(seq, '[^ACGT]+')) AS part FROM reads) SELECT doc_id, i, part FROM p WHERE length(part) >= 20")
def cut_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("doc_id", "i", F.explode(S.segments("seq", 20)).alias("part"))


@query("kmer_ranks", f"WITH {READS}, u AS (SELECT DISTINCT seq, 0 AS read_id FROM reads), {_occ(4)}, k AS (SELECT kmer, count(*) AS n FROM occ GROUP BY kmer) SELECT kmer, n, 1 + list_sum(list_transform(range(1, 5), lambda j: (strpos('ACGT', substr(kmer, j, 1)) - 1) * (4 ** (4 - j))))::BIGINT AS rank, kmer AS back, 1 + list_sum(list_transform(range(1, 5), lambda j: (strpos('TGCA', substr(kmer, j, 1)) - 1) * (4 ** (j - 1))))::BIGINT AS rc_rank FROM k")
def kmer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, unrank and the reverse complement of a rank of every 4-mer that occurs."""
    rows = _reads(spark, sf_dir).select("seq").distinct().withColumn("read_id", F.lit(0))
    found = K.counts(rows, 4).withColumn("rank", S.lex_rank("kmer"))
    return found.select("kmer", "n", "rank", S.unrank("rank", 4).alias("back"), (S.code_reverse_complement(F.col("rank") - 1, 4) + 1).alias("rc_rank"))


@query("canonical_numbers", "SELECT k::BIGINT AS k, CASE WHEN k % 2 = 1 THEN 4 ** k / 2 ELSE (4 ** k + 2 ** k) / 2 END::BIGINT AS n FROM range(1, 13) t(k)")
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 13).select(F.col("id").alias("k"), S.canonical_number("id").alias("n"))


_BY_K = "d AS (SELECT k, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS m FROM (SELECT k, substr(seq, p, k) AS m FROM (SELECT k, seq, unnest(range(1, length(seq) - k + 2)) AS p FROM reads, range(1, 8) r(k) WHERE length(seq) >= k)))"


@query("canonical_coverage", f"WITH {READS}, {_BY_K} SELECT k, count(DISTINCT m) AS present, CASE WHEN k % 2 = 1 THEN 4 ** k / 2 ELSE (4 ** k + 2 ** k) / 2 END::BIGINT AS possible FROM d GROUP BY k")
def canonical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the canonical k-mers there are for k from 1 to 7 occur in the reads."""
    found = K.windows(_reads(spark, sf_dir), 7).distinct()
    rows = found.select("m", F.explode(F.sequence(F.lit(1), F.length("m"))).alias("k"))
    present = rows.select("k", S.canonical(F.substring("m", F.lit(1), F.col("k"))).alias("m")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("present"))
    return present.select(F.col("k").cast("long").alias("k"), "present", S.canonical_number("k").alias("possible"))


@query("canonical_positions", f"WITH b AS (SELECT unnest(['A','C','G','T']) AS c), k AS (SELECT a.c || b.c || d.c || e.c AS kmer FROM b a, b b, b d, b e) SELECT row_number() OVER (ORDER BY kmer) - 1 AS idx, kmer FROM k WHERE kmer <= {_rc('kmer')}")
def canonical_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.canonical_positions(spark, 4).select(F.col("idx").cast("long").alias("idx"), "kmer")


@query("binary_codes", f"WITH {READS}, a AS (SELECT doc_id, i, 1 + list_sum(list_transform(range(1, 9), lambda j: (strpos('ACGT', substr(seq, j, 1)) - 1) * (4 ** (8 - j))))::BIGINT AS code FROM reads WHERE length(seq) >= 8) SELECT doc_id, i, lpad(bin(code), 20, '0') AS digits, code FROM a")
def binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of a read's first 8 bases as binary digits, and read back from them."""
    rows = _reads(spark, sf_dir).where("length(seq) >= 8").withColumn("digits", S.to_binary(S.lex_rank(F.substring("seq", 1, 8)), 20))
    return rows.select("doc_id", "i", "digits", S.from_binary("digits").alias("code"))


_WORDS = "list_transform(range(0, 4), lambda w: (list_sum(list_transform(range(1, 33), lambda j: (strpos('ACGT', substr(d, 32 * w + j, 1)) - 1)::HUGEINT * (4::HUGEINT ** (32 - j))::HUGEINT)))::HUGEINT)"


@query("packed_reads", f"WITH {READS}, p AS (SELECT doc_id, i, seq, lpad(seq, 128, 'A') AS d FROM reads), q AS (SELECT *, list_transform({_WORDS}, lambda x: CASE WHEN x >= 9223372036854775808::HUGEINT THEN x - 18446744073709551616::HUGEINT ELSE x END::BIGINT) AS words FROM p) SELECT doc_id, i, words[1] AS w0, words[2] AS w1, words[3] AS w2, words[4] AS w3, length(replace(seq, 'A', '')) AS nonzero, length(replace(substr(seq, 4), 'A', '')) AS shifted, list_sum(list_transform(range(1, length(seq) + 1), lambda j: CASE WHEN substr(seq, j, 1) <> substr({_rc('seq')}, j, 1) THEN 1 ELSE 0 END))::BIGINT AS differing, seq < {_rc('seq')} AS less FROM q")
def packed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in four words of two bits a base: the words, bases other than A, the same after 128 minus length plus 3 bases have left, bases that differ from the reverse complement, and the order of the two."""
    rows = _reads(spark, sf_dir).withColumns({"p": S.packed("seq"), "r": S.packed(S.reverse_complement("seq"))})
    cut = S.nonzero_bases(S.packed_shift("p", F.lit(131) - F.length("seq")))
    return rows.select(
        "doc_id", "i", *(F.col("p")[w].alias(f"w{w}") for w in range(4)), S.nonzero_bases("p").cast("long").alias("nonzero"),
        cut.cast("long").alias("shifted"),
        S.nonzero_bases(S.packed_xor("p", "r")).cast("long").alias("differing"), S.packed_less("p", "r").alias("less"),
    )


# Order, duplicates and pairs.
@query("distinct_reads", f"WITH {READS} SELECT DISTINCT seq FROM reads")
def distinct_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("seq").distinct()


@query("read_ids", f"WITH {UNIQUE} SELECT read_id, seq FROM u")
def read_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(spark, sf_dir).select("read_id", "seq")


_RANKED = READS + ", o AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) - 1 AS orig_rank FROM reads)"


@query("dedupe_reads", f"WITH {_RANKED} SELECT seq, max(orig_rank) AS orig_rank FROM o GROUP BY seq")
def dedupe_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedupe(_ranked(spark, sf_dir))


@query("dedupe_headers", f"WITH {READS} SELECT seq, min(doc_id || '_' || i) AS header FROM reads GROUP BY seq")
def dedupe_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedupe_by_header(_reads(spark, sf_dir).withColumn("header", F.concat_ws("_", "doc_id", "i"))).select("seq", "header")


@query("concatenated_reads", f"WITH {READS}, h AS (SELECT doc_id, i, '>' || doc_id || '_' || i AS header, seq FROM reads) SELECT doc_id, i, length(header) AS header_length, length(seq) AS read_length, coalesce(sum(length(header) + length(seq)) OVER (ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM h")
def concatenated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.concatenated(_reads(spark, sf_dir).withColumn("header", F.concat_ws("_", "doc_id", "i")), "doc_id", "i")
    return rows.select("doc_id", "i", F.col("header_length").cast("long").alias("header_length"), F.col("read_length").cast("long").alias("read_length"), "start")


@query("locate_reads", f"WITH {UNIQUE} SELECT seq, read_id AS position FROM u WHERE seq IN (SELECT {_rc('seq')} FROM u)")
def locate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the reverse complements of reads lie, of those that are reads too."""
    reads = _reads(spark, sf_dir).select("seq").distinct()
    return R.locate(reads, reads.select(S.reverse_complement("seq").alias("seq")))


@query("rlo_order", f"WITH {UNIQUE} SELECT read_id, row_number() OVER (ORDER BY reverse(seq)) - 1 AS position FROM u")
def rlo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reverse_lexicographic(_unique(spark, sf_dir)).select("read_id", "position")


@query("rclo_order", f"WITH {UNIQUE} SELECT read_id, row_number() OVER (ORDER BY {_rc('seq')}) - 1 AS position FROM u")
def rclo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reverse_complement_order(_unique(spark, sf_dir)).select("read_id", "position")


@query("rotate_reads", f"WITH {_RANKED} SELECT orig_rank, (orig_rank + 10) % (SELECT count(*) FROM o) AS position FROM o")
def rotate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rotate(_ranked(spark, sf_dir), 10, "orig_rank").select("orig_rank", "position")


@query("interleave", f"WITH {READS}, f AS (SELECT (doc_id % 2)::BIGINT AS file_no, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id, i) - 1 AS record_no, seq FROM reads) SELECT file_no, record_no, seq, row_number() OVER (ORDER BY record_no, file_no) - 1 AS position FROM f")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [order.with_position(_reads(spark, sf_dir).where(F.col("doc_id") % 2 == n), "record_no", "doc_id", "i") for n in (0, 1)]
    return order.with_position(R.interleave(*files), "position", "record_no", "file_no").select("file_no", "record_no", "seq", "position")


@query("strand_union", f"WITH {READS} SELECT doc_id, i, '+' AS strand, seq FROM reads UNION ALL SELECT doc_id, i, '-', {_rc('seq')} FROM reads")
def strand_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.both_strands(_reads(spark, sf_dir)).select("doc_id", "i", "strand", "seq")


def _mates(ranked: DataFrame) -> DataFrame:
    a = ranked.where("i % 2 = 0").select("doc_id", F.col("i").alias("j"), F.col("orig_rank").alias("r1"))
    b = ranked.where("i % 2 = 1").select("doc_id", (F.col("i") - 1).alias("j"), F.col("orig_rank").alias("r2"))
    return a.join(b, ["doc_id", "j"]).select("r1", "r2")


_PAIRS = (
    _RANKED
    + """, d AS (SELECT seq, max(orig_rank) AS orig_rank FROM o GROUP BY seq), u AS (SELECT seq, orig_rank, row_number() OVER (ORDER BY seq) - 1 AS read_id FROM d),
m AS (SELECT a.orig_rank AS r1, b.orig_rank AS r2 FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.i % 2 = 0 AND b.i = a.i + 1),
pairs AS (SELECT x.read_id AS r1, y.read_id AS r2 FROM m JOIN u x ON m.r1 = x.orig_rank JOIN u y ON m.r2 = y.orig_rank)"""
)


@query("pairs_after_dedupe", f"WITH {_PAIRS} SELECT r1, r2 FROM pairs")
def pairs_after_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir)
    return R.remap_pairs(_mates(ranked), R.with_read_ids(R.dedupe(ranked)), "orig_rank", "read_id")


def _good_sql(k: int, tau: int) -> str:
    return f"""
{_occ(k)},
st AS (SELECT kmer AS w, nxt AS c, 1 AS f, 0 AS b FROM occ UNION ALL SELECT {_rc('kmer')}, translate(prv, 'ACGT', 'TGCA'), 0, 1 FROM occ),
rm AS (SELECT w, CASE WHEN w = {_rc('w')} THEN sum(f) ELSE sum(f) + sum(b) END::BIGINT AS n FROM st GROUP BY w
  HAVING sum(f) > 0 AND (count(DISTINCT c) >= 2 OR (CASE WHEN w = {_rc('w')} THEN sum(f) ELSE sum(f) + sum(b) END >= 2 AND bool_or(c = '$')))),
gk AS (SELECT w FROM rm WHERE n >= {tau} UNION SELECT {_rc('w')} FROM rm WHERE n >= {tau}),
good AS (SELECT DISTINCT read_id FROM occ WHERE kmer IN (SELECT w FROM gk))"""


@query("filter_rc", f"WITH {UNIQUE}, {_good_sql(16, 4)} SELECT u.read_id, u.seq FROM u JOIN good USING (read_id)")
def filter_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.good_and_bad(_unique(spark, sf_dir))[0].select("read_id", "seq")


@query("filter_bad", f"WITH {UNIQUE}, {_good_sql(16, 4)} SELECT u.read_id, u.seq FROM u ANTI JOIN good USING (read_id)")
def filter_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.good_and_bad(_unique(spark, sf_dir))[1].select("read_id", "seq")


@query("filter_fwd", f"WITH {UNIQUE}, {_occ(16)}, g AS (SELECT kmer FROM occ GROUP BY kmer HAVING count(*) >= 4) SELECT DISTINCT read_id FROM occ WHERE kmer IN (SELECT kmer FROM g)")
def filter_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.frequent_forward(_unique(spark, sf_dir))


@query("pairs_after_filter", f"WITH {_PAIRS}, {_good_sql(16, 4)}, n AS (SELECT read_id, row_number() OVER (ORDER BY seq) - 1 AS new_id FROM u JOIN good USING (read_id)) SELECT x.new_id AS r1, y.new_id AS r2 FROM pairs JOIN n x ON pairs.r1 = x.read_id JOIN n y ON pairs.r2 = y.read_id")
def pairs_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir)
    unique = checkpoint(R.with_read_ids(R.dedupe(ranked)))
    pairs = R.remap_pairs(_mates(ranked), unique, "orig_rank", "read_id")
    good, _ = filtering.good_and_bad(unique.select("read_id", "seq"))
    return R.remap_pairs(pairs, R.with_read_ids(good.select(F.col("read_id").alias("old_id"), "seq")), "old_id", "read_id")


@query("marked_runs", f"WITH {UNIQUE}, {_occ(16)}, g AS (SELECT kmer FROM occ GROUP BY kmer HAVING count(*) >= 4), p AS (SELECT read_id, pos FROM occ WHERE kmer IN (SELECT kmer FROM g)), q AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY read_id ORDER BY pos) > 16 THEN 1 ELSE 0 END AS o FROM p), z AS (SELECT read_id, pos, sum(o) OVER (PARTITION BY read_id ORDER BY pos) AS run FROM q) SELECT read_id, min(pos) AS start, max(pos) + 16 - min(pos) AS length FROM z GROUP BY read_id, run HAVING max(pos) + 16 - min(pos) >= 30")
def marked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.marked_runs(_unique(spark, sf_dir), 16, 4, 30)


# k-mers.
@query("kmer_spectrum", f"WITH {UNIQUE}, {_occ(16)}, c AS (SELECT kmer, count(*) AS n FROM occ GROUP BY kmer) SELECT n, count(*) AS kmers FROM c GROUP BY n")
def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counts(_distinct(spark, sf_dir), 16).groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))


@query("kmer_counts", f"WITH {UNIQUE}, {_occ(16)} SELECT kmer, count(*) AS n FROM occ GROUP BY kmer HAVING count(*) >= 2")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated k-mers; ``kmer_counts_all`` has the others too."""
    return K.counts(_distinct(spark, sf_dir), 16, 2)


@query("canonical_counts", f"WITH {UNIQUE}, {_occ(16)} SELECT least(kmer, {_rc('kmer')}) AS kmer, count(*) AS n FROM occ GROUP BY 1 HAVING count(*) >= 2")
def canonical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.canonical_counts(_distinct(spark, sf_dir), 16, 2)


@query("kmer_counts_all", f"WITH {UNIQUE}, {_occ(16)} SELECT kmer, count(*) AS n FROM occ GROUP BY kmer")
def kmer_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counts(_distinct(spark, sf_dir), 16)


@query("canonical_counts_all", f"WITH {UNIQUE}, {_occ(16)} SELECT least(kmer, {_rc('kmer')}) AS kmer, count(*) AS n FROM occ GROUP BY 1")
def canonical_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.canonical_counts(_distinct(spark, sf_dir), 16)


@query("neighbour_symbols", f"WITH {UNIQUE}, {_occ(8)} SELECT kmer, count(*) AS n, count(DISTINCT nxt) AS nexts, count(DISTINCT prv) AS prevs FROM occ GROUP BY kmer")
def neighbour_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.neighbourhoods(_distinct(spark, sf_dir), 8)
    return found.select("kmer", "n", F.bit_count("nexts").cast("long").alias("nexts"), F.bit_count("prevs").cast("long").alias("prevs"))


@query("right_maximal", f"WITH {UNIQUE}, {_occ(16)} SELECT kmer, count(*) AS n FROM occ GROUP BY kmer HAVING count(DISTINCT nxt) >= 2 OR (count(*) >= 2 AND bool_or(nxt = '$'))")
def right_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.right_maximal(_distinct(spark, sf_dir), 16)


@query("left_maximal", f"WITH {UNIQUE}, {_occ(16)} SELECT kmer, count(*) AS n FROM occ GROUP BY kmer HAVING count(DISTINCT prv) >= 2 OR (count(*) >= 2 AND bool_or(prv = '$'))")
def left_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.left_maximal(_distinct(spark, sf_dir), 16)


@query("right_maximal_rc", f"WITH {UNIQUE}, {_good_sql(16, 2)} SELECT w AS kmer, n FROM rm WHERE n >= 2")
def right_maximal_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.right_maximal_both(_distinct(spark, sf_dir), 16).where("n >= 2")


@query("right_maximal_rc_all", f"WITH {UNIQUE}, {_good_sql(16, 2)} SELECT w AS kmer, n FROM rm")
def right_maximal_rc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With those that are their own reverse complement and occur once."""
    return K.right_maximal_both(_distinct(spark, sf_dir), 16)


@query("supermaximal", f"WITH {UNIQUE}, {_occ(8)} SELECT kmer, count(*) AS n FROM occ GROUP BY kmer HAVING count(*) = count(DISTINCT nxt) AND count(*) = count(DISTINCT prv)")
def supermaximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.supermaximal(_distinct(spark, sf_dir), 8)


@query("extension_counts", f"WITH {UNIQUE}, {_occ(6)} SELECT kmer, nxt AS next, count(*) AS n FROM occ GROUP BY kmer, nxt")
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.extension_counts(_unique(spark, sf_dir), 6)


@query("left_extension_counts", f"WITH {UNIQUE}, {_occ(6)} SELECT kmer, prv AS prev, count(*) AS n FROM occ GROUP BY kmer, prv")
def left_extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.left_extension_counts(_unique(spark, sf_dir), 6)


@query("submaximal", f"WITH {UNIQUE}, {_occ(16)}, m AS MATERIALIZED (SELECT kmer, count(*) AS n FROM occ GROUP BY kmer HAVING count(*) >= 2 AND (count(DISTINCT nxt) >= 2 OR bool_or(nxt = '$'))), o AS (SELECT read_id, pos, kmer, n, lag(pos) OVER (PARTITION BY read_id ORDER BY pos) AS before FROM occ JOIN m USING (kmer)), b AS (SELECT kmer, n, CASE WHEN before IS NOT NULL THEN substr(seq, before + 1, pos - before) END AS gap FROM o JOIN u USING (read_id)) SELECT kmer, n FROM b GROUP BY kmer, n HAVING count(gap) < n OR count(DISTINCT gap) > 1")
def submaximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.submaximal(_unique(spark, sf_dir), 16)


@query("suffix_tree_nodes", f"WITH {UNIQUE} " + " UNION ALL ".join(f"SELECT * FROM (WITH {_occ(k)} SELECT {k} AS depth, kmer, count(*) AS n FROM occ GROUP BY kmer HAVING count(DISTINCT nxt) >= 2 OR (count(*) >= 2 AND bool_or(nxt = '$')))" for k in (3, 4, 5)))
def suffix_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.suffix_tree_nodes(checkpoint(_unique(spark, sf_dir)), range(3, 6)).select("depth", "kmer", "n")


_SYMBOLS = UNIQUE + ", sy AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS ch FROM u) GROUP BY ch UNION ALL SELECT '$', count(*) FROM u)"


@query("symbol_histogram", f"WITH {_SYMBOLS} SELECT ch, n FROM sy")
def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.symbols(_unique(spark, sf_dir))


@query("char_cumulative", f"WITH {_SYMBOLS} SELECT ch, n, coalesce(sum(n) OVER (ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS smaller FROM sy")
def char_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cumulative(checkpoint(K.symbols(_unique(spark, sf_dir))))


@query("alphabet", f"WITH {UNIQUE} SELECT DISTINCT unnest(string_split(seq, '')) AS ch FROM u")
def alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(spark, sf_dir).select(F.explode(F.split("seq", "")).alias("ch")).where("ch <> ''").distinct()


@query("pair_counts", f"WITH {READS}, a AS (SELECT doc_id, substr(seq, 1, 6) AS x, substr(seq, 95, 6) AS y FROM reads) SELECT x, y, count(*) AS n FROM a GROUP BY x, y")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a first 6-mer and a last 6-mer meet in a read: the sparse pair matrix."""
    rows = _reads(spark, sf_dir).select(F.substring("seq", 1, 6).alias("x"), F.substring("seq", 95, 6).alias("y"))
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


# Groups.
_STAR = "h AS (SELECT DISTINCT read_id, kmer FROM occ), e AS (SELECT DISTINCT rep, read_id FROM (SELECT min(read_id) OVER (PARTITION BY kmer) AS rep, read_id FROM h) WHERE rep <> read_id)"
_STAR_RC = _STAR.replace("SELECT DISTINCT read_id, kmer FROM occ", f"SELECT DISTINCT read_id, least(kmer, {_rc('kmer')}) AS kmer FROM occ")
_COMP = """both_ways AS (SELECT rep AS a, read_id AS b FROM e UNION SELECT read_id, rep FROM e),
reach AS (SELECT read_id AS node, read_id AS other FROM u UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
comp AS (SELECT node AS read_id, min(other) AS comp FROM reach GROUP BY node)"""


@query("kmer_star_edges", f"WITH {UNIQUE}, {_occ(36)}, {_STAR} SELECT rep, read_id FROM e")
def kmer_star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.star_edges(_unique(spark, sf_dir), 36)


@query("rc_kmer_pairs", f"WITH {UNIQUE}, {_occ(16)}, c AS MATERIALIZED (SELECT kmer, {_rc('kmer')} AS rc, count(*) AS n FROM occ GROUP BY kmer), l AS MATERIALIZED (SELECT kmer, rc, n FROM c WHERE kmer < rc), g AS MATERIALIZED (SELECT kmer, n FROM c WHERE kmer > rc) SELECT l.kmer, g.kmer AS rc, l.n, g.n AS n_rc FROM l JOIN g ON g.kmer = l.rc")
def rc_kmer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.strand_kmer_pairs(_distinct(spark, sf_dir), 16)


@query("components", f"WITH RECURSIVE {UNIQUE}, {_occ(36)}, {_STAR}, {_COMP} SELECT read_id, comp FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.components(_unique(spark, sf_dir), 36)


@query("submaximal_components", f"WITH RECURSIVE {UNIQUE}, {_occ(36)}, {_STAR}, {_COMP} SELECT read_id, comp FROM comp")
def submaximal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups from k-submaximal repeats, which are the components over all k-mers."""
    return grouping.submaximal_components(_unique(spark, sf_dir), 36)


@query("components_rc", f"WITH RECURSIVE {UNIQUE}, {_occ(36)}, {_STAR_RC}, {_COMP} SELECT read_id, comp FROM comp")
def components_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.components(_unique(spark, sf_dir), 36, both_strands=True)


@query("group_sizes", f"WITH RECURSIVE {UNIQUE}, {_occ(36)}, {_STAR_RC}, {_COMP} SELECT comp, count(*) AS size FROM comp GROUP BY comp")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.sizes(components_rc(spark, sf_dir))


@query("size_filtered_groups", f"WITH RECURSIVE {UNIQUE}, {_occ(36)}, {_STAR_RC}, {_COMP} SELECT read_id, comp FROM comp WHERE comp IN (SELECT comp FROM comp GROUP BY comp HAVING count(*) >= 5)")
def size_filtered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.large_groups(checkpoint(components_rc(spark, sf_dir)), 5)


@query("group_stats", f"WITH RECURSIVE {UNIQUE}, {_occ(36)}, {_STAR_RC}, {_COMP}, z AS (SELECT comp, count(*) AS size FROM comp GROUP BY comp) SELECT count(*) AS groups, count(*) FILTER (WHERE size >= 5) AS large_groups, sum(size)::BIGINT AS reads, coalesce(sum(size) FILTER (WHERE size >= 5), 0)::BIGINT AS kept_reads FROM z")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.statistics(components_rc(spark, sf_dir), 5)


@query("capped_groups")
@_with_rest
def capped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent, so beyond SQL; tests hold it against a sequential model."""
    ship_package(spark)
    return grouping.capped_groups(_unique(spark, sf_dir).select("read_id", "seq"), 36, 10)


# Profiles: the reads of a document are one cluster.
def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select(F.col("doc_id").alias("cluster_id"), F.col("i").alias("seq_no"), "seq")


_FREQ = READS + "," + _occ(16, "reads", "doc_id, i") + ", fw AS (SELECT doc_id, kmer FROM occ GROUP BY doc_id, kmer HAVING count(*) >= 2)"
_DISTINCT = f"{_FREQ}, pr AS (SELECT doc_id AS cluster_id, least(x, {_rc('x')}) AS kmer, count(*) AS n FROM (SELECT doc_id, substr(kmer, p, 4) AS x FROM (SELECT doc_id, kmer, unnest(range(1, 14)) AS p FROM fw)) GROUP BY ALL)"


@query("profile_distinct", f"WITH {_DISTINCT} SELECT cluster_id, kmer, n FROM pr")
def profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.by_distinct_windows(_clusters(spark, sf_dir))


_POSITIONS = f"""{_FREQ}, pl AS (SELECT DISTINCT doc_id, i, pos + d AS at, substr(kmer, d + 1, 4) AS kmer FROM (SELECT occ.doc_id, i, pos, occ.kmer, unnest(range(0, 13)) AS d FROM occ JOIN fw ON occ.doc_id = fw.doc_id AND occ.kmer = fw.kmer)),
one AS (SELECT doc_id AS cluster_id, kmer, count(*) AS n FROM pl GROUP BY ALL),
po AS (SELECT cluster_id, kmer, sum(n)::BIGINT AS n FROM (SELECT * FROM one UNION ALL SELECT cluster_id, {_rc('kmer')}, n FROM one) GROUP BY ALL)"""


@query("profile_positions", f"WITH {_POSITIONS} SELECT cluster_id, kmer, n FROM po")
def profile_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.by_covered_positions(_clusters(spark, sf_dir))


@query("rc_collapse", f"WITH {_POSITIONS} SELECT cluster_id, least(kmer, {_rc('kmer')}) AS kmer, sum(n)::BIGINT AS n FROM po GROUP BY ALL")
def rc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.collapse(profile_positions(spark, sf_dir))


_DENSE = (
    _DISTINCT
    + f", bb AS (SELECT unnest(['A','C','G','T']) AS c), cp AS (SELECT row_number() OVER (ORDER BY kmer) - 1 AS idx, kmer FROM (SELECT w.c || x.c || y.c || z.c AS kmer FROM bb w, bb x, bb y, bb z) WHERE kmer <= {_rc('kmer')}), de AS (SELECT i.cluster_id, cp.idx, coalesce(pr.n, 0) AS n FROM (SELECT DISTINCT cluster_id FROM pr) i CROSS JOIN cp LEFT JOIN pr ON pr.cluster_id = i.cluster_id AND pr.kmer = cp.kmer)"
)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.dense(profile_distinct(spark, sf_dir), 4)


@query("profile_shares", f"WITH {_DENSE} SELECT cluster_id, idx, round(n / sum(n) OVER (PARTITION BY cluster_id), 9) AS share FROM de")
def profile_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.shares(_dense(spark, sf_dir)).select("cluster_id", F.col("idx").cast("long").alias("idx"), F.round("share", 9).alias("share"))


@query("rank_vector", f"WITH {_DENSE} SELECT cluster_id, idx, row_number() OVER (PARTITION BY cluster_id ORDER BY n, idx) - 1 AS rank FROM de")
def rank_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.ranks(_dense(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long"))


@query("rank_vector_ties", f"WITH {_DENSE} SELECT cluster_id, idx, rank() OVER (PARTITION BY cluster_id ORDER BY n) - 1 AS rank FROM de")
def rank_vector_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.ranks(_dense(spark, sf_dir), ties="shared").withColumn("idx", F.col("idx").cast("long"))


@query("rank_vector_swaps")
def rank_vector_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``rank_vector``, ties in the order that the swaps of a selection sort leave them in."""
    rows = profiles.vectors(_dense(spark, sf_dir), "n").select("cluster_id", F.posexplode(kmeans.swap_rank_array("v")).alias("idx", "rank"))
    return rows.select("cluster_id", F.col("idx").cast("long").alias("idx"), F.col("rank").cast("long").alias("rank"))


# Distances and centres over embeddings in thousandths.
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", v.alias("v"))


_VECTORS = """e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT) AS v FROM embeddings),
c AS (SELECT id AS cid, v AS cv FROM e WHERE id < 4)"""


def _against(name: str, of: Callable, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _points(spark, sf_dir)
        centres = rows.where("id < 4").select(F.col("id").alias("cid"), F.col("v").alias("cv"))
        return rows.join(F.broadcast(centres)).select("id", "cid", F.round(of("v", "cv"), 4).alias("dist"))

    query(name, f"WITH {_VECTORS} SELECT id, cid, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: {sql}))::DOUBLE, 4) AS dist FROM e, c")(run)


_against("dist_l1", D.l1, "abs(v[i] - cv[i])")
_against("dist_sqeuclid", D.squared_euclid, "(v[i] - cv[i]) * (v[i] - cv[i])")
_against("dist_root2", lambda a, b: D.root_sum(a, b, 2), "pow(abs(v[i] - cv[i]), 1.0 / 2)")
_against("dist_root3", lambda a, b: D.root_sum(a, b, 3), "pow(abs(v[i] - cv[i]), 1.0::DOUBLE / 3)")
_against("dist_root4", lambda a, b: D.root_sum(a, b, 4), "pow(abs(v[i] - cv[i]), 1.0 / 4)")

_LONG = f"{_VECTORS}, l AS (SELECT id, label, unnest(v) AS x, unnest(range(0, len(v))) AS idx FROM e)"
_RANKS = f"{_LONG}, k AS (SELECT id, label, x, idx, row_number() OVER (PARTITION BY id ORDER BY x, idx) - 1 AS r, rank() OVER (PARTITION BY id ORDER BY x) - 1 AS s FROM l)"


def _footrule(name: str, ranks: Callable, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = checkpoint(_points(spark, sf_dir).select("id", ranks("v").alias("r")))
        centres = rows.where("id < 4").select(F.col("id").alias("cid"), F.col("r").alias("cr"))
        return rows.join(F.broadcast(centres)).select("id", "cid", D.footrule("r", "cr").cast("long").alias("dist"))

    query(name, f"WITH {_RANKS} SELECT a.id, b.id AS cid, sum(abs(a.{column} - b.{column}))::BIGINT AS dist FROM k a JOIN k b ON a.idx = b.idx AND b.id < 4 GROUP BY ALL")(run)


_footrule("dist_footrule", kmeans.rank_array, "r")
_footrule("dist_footrule_ties", kmeans.shared_rank_array, "s")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = checkpoint(_points(spark, sf_dir).withColumn("ranks", kmeans.rank_array("v")))
    centres = [r["ranks"] for r in points.where("id < 8").orderBy("id").select("ranks").collect()]
    return kmeans.nearest(points, centres)


_NEAREST = f"""{_RANKS}, d AS (SELECT a.id, b.id AS cid, sum(abs(a.r - b.r))::BIGINT AS dist FROM k a JOIN k b ON a.idx = b.idx AND b.id < 8 GROUP BY ALL),
n AS (SELECT id, cid AS cluster, dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS o FROM d) WHERE o = 1)"""


@query("nearest_centroid", f"WITH {_NEAREST} SELECT id, cluster::BIGINT AS cluster, dist FROM n")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("id", F.col("cluster").cast("long").alias("cluster"), F.col("dist").cast("long").alias("dist"))


@query("centroid_update", f"WITH {_NEAREST} SELECT cluster::BIGINT AS cluster, idx, round(sum(x) / count(*), 6) AS value FROM n JOIN l USING (id) GROUP BY cluster, idx")
def centroid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assigned(spark, sf_dir).select("cluster", F.posexplode("v").alias("idx", "x"))
    means = rows.groupBy("cluster", "idx").agg((F.sum("x") / F.count(F.lit(1))).alias("value"))
    return means.select(F.col("cluster").cast("long").alias("cluster"), F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value"))


@query("centroid_truncated", f"WITH {_NEAREST} SELECT cluster::BIGINT AS cluster, idx, (sum(x)::BIGINT // count(*))::BIGINT AS value FROM (SELECT n.cluster, idx, x + 1000000 AS x FROM n JOIN l USING (id)) GROUP BY cluster, idx")
def centroid_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole parts of means; values are shifted to be positive, as counts are."""
    rows = _assigned(spark, sf_dir).withColumn("counts", F.transform("v", lambda x: x + 1_000_000))
    return kmeans.truncated_centroids(rows).select(F.col("cluster").cast("long").alias("cluster"), F.col("idx").cast("long").alias("idx"), "value")


@query("cluster_distances", f"WITH {_NEAREST} SELECT cluster::BIGINT AS cluster, count(*) AS n, round(avg(dist), 4) AS mean, round(coalesce(stddev_samp(dist), 0), 4) AS sd FROM n GROUP BY cluster")
def cluster_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.distance_statistics(_assigned(spark, sf_dir))
    return found.select(F.col("cluster").cast("long").alias("cluster"), "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("outliers", f"WITH {_NEAREST}, z AS (SELECT cluster, avg(dist) AS m, coalesce(stddev_samp(dist), 0) AS s FROM n GROUP BY cluster) SELECT id, n.cluster::BIGINT AS cluster, dist FROM n JOIN z USING (cluster) WHERE dist > m + 2 * s")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.outliers(checkpoint(_assigned(spark, sf_dir).select("id", "cluster", "dist")))
    return found.select("id", F.col("cluster").cast("long").alias("cluster"), F.col("dist").cast("long").alias("dist"))


@query("outliers_one_deviation", f"WITH {_NEAREST}, z AS (SELECT cluster, avg(dist) AS m, coalesce(stddev_samp(dist), 0) AS s FROM n GROUP BY cluster) SELECT id, n.cluster::BIGINT AS cluster, dist FROM n JOIN z USING (cluster) WHERE dist > m + s")
def outliers_one_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``outliers``, one deviation from the mean instead of two."""
    found = kmeans.outliers(checkpoint(_assigned(spark, sf_dir).select("id", "cluster", "dist")), deviations=1.0)
    return found.select("id", F.col("cluster").cast("long").alias("cluster"), F.col("dist").cast("long").alias("dist"))


@query("inter_cluster_distances", f"WITH {_RANKS} SELECT a.id AS i, b.id AS j, sum(abs(a.r - b.r))::BIGINT AS dist FROM k a JOIN k b ON a.idx = b.idx AND a.id < b.id AND b.id < 8 GROUP BY ALL")
def inter_cluster_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = [r["v"] for r in _points(spark, sf_dir).where("id < 8").orderBy("id").collect()]
    rows = [(i, j, int(d)) for (i, j), d in kmeans.centre_distances(centres).items()]
    return spark.createDataFrame(rows, "i long, j long, dist long")


@query("centroid_distances", f"WITH {_NEAREST}, ce AS (SELECT cluster, idx, sum(x) / count(*) AS value FROM n JOIN l USING (id) GROUP BY cluster, idx), cr AS (SELECT cluster, idx, row_number() OVER (PARTITION BY cluster ORDER BY value, idx) - 1 AS r FROM ce) SELECT a.cluster::BIGINT AS i, b.cluster::BIGINT AS j, sum(abs(a.r - b.r))::BIGINT AS dist FROM cr a JOIN cr b ON a.idx = b.idx AND a.cluster < b.cluster GROUP BY ALL")
def centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the centres that all points' assignment gives; centres are few by definition."""
    centres = kmeans.centroids(_assigned(spark, sf_dir).withColumnRenamed("v", "profile"), _dimensions(spark, sf_dir))
    ids = sorted(centres)
    rows = [(ids[i], ids[j], int(d)) for (i, j), d in kmeans.centre_distances([centres[c] for c in ids]).items()]
    return spark.createDataFrame(rows, "i long, j long, dist long")


def _dimensions(spark: SparkSession, sf_dir: str) -> int:
    return _points(spark, sf_dir).select(F.size("v")).first()[0]


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", F.transform("v", lambda x: x.cast("double")).alias("profile"))


@query("kmeans")
def kmeans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.kmeans(_profiles(spark, sf_dir)).assignment


@query("adaptive_kmeans")
def adaptive_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.adaptive(_profiles(spark, sf_dir))


# Index.
_BWT = f"""{UNIQUE}, sf AS (SELECT read_id, substr(seq, p) || '$' AS suffix, CASE WHEN p > 1 THEN substr(seq, p - 1, 1) ELSE '$' END AS ch FROM (SELECT read_id, seq, unnest(range(1, length(seq) + 2)) AS p FROM u)),
bw AS (SELECT row_number() OVER (ORDER BY suffix, read_id) - 1 AS pos, ch, read_id FROM sf)"""


@query("bwt", f"WITH {_BWT} SELECT pos, ch, read_id FROM bw")
def bwt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.transform(checkpoint(_unique(spark, sf_dir)))


@query("bwt_rle", f"WITH {_BWT}, g AS (SELECT *, coalesce(lag(ch) OVER (ORDER BY pos) <> ch, true) AS o FROM bw), q AS (SELECT *, sum(o::INT) OVER (ORDER BY pos) AS run FROM g) SELECT min(pos) AS start, min(ch) AS ch, count(*) AS length FROM q GROUP BY run")
def bwt_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.runs_of_reads(checkpoint(_unique(spark, sf_dir)))


@query("saved_index", f"WITH {_BWT} SELECT pos, ch FROM bw")
def saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform, saved as runs, restored and expanded."""
    path = scratch(spark, "index")
    runs, in_order = bwt.ordered_runs(checkpoint(_unique(spark, sf_dir)))
    writers.index(runs, path, in_order)
    return bwt.expand(readers.index(spark, path))


@query("bwt_rank", f"WITH {_BWT} SELECT pos, ch, row_number() OVER (PARTITION BY ch ORDER BY pos) - 1 AS rank FROM bw")
def bwt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.ranks_of_reads(checkpoint(_unique(spark, sf_dir)))


@query("pattern_counts", f"WITH {UNIQUE}, pt AS (SELECT DISTINCT substr(seq, 1, 10) AS pattern FROM u), hit AS (SELECT substr(seq, p, 10) AS pattern FROM (SELECT seq, unnest(range(1, length(seq) - 8)) AS p FROM u WHERE length(seq) >= 10)) SELECT pattern, count(*) AS n FROM pt JOIN hit USING (pattern) WHERE length(pattern) = 10 GROUP BY pattern")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the first ten letters of each read occur in all reads, by backward search."""
    unique = checkpoint(_unique(spark, sf_dir))
    index = checkpoint(bwt.index_of_reads(unique))
    wanted = unique.select(F.substring("seq", 1, 10).alias("pattern")).where(F.length("pattern") == 10)
    return bwt.find_patterns(index, wanted).select("pattern", (F.col("high") - F.col("low")).alias("n"))


# Texts are whole, so this has no twin.
_NODES = f"""{WHOLE[READS]},
u AS (SELECT DISTINCT seq FROM reads),
sf AS (SELECT substr(seq, p) AS suffix FROM (SELECT seq, unnest(range(1, length(seq) + 2)) AS p FROM u)),
nb AS (SELECT suffix, lag(suffix) OVER (ORDER BY suffix) AS before FROM sf),
lc AS (SELECT suffix, len(list_filter(range(1, least(length(suffix), length(before)) + 1), lambda k: substr(suffix, 1, k) = substr(before, 1, k))) AS depth FROM nb WHERE before IS NOT NULL),
w AS (SELECT DISTINCT depth, substr(suffix, 1, depth) AS word FROM lc),
x AS (SELECT depth, substr(suffix, 1, depth) AS word FROM (SELECT suffix, unnest(range(0, length(suffix) + 1)) AS depth FROM sf))"""


@query("right_maximal_strings", f"WITH {_NODES} SELECT word, depth, count(*) AS n FROM x JOIN w USING (depth, word) GROUP BY word, depth")
def right_maximal_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every right-maximal string of the distinct reads of whole texts, of every length from 0 on."""
    reads = R.with_read_ids(readers.reads_of_texts(_texts(spark, sf_dir)).select("seq").distinct())
    return traversal.right_maximal_strings(reads).select("word", F.col("depth").cast("long").alias("depth"), "n")


# Every query with SQL over reads, over the whole texts.
for _name, _sql in list(_SQL.items()):
    for _cut, _all in WHOLE.items():
        if _cut in _sql:
            query(f"whole_{_name}", _sql.replace(_cut, _all))(_with_rest(_QUERIES[_name]))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
