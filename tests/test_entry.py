"""The driver's contract, and some queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.sources import readers

SF = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["revcomp", "dedupe_reads", "right_maximal_rc", "filter_rc", "pairs_after_filter", "components", "profile_positions", "rank_vector_ties", "nearest_centroid", "char_cumulative", "bwt_rle"])
def test_spark_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want


WHOLE = ["read_ids", "trim_n", "cut_ambiguous", "pairs_after_dedupe", "filter_rc", "kmer_spectrum", "components", "profile_positions", "pair_counts", "bwt"]


@pytest.mark.parametrize("name", [f"whole_{x}" for x in WHOLE])
def test_whole_texts_equal_sql(spark, name):
    test_spark_equals_sql(spark, name)


def test_whole_texts_lose_no_letter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(-2, "ab c"), (-1, "A" * 201), (None, "a1")], "doc_id long, text string"), allowMissingColumns=True)
    letters = docs.selectExpr("sum(length(regexp_replace(text, '[^A-Za-z]', '')))").first()[0]
    rows = readers.reads_of_texts(docs)
    assert rows.selectExpr("sum(length(seq))").first()[0] == letters
    assert [(r.i, len(r.seq)) for r in rows.where("doc_id = -1").orderBy("i").collect()] == [(0, 100), (1, 100), (2, 1)]
    assert {r.seq for r in rows.where("doc_id = -2 OR doc_id IS NULL").collect()} == {"ACG", "A"}


@pytest.mark.parametrize("name", [f"{w}{x}_all" for w in ("", "whole_") for x in ("kmer_counts", "canonical_counts", "right_maximal_rc")])
def test_all_kmers_equal_sql(spark, name):
    test_spark_equals_sql(spark, name)
    rows = entry.queries()[name](spark, SF)
    assert "right" in name or rows.where("n = 1").count() > 0
