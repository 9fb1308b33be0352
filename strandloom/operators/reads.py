"""Sorting, deduplication and numbering of reads, and their mate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators.order import with_position


def dedupe(reads: DataFrame, rank: str = "orig_rank") -> DataFrame:
    """seq and the largest original rank of each distinct sequence: of duplicates the last survives."""
    return reads.groupBy("seq").agg(F.max(rank).alias(rank))


def dedupe_by_header(reads: DataFrame) -> DataFrame:
    """Each distinct sequence with its smallest header."""
    return reads.groupBy("seq").agg(F.min("header").alias("header"))


def with_read_ids(reads: DataFrame) -> DataFrame:
    """Distinct sequences with read_id, their rank in lexicographic order from 0."""
    return with_position(reads, "read_id", "seq")


def remap_pairs(pairs: DataFrame, ids: DataFrame, old: str, new: str) -> DataFrame:
    """Pairs in new ids; a pair goes if either mate is gone."""
    a = ids.select(F.col(old).alias("r1"), F.col(new).alias("n1"))
    b = ids.select(F.col(old).alias("r2"), F.col(new).alias("n2"))
    return pairs.join(a, "r1").join(b, "r2").select(F.col("n1").alias("r1"), F.col("n2").alias("r2"))


def consecutive_pairs(reads: DataFrame, number: str = "record_no", valid: str = "valid_rank", place: str | None = None) -> DataFrame:
    """Pairs of records 2j and 2j+1, by their ranks among valid reads, where both are valid.

    With ``place``, a column of places among all records, the two must also stand side by side.
    """
    at = F.col(place) if place else F.col(number)
    first = reads.where(F.col(number) % 2 == 0).select(F.col(number).alias("n"), F.col(valid).alias("r1"), (at + 1).alias("p"))
    second = reads.where(F.col(number) % 2 == 1).select((F.col(number) - 1).alias("n"), F.col(valid).alias("r2"), at.alias("p"))
    return first.join(second, ["n", "p"]).where("r1 IS NOT NULL AND r2 IS NOT NULL").select("r1", "r2")


def concatenated(records: DataFrame, *keys: str) -> DataFrame:
    """header_length, read_length and start of each record (header, seq) in the text of all records, header lines with their mark, one after the other."""
    rows = records.withColumns({"header_length": F.length("header") + 1, "read_length": F.length("seq")}).withColumn("_size", F.col("header_length") + F.col("read_length"))
    return with_position(rows, "record_no", *keys, sums={"start": "_size"}).drop("_size")


def locate(reads: DataFrame, wanted: DataFrame) -> DataFrame:
    """seq and position of ``wanted`` sequences among ``reads`` in lexicographic order, where each row of the index that a read opens lies.

    A wanted sequence that is not there has no row; one that is there twice is an error.
    """
    found = with_read_ids(reads.groupBy("seq").agg(F.count(F.lit(1)).alias("copies"))).join(wanted.select("seq").distinct(), "seq")
    single = F.when(F.col("copies") == 1, F.col("read_id")).otherwise(F.raise_error(F.concat(F.lit("duplicate read in data: "), "seq")).cast("long"))
    return found.select("seq", single.alias("position"))


def reverse_lexicographic(reads: DataFrame, name: str = "position") -> DataFrame:
    """Positions in the order of reversed sequences."""
    return with_position(reads.withColumn("_key", F.reverse("seq")), name, "_key", "seq").drop("_key")


def reverse_complement_order(reads: DataFrame, name: str = "position") -> DataFrame:
    """Positions in the order of reverse complements."""
    return with_position(reads.withColumn("_key", S.reverse_complement("seq")), name, "_key", "seq").drop("_key")


def rotate(reads: DataFrame, amount: int, number: str = "record_no") -> DataFrame:
    """New numbers after the last ``amount`` records moved to the front; numbers are 0 to n-1."""
    n = reads.agg(F.max(number).alias("m")).first()["m"]
    n = 0 if n is None else n + 1
    return reads.withColumn("position", (F.col(number) + amount) % max(1, n))


def interleave(first: DataFrame, second: DataFrame, number: str = "record_no") -> DataFrame:
    """file_no, record number and seq of two files taken in turn; when one ends the other's rest follows."""
    a = first.select(F.lit(0).cast("long").alias("file_no"), F.col(number).alias("record_no"), "seq")
    b = second.select(F.lit(1).cast("long").alias("file_no"), F.col(number).alias("record_no"), "seq")
    return a.unionByName(b).orderBy("record_no", "file_no")


def both_strands(reads: DataFrame, forward: bool = True, reverse: bool = True) -> DataFrame:
    """Each read on the chosen strands, with strand + or -."""
    rows = []
    if forward:
        rows.append(reads.withColumn("strand", F.lit("+")))
    if reverse:
        rows.append(reads.withColumn("seq", S.reverse_complement("seq")).withColumn("strand", F.lit("-")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def lookup(group_rows: DataFrame, reads: DataFrame) -> DataFrame:
    """The sequences of grouped read ids."""
    return group_rows.join(reads.select("read_id", "seq"), "read_id")


def split_by(reads: DataFrame, keep_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads whose id is kept, the others)."""
    return reads.join(keep_ids, "read_id", "left_semi"), reads.join(keep_ids, "read_id", "left_anti")
